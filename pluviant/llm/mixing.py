"""Mixing sources to target weights: blocks of words, multinomial counts per output shard, index permutations.

Every step is a DataFrame expression. Words of a source, documents in a fixed pseudorandom order, form one sequence that
is cut into blocks of `block_len` words (the last may be shorter). A source's quota of slots takes its target exactly:
whole passes over all blocks, then a pass that ends in mid-block. Output shards draw the sources of their slots from
the multinomial distribution of the quotas; what a source is drawn beyond its quota goes to the sources drawn too
seldom, since a source whose target is its cap may not exceed it. Slot k of a source is block p(k mod blocks), where p is
a keyed permutation of the block numbers, another one for each pass; picks and documents are joined by block number.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import WORD, durable, expand, row_key

#: Slots and rows that a task or a window should have about; what there must be at least of grid cells and id buckets.
TASK_SLOTS = 1 << 15
TASK_ROWS = 1 << 14
GRID = 4096
BUCKETS = 1024


class Mix(NamedTuple):
    """sized: id, source, size, sid, lo (first word's place in its source), each input row once.
    targets: sid, source, source_size, target, quota, n_full, tail, rest.
    picks: shard, sid, k, block, len: each slot of the mix.
    spans: id, sid, block, from_word, n_words, full (times taken whole), part (words of the last, shorter take)."""

    sized: DataFrame
    targets: DataFrame
    picks: DataFrame
    spans: DataFrame


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size -> sid, weight, target. One row a source; targets in proportion to weights, up to the cap.

    Sources fill up in the order of cap over weight. Once those before it are full, the level that shares the rest by
    weight is the answer for the first source that it does not fill.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    fill = W.orderBy("ratio", "sid")
    everything = W.partitionBy()
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("ahead", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("ahead"))
    s = s.withColumn("at", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "sid", "level"))).over(everything))
    return s.select("sid", "source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("at.level")), F.col("cap")).alias("target"))


def permuted(index: Column, n: Column, key: Column, rounds: int) -> Column:
    """A keyed permutation of 0 .. n-1 for any n: swap-or-not rounds, each of which swaps pairs that add up to a key."""
    swap = lambda x, r: F.pmod(F.pmod(F.xxhash64(key, r, F.lit("pair")), n) - x, n)
    bit = lambda x, r: F.xxhash64(key, r, F.greatest(x, swap(x, r))) % 2 == 0
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), lambda x, r: F.when(bit(x, r), swap(x, r)).otherwise(x))


def _overlaps(a: DataFrame, b: DataFrame, total: str, grid: int) -> DataFrame:
    """Pairs of intervals [alo, ahi) and [blo, bhi) of 0 .. total that overlap, joined by cells of a grid.

    The hint keeps Spark from broadcasting `a`, whose rows it can't foresee."""
    cell = lambda x: (x * grid / F.col(total)).cast("long")
    cells = lambda lo, hi: F.explode(F.sequence(cell(F.col(lo)), cell(F.col(hi) - 1)))
    a = a.filter("ahi > alo").withColumn("cell", cells("alo", "ahi"))
    b = b.filter("bhi > blo").withColumn("cell", cells("blo", "bhi")).drop(total)
    lo = F.greatest("alo", "blo")
    return a.join(b.hint("shuffle_hash"), "cell").filter((F.least("ahi", "bhi") > lo) & (cell(lo) == F.col("cell")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_len: int = 64, n_shards: int = 256, rounds: int = 12, seed: int = 20, row_col: str | None = None) -> Mix:
    """The mix's tables; see `Mix` and the module's text. Only ids, sources and sizes are shuffled, never texts.

    A document is a row; null and empty texts have size 0 and are never taken. Null sources form one source, the last.
    Rows that repeat an id count as rows of their own. A hot source spreads over shards, blocks and id buckets. Without
    any word all targets are 0; without rows all tables are empty. The draw depends on ids, sizes and the seed alone, and among rows of the same id and
    size on `row_col`, if it is given; `sized` and `spans` then have it as `row`.
    """
    if cap < share:
        raise ValueError("a share above the cap can't be reached")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    row = ["row"] if row_col else []
    base = durable(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), *(F.col(row_col).alias(r) for r in row)))
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    n, b = F.col("source_size"), _long(block_len)
    t = targets.withColumn("passes", F.when(n > 0, F.floor(F.col("target") / n)).otherwise(0).cast("long")).withColumn("left", F.when(n > 0, F.least(n, F.round("target").cast("long") - F.col("passes") * n)).otherwise(0))
    t = t.withColumn("n_full", F.floor(n / b).cast("long")).withColumn("tail", n % b)
    t = t.withColumn("blocks", F.col("n_full") + (F.col("tail") > 0).cast("long")).withColumn("whole", F.least(F.floor(F.col("left") / b).cast("long"), F.col("n_full")))
    t = t.withColumn("rest", F.greatest(_long(0), F.col("left") - F.col("whole") * b)).withColumn("quota", F.col("passes") * F.col("blocks") + F.col("whole") + (F.col("rest") > 0).cast("long"))
    targets = durable(t.withColumn("qhi", F.sum("quota").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0))).withColumn("slots", F.sum("quota").over(W.partitionBy())))

    n_slots, n_rows = targets.agg(F.max("slots")).first()[0] or 0, base.count()
    parts, grid, buckets = max(8, n_slots // TASK_SLOTS), max(GRID, n_slots // TASK_SLOTS), max(BUCKETS, n_rows // TASK_ROWS)

    # Multinomial counts: each slot of each shard draws a number below the sum of quotas.
    shards = targets.agg(F.max("slots").alias("slots")).filter("slots > 0").withColumn("shard", F.explode(F.sequence(_long(0), _long(n_shards - 1))))
    room = F.floor((F.col("shard") + 1) * F.col("slots") / n_shards) - F.floor(F.col("shard") * F.col("slots") / n_shards)
    shards = shards.withColumn("room", room.cast("long"))
    drawn = expand(shards, "room", "slot", parts).withColumn("alo", F.pmod(F.xxhash64(_long(seed), "shard", "slot"), F.col("slots"))).withColumn("ahi", F.col("alo") + 1)
    bounds = targets.select("sid", "quota", (F.col("qhi") - F.col("quota")).alias("blo"), F.col("qhi").alias("bhi"), "slots")
    counts = _overlaps(drawn, bounds, "slots", grid).groupBy("shard", "sid", "quota").agg(F.count(F.lit(1)).alias("drawn"))
    start = F.coalesce(F.sum("drawn").over(W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), _long(0))
    counts = durable(counts.withColumn("first", start).withColumn("n", F.greatest(_long(0), F.least("drawn", F.col("quota") - F.col("first")))))

    # What sources were drawn beyond their quotas goes, shard by shard, to the sources drawn too seldom.
    spare = counts.groupBy("shard").agg(F.sum(F.col("drawn") - F.col("n")).alias("spare"))
    spare = spare.withColumn("ahi", F.sum("spare").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0))).withColumn("alo", F.col("ahi") - F.col("spare")).withColumn("over", F.sum("spare").over(W.partitionBy()))
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    short = targets.join(got, "sid", "left").select("sid", F.coalesce("got", _long(0)).alias("got"), (F.col("quota") - F.coalesce("got", _long(0))).alias("short"))
    short = short.withColumn("bhi", F.sum("short").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0))).withColumn("blo", F.col("bhi") - F.col("short"))
    extra = _overlaps(spare, short.withColumn("over", F.sum("short").over(W.partitionBy())), "over", grid)
    extra = extra.select("shard", "sid", (F.col("got") + F.greatest("alo", "blo") - F.col("blo")).alias("first"), (F.least("ahi", "bhi") - F.greatest("alo", "blo")).alias("n"))
    dealt = counts.select("shard", "sid", "first", "n").unionByName(extra)

    plan = targets.select("sid", "n_full", "tail", "blocks", "rest", F.col("quota").alias("q"))
    slots = expand(dealt.join(plan, "sid"), "n", "j", parts).withColumn("k", F.col("first") + F.col("j"))
    at = F.col("k") % F.col("blocks")
    epoch = F.floor(F.col("k") / F.col("blocks"))
    block = F.when(at < F.col("n_full"), permuted(at, F.greatest(_long(1), F.col("n_full")), F.xxhash64(_long(seed), "sid", epoch), rounds)).otherwise(F.col("n_full"))
    length = F.when((F.col("k") == F.col("q") - 1) & (F.col("rest") > 0), F.col("rest")).when(at < F.col("n_full"), b).otherwise(F.col("tail"))
    picks = slots.select("shard", "sid", "k", block.alias("block"), length.alias("len"), (length < F.when(at < F.col("n_full"), b).otherwise(F.col("tail"))).alias("cut"))

    # Where each document lies in its source: sums of id buckets, then sums inside a bucket.
    placed = base.join(targets.select(F.col("source").alias("s"), "sid"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.pmod(F.xxhash64("id", "size"), F.lit(buckets)))
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("sum"))
    sums = sums.withColumn("base", F.coalesce(F.sum("sum").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), _long(0))).drop("sum")
    inside = F.coalesce(F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("id", "size", *row).rowsBetween(W.unboundedPreceding, -1)), _long(0))
    sized = placed.withColumn("inside", inside).join(sums, ["sid", "bucket"]).select("id", *row, "source", "size", "sid", (F.col("base") + F.col("inside")).alias("lo"))

    taken = picks.groupBy("sid", "block").agg(F.count(F.when(~F.col("cut"), 1)).alias("full"), F.coalesce(F.max(F.when(F.col("cut"), F.col("len"))), _long(0)).alias("part"))
    pieces = sized.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / b).cast("long"), F.floor((F.col("lo") + F.col("size") - 1) / b).cast("long"))))
    left, right = F.greatest("lo", F.col("block") * b), F.least(F.col("lo") + F.col("size"), (F.col("block") + 1) * b)
    part = F.greatest(_long(0), F.least(right, F.col("block") * b + F.col("part")) - left)
    spans = pieces.join(taken.hint("merge"), ["sid", "block"]).select("id", *row, "sid", "lo", "size", "block", (left - F.col("lo")).alias("from_word"), (right - left).alias("n_words"), "full", part.alias("part"))
    return Mix(sized, targets.select("sid", "source", "source_size", "target", "quota", "n_full", "tail", "rest"), picks.drop("cut"), spans)


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row a document: id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    mix = mix_sources(docs, id_col, text_col, source_col, **options)
    of = mix.targets.select("sid", "source_size", "target")
    taken = mix.spans.groupBy("id", "sid", "lo", "size").agg(F.sum(F.col("n_words") * F.col("full") + F.col("part")).alias("taken"))
    none = mix.sized.filter("size > 0").select("id", "sid", "lo", "size", _long(0).alias("taken"))
    each = taken.unionByName(none).groupBy("id", "sid", "lo", "size").agg(F.sum("taken").alias("taken"))
    each = each.select("id", "sid", "size", "taken").unionByName(mix.sized.filter("size = 0").select("id", "sid", "size", _long(0).alias("taken")))
    return each.join(of, "sid").select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents: `docs`' columns, one row for each time that words of a document are taken.

    A row's text holds, in their order, the words taken at least that often; a document taken whole keeps its text as
    it is. n_chars, where there is such a column, follows the text; other columns stay as they are. Null and empty texts
    have no words and are never taken; an empty table gives none. Rows that repeat an id, or have none, have words of
    their own taken; of rows equal in all columns any text serves for all.
    """
    keyed = docs.withColumn("__row", row_key(docs, id_col))
    mix = mix_sources(keyed, id_col, text_col, source_col, row_col="__row", **options)
    times = F.col("full") + (F.col("part") > 0).cast("long")
    span = F.struct("from_word", "n_words", "full", "part")
    got = mix.spans.groupBy("row", "sid", "lo", "size").agg(F.sort_array(F.collect_list(span)).alias("spans"), F.max(times).alias("times"))
    got = got.filter("times > 0").withColumn("turn", F.explode(F.sequence(_long(1), F.col("times"))))
    take = lambda s: F.when(s["full"] >= F.col("turn"), s["n_words"]).when(s["full"] + 1 == F.col("turn"), s["part"]).otherwise(_long(0))
    got = got.withColumn("cuts", F.filter(F.transform("spans", lambda s: F.struct(s["from_word"].alias("at"), take(s).alias("n"))), lambda c: c["n"] > 0)).filter(F.size("cuts") > 0)
    n = F.aggregate("cuts", _long(0), lambda a, c: a + c["n"])
    got = got.select(F.col("row").alias("__mix_row"), F.struct("cuts", (n == F.col("size")).alias("whole")).alias("__mix"))
    rows = keyed.dropDuplicates(["__row"]).join(got, F.col("__row") == F.col("__mix_row"))
    # A text's words are found once, however many cuts are taken from them.
    words = F.array(F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})")))
    some = F.transform(words, lambda w: F.array_join(F.flatten(F.transform("__mix.cuts", lambda c: F.slice(w, (c["at"] + 1).cast("int"), c["n"].cast("int")))), " "))
    rows = rows.withColumn(text_col, F.when(F.col("__mix.whole"), F.col(text_col)).otherwise(some[0]))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)
