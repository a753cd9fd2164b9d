"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

Documents are dealt to buckets of a few megabytes. A bucket sends the distinct n-gram hashes of its words, with their
counts, to count tables partitioned by the hash; a table adds up what all buckets sent and answers each of them in its own
order. Buckets join the answers to their exploded n-grams and sum the logarithms by document. Hashes and counts travel
packed, so a frequent n-gram costs one entry a bucket, and nothing is gathered on the driver.

One- and two-word runs are sent first, then each longer order in turn. A run occurs in no other document if either of the
runs one word shorter in it occurs in no other document. Then it isn't sent: its count is the one in its own document.

The score of a word is count(words before it and it) / count(words before it) for the longest run of at most `order` words
that was counted at least `least` times, times BACKOFF for each word that the run is shorter than it could be; the last
resort is its share of all words. Every run of a scored document is in the corpus, so whole counts would never back off:
runs of two words and more, and the words before them, are counted in the other documents only, unless `own` is set.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import NON_SPACE, U, mix, text_chunks, words
from ._spark import durable, packed_texts, size_estimate

BACKOFF = 0.4
#: Bytes of stored input that a bucket, and of packed hashes that a table, should have about.
BUCKET_BYTES = 2 << 20


class Bucket(NamedTuple):
    """Words of a bucket's texts in order: hashes, texts they are of, places in them, and words in each text."""

    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    lengths: np.ndarray


class Level(NamedTuple):
    """By the word that an n-gram ends at: its count in all texts, and in all but the word's own (0 where none ends)."""

    total: np.ndarray
    others: np.ndarray


def ngrams(b: Bucket, order: int) -> list[np.ndarray]:
    """For each n up to `order`: the hashes of n-grams that end at each word (of no meaning before a text's n-th)."""
    out = [b.hashes]
    for n in range(2, order + 1):
        longer = np.zeros_like(b.hashes)
        longer[1:] = mix(out[-1][:-1] * U(0x9E3779B97F4A7C15) + b.hashes[1:] + U(n))
        out.append(longer)
    return out


def _bucket(table: pa.Table) -> Bucket:
    press = pa.Codec("zstd")
    texts = pa.array([press.decompress(p, n, asbytes=True) for p, n in zip(table.column("packed").to_pylist(), table.column("size").to_pylist(), strict=True)], pa.binary())
    hashes, lengths = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for chunk in text_chunks(texts):
        w = words(chunk, NON_SPACE)
        hashes.append(w.hash)
        lengths.append(np.bincount(w.doc, minlength=len(chunk.offsets) - 1))
    size = np.concatenate(lengths)
    owner = np.repeat(np.arange(len(size)), size)
    return Bucket(np.concatenate(hashes), owner, np.arange(len(owner)) - (np.cumsum(size) - size)[owner], size)


def _pack(x: np.ndarray) -> bytes:
    """Integers of eight bytes, as planes of first bytes, second bytes and so on; those of small ones vanish."""
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T), asbytes=True)


def _unpack(x: bytes, n: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(x, 8 * n, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(kind).ravel()


def _slices(own: np.ndarray, tables: int) -> np.ndarray:
    """Where the hashes of each table begin among sorted ones, and the end: tables hold ranges of the hash."""
    return np.append(np.searchsorted(own, np.array([t * (1 << 64) // tables for t in range(tables)], U)), len(own))


def _sent(n: int, b: Bucket, levels: dict[int, Level]) -> np.ndarray:
    """Whether the n-gram that ends at a word is sent to the tables."""
    sent = b.place >= n - 1
    if n > 2:
        shared = levels[n - 1].others > 0
        sent &= shared
        sent[1:] &= shared[:-1]
    return sent


def _same_text(h: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """How often each element's hash occurs with its owner."""
    _, at = np.unique(h, return_inverse=True)
    _, back, count = np.unique(at * n_texts + owner, return_inverse=True, return_counts=True)
    return count[back]


def _level(n: int, b: Bucket, h: np.ndarray, sent: np.ndarray, answers: pa.Table, tables: int, own: bool) -> Level:
    known, at = np.unique(h[sent], return_inverse=True)
    total = np.zeros(len(h), np.int64)
    if len(known):
        mine = answers.filter(pa.compute.equal(answers.column("n"), n)).sort_by("t")
        sizes = np.diff(_slices(known, tables))[mine.column("t").to_numpy()]
        total[sent] = np.concatenate([_unpack(x, s, np.int64) for x, s in zip(mine.column("totals").to_pylist(), sizes, strict=True)])[at]
    here = np.minimum(total, 1)
    many = total > 1
    here[many] = _same_text(h[many], b.owner[many], len(b.lengths))
    others = total - here
    if own:
        alone = (b.place >= n - 1) & ~sent
        total[alone] = _same_text(h[alone], b.owner[alone], len(b.lengths))
    return Level(total, others)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, least: int = 1, own: bool = False, buckets: int | None = None) -> DataFrame:
    """One row for each row of `docs`: id, n_tokens, n_backoff (words scored by a shorter run than could be), log_prob (sum
    of natural logarithms) and mean_log_prob (null without words).

    Words are runs of non-whitespace, A-Z lower-cased; all texts are counted and scored whole. Runs never cross texts.
    `own`: runs of the scored row itself count too. Null and empty texts have no tokens and the log_prob 0. Rows that
    repeat an id or are equal throughout count and are scored each, as other documents of one another. An empty table
    gives none. Hashes of n-grams have 64 bits.
    """
    if order < 1 or least < 1:
        raise ValueError("order and least must be 1 or more")
    if buckets is None:
        buckets = int(min(max(8, size_estimate(docs.select(id_col, text_col)) // BUCKET_BYTES), 1 << 20))
    tables, parts = buckets, min(buckets, 1 << 16)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Equal rows of different partitions go to different buckets, however many there are.
    bucket = F.pmod(F.xxhash64(F.col(id_col), text, F.spark_partition_id()), F.lit(buckets)).cast("int")
    dealt = packed_texts(docs.select(F.col(id_col).alias("row"), bucket.alias("bucket"), text.alias("text"))).repartition(parts, "bucket")

    def send(key: tuple, b: Bucket, orders: range, levels: dict[int, Level]) -> pa.Table:
        rows, grams = [], ngrams(b, orders[-1])
        for n in orders:
            mine, count = np.unique(grams[n - 1][_sent(n, b, levels)], return_counts=True)
            cut = _slices(mine, tables)
            for t in np.flatnonzero(np.diff(cut)):
                rows.append((key[0].as_py(), n, t, cut[t + 1] - cut[t], _pack(mine[cut[t] : cut[t + 1]]), _pack(count[cut[t] : cut[t + 1]].astype(np.int64))))
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["bucket", "n", "t", "size", "hashes", "counts"])

    def first(key: tuple, texts: pa.Table) -> pa.Table:
        return send(key, _bucket(texts), range(1, min(order, 2) + 1), {})

    def levels_of(b: Bucket, lowest: int, highest: int, answers: pa.Table) -> dict[int, Level]:
        grams, levels = ngrams(b, highest), {}
        for n in range(lowest, highest + 1):
            levels[n] = _level(n, b, grams[n - 1], _sent(n, b, levels), answers, tables, own)
        return levels

    def later(n: int):
        def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
            b = _bucket(texts)
            return send(key, b, range(n, n + 1), levels_of(b, 2, n - 1, answers))

        return run

    def count(table: pa.Table) -> pa.Table:
        sizes = table.column("size").to_pylist()
        hashes, counts = ([_unpack(x, s, kind) for x, s in zip(table.column(c).to_pylist(), sizes, strict=True)] for c, kind in (("hashes", U), ("counts", np.int64)))
        known, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, at, np.concatenate(counts))
        answers = [_pack(total[x]) for x in np.split(at, np.cumsum(sizes)[:-1])]
        return pa.table([*(table.column(c) for c in ("bucket", "n", "t")), pa.array(answers, pa.binary())], ["bucket", "n", "t", "totals"])

    def resolve(texts: pa.Table, answers: pa.Table) -> pa.Table:
        b = _bucket(texts)
        levels = levels_of(b, 1, order, answers)
        could = np.minimum(b.place + 1, order)
        log_p, used = np.zeros(len(b.hashes)), np.ones(len(b.hashes), np.int64)
        for n in range(order, 1, -1):
            now, before = (x.total if own else x.others for x in (levels[n], levels[n - 1]))
            take = np.flatnonzero((used == 1) & (could >= n) & (now >= least))
            log_p[take] = np.log(now[take]) - np.log(before[take - 1])
            used[take] = n
        rest = used == 1
        log_p[rest] = np.log(levels[1].total[rest])  # the share of all words: their number is taken off at the end
        log_p += np.log(BACKOFF) * (could - used)
        sums = lambda x: np.bincount(b.owner, x, minlength=len(b.lengths))
        columns = [texts.column("row"), pa.array(b.lengths), pa.array(sums(used < could).astype(np.int64)), pa.array(sums(rest).astype(np.int64)), pa.array(sums(log_p).astype(np.float64))]
        return pa.table(columns, ["row", "n_tokens", "n_backoff", "n_share", "log_p"])

    groups, told = dealt.groupBy("bucket"), "bucket int, n int, t int, size long, hashes binary, counts binary"

    def answered(sent: DataFrame) -> DataFrame:
        # Partitioned like the texts here, so that the union of all orders' answers needs no other shuffle.
        return sent.groupBy("n", "t").applyInArrow(count, "bucket int, n int, t int, totals binary").repartition(parts, "bucket")

    answers = answered(groups.applyInArrow(first, told))
    for n in range(3, order + 1):
        answers = answers.unionByName(answered(groups.cogroup(answers.groupBy("bucket")).applyInArrow(later(n), told)))
    found = groups.cogroup(answers.groupBy("bucket")).applyInArrow(resolve, f"row {kind}, n_tokens long, n_backoff long, n_share long, log_p double")
    found = durable(found)
    total = F.broadcast(found.agg(F.greatest(F.lit(1.0), F.sum("n_tokens").cast("double")).alias("total")))
    log_prob = F.col("log_p") - F.when(F.col("n_share") > 0, F.col("n_share") * F.log(F.coalesce("total", F.lit(1.0)))).otherwise(0.0)
    out = found.crossJoin(total).select(F.col("row").alias(id_col), "n_tokens", "n_backoff", log_prob.alias("log_prob"))
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def lm_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The registered form: sums rounded to four places, so that engines that add in another order agree."""
    s = lm_scores(docs, id_col, **options)
    return s.select(id_col, "n_tokens", "n_backoff", F.round("log_prob", 4).alias("log_prob"), F.round("mean_log_prob", 6).alias("mean_log_prob"))
