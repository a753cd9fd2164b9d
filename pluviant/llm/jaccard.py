"""N-gram Jaccard join of whole texts, with prefix trees.

1. A text's set holds the hashes of its shingles, in the order of the hash. Equal sets are one class.
2. Two sets that are similar enough share one of the first tokens of either (as many as the similarity may miss, and one
   more). Classes meet by those tokens; tokens with the same list of classes count once. Classes of a token that many have
   meet by bands of size.
3. Where classes meet, sizes, the token's places and a parity bitmap of each set bound how much two sets can share. Pairs
   that pass connect candidate clusters; only a spanning forest of them leaves a task.
4. The whole sets of a cluster come together. A prefix tree holds those already seen; the next one walks it, counting what
   it shares along each path once for all sets below, and leaves a subtree when sizes and what is left of both sides
   can't reach the similarity any more, or when everything below is in its own component already. What passes is linked.
5. Components of links are named by their smallest document.

Groups and clusters too large for a task are split into blocks; every pair of blocks is a task of its own, so no link is
lost and no task holds more than two blocks.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._bytes import NON_SPACE, U, Chunk, mix, text_chunks, words
from ._spark import WORD, dropped, durable, packed_texts, row_key, stored
from .components import components

#: Classes of a token, and tokens of a cluster, that a block holds.
BLOCK_SETS = 2048
BLOCK_TOKENS = 2 << 20
#: Bits of the map by which rows that nobody wants are left out before a shuffle; however many are wanted, 2 MB travel.
WANTED_BITS = 1 << 24


def shingle_sets(chunk: Chunk, size: int) -> Iterator[np.ndarray]:
    """For each text of a chunk, the sorted distinct hashes of its runs of `size` words (a shorter text is one run)."""
    w = words(chunk, NON_SPACE)
    n = len(chunk.offsets) - 1
    at = np.searchsorted(w.doc, np.arange(n + 1))
    odd = [U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(size)]
    whole = np.zeros(max(0, len(w.hash) - size + 1), U)
    for k in range(size if len(whole) else 0):
        whole += w.hash[k : k + len(whole)] * odd[k]
    whole = mix(whole)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(whole[a : b - size + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield mix(np.array([sum(int(h) * int(odd[k]) for k, h in enumerate(w.hash[a:b])) + (b - a) & (1 << 64) - 1], U))
        else:
            yield np.zeros(0, U)


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by their low bits; two of them differ in no more places than the sets have tokens apart."""
    bits = max(64, 1 << (2 * len(tokens) - 1).bit_length())  # with fewer, texts that are somewhat alike pass by chance
    odd = np.bincount((tokens & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def first_tokens(n: int, percent: int) -> int:
    """How many tokens of a set of n, in order, must hold one of any similar set."""
    return n - -(-n * percent // 100) + 1


def most_apart(total: np.ndarray, percent: int) -> np.ndarray:
    """The most tokens that two similar sets of `total` tokens together may have apart."""
    return total - 2 * (-(-percent * total // (100 + percent)))


class Forest:
    """Components of 0 .. n-1, with the root of each at hand as an array."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n, dtype=np.int32)
        self.members: dict[int, list[int]] = {k: [k] for k in range(n)}

    def join(self, a: int, b: int) -> None:
        a, b = int(self.root[a]), int(self.root[b])
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.root[moved] = a
        self.members[a] += moved


def near_by_bitmap(sizes: np.ndarray, maps: list[bytes], percent: int) -> Forest:
    """Components of sets, sorted by size, whose sizes and bitmaps allow the similarity."""
    forest = Forest(len(sizes))
    if len(sizes) == 2 and len(maps[0]) == len(maps[1]):
        apart = (int.from_bytes(maps[0], "big") ^ int.from_bytes(maps[1], "big")).bit_count()
        if 100 * sizes[0] >= percent * sizes[1] and apart <= most_apart(sizes[0] + sizes[1], percent):
            forest.join(0, 1)
        return forest
    lengths = np.array([len(m) for m in maps])
    by = {w: (k := np.flatnonzero(lengths == w), np.frombuffer(b"".join(maps[i] for i in k), np.uint64).reshape(len(k), -1)) for w in np.unique(lengths).tolist()}
    for w, (rows, bits) in by.items():
        more = [(rows, bits)]
        for wide, both in (by[v] for v in by if v > w):
            while both.shape[1] > bits.shape[1]:  # the parities of a narrower map
                both = both[:, : both.shape[1] // 2] ^ both[:, both.shape[1] // 2 :]
            more.append((wide, both))
        for at, i in enumerate(rows.tolist()):
            for others, own in more:
                lo = at + 1 if others is rows else 0
                hi = int(np.searchsorted(percent * sizes[others], 100 * sizes[i], "right"))
                if hi <= lo:
                    continue
                k = others[lo:hi]
                new = np.flatnonzero(forest.root[k] != forest.root[i])
                if not len(new):
                    continue
                apart = np.bitwise_count(own[lo:hi][new] ^ bits[at]).sum(axis=1, dtype=np.int64)
                for j in k[new][apart <= most_apart(sizes[i] + sizes[k[new]], percent)].tolist():
                    forest.join(i, j)
    return forest


class Node:
    """Tokens that all sets below share after those above; sets that end here; nodes that go on, by their first token."""

    __slots__ = ("tokens", "ends", "next", "low", "high", "below")

    def __init__(self, tokens: np.ndarray) -> None:
        self.tokens, self.ends, self.next = tokens, [], {}
        self.low, self.high, self.below = 1 << 62, 0, array("i")

    def add(self, k: int, size: int) -> None:
        self.low, self.high = min(self.low, size), max(self.high, size)
        self.below.append(k)


class PrefixTree:
    """Sorted token arrays, those with a common beginning on one path; `search` finds and links similar ones."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sets, self.percent, self.top, self.forest = sets, percent, Node(np.zeros(0, U)), Forest(len(sets))

    def insert(self, k: int) -> None:
        s = self.sets[k]
        node, at = self.top, 0
        node.add(k, len(s))
        while at < len(s):
            child = node.next.get(int(s[at]))
            if child is None:
                child = node.next[int(s[at])] = Node(s[at:])
                at = len(s)
            else:
                m = min(len(child.tokens), len(s) - at)
                differ = child.tokens[:m] != s[at : at + m]
                same = int(differ.argmax()) if differ.any() else m
                if same < len(child.tokens):
                    upper = Node(child.tokens[:same])
                    upper.low, upper.high, upper.below = child.low, child.high, array("i", child.below)
                    child.tokens = child.tokens[same:]
                    upper.next[int(child.tokens[0])] = child
                    node.next[int(s[at])] = child = upper
                at += same
            node = child
            node.add(k, len(s))
        node.ends.append(k)

    def search(self, k: int) -> None:
        q, p, forest = self.sets[k], self.percent, self.forest
        n = len(q)
        stack = [(self.top, 0, 0, 0)]
        while stack:
            node, depth, shared, at = stack.pop()
            if 100 * node.high < p * n:
                continue
            # The longest set below gains most from what is left of it; the shortest needs least from what is left of q.
            if (100 + p) * (shared + node.high - depth) < p * (n + node.high) or (100 + p) * (shared + n - at) < p * (n + node.low):
                continue
            if (forest.root[np.frombuffer(node.below, np.int32)] == forest.root[k]).all():
                continue
            t = node.tokens
            if len(t):
                place = np.searchsorted(q, t)
                inside = place < n
                shared += int((q[place[inside]] == t[inside]).sum())
                depth += len(t)
                at = int(place[-1]) + int(inside[-1] and q[place[-1]] == t[-1])
            for j in node.ends:
                if (100 + p) * shared >= p * (n + len(self.sets[j])):
                    forest.join(k, j)
            stack += [(c, depth, shared, at) for first, c in node.next.items() if at >= n or first != int(q[at])]
            if at < n and (c := node.next.get(int(q[at]))) is not None:
                stack.append((c, depth, shared, at))  # the likeliest path first


def link(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Of each set (sorted tokens, none empty), the root of its component of similar sets."""
    tree = PrefixTree(sets, percent)
    for k in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        tree.search(k)
        tree.insert(k)
    return tree.forest.root


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list, pa.RecordBatch]]:
    """Runs of rows that agree in the first `keys` columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(len(batch), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


def _stars(pairs: Iterator[tuple[list[int], np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Edges from each set to the first of its component, in batches."""
    u: list[int] = []
    v: list[int] = []
    for keys, root in pairs:
        if len(keys) > 1:
            for k, r in enumerate(root.tolist()):
                if k != r and keys[k] != keys[r]:
                    u.append(keys[k])
                    v.append(keys[r])
        if len(u) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
            u, v = [], []
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _in_blocks(df: DataFrame, blocks: Column) -> DataFrame:
    """Each row once for every pair of blocks (cell) that its own block is part of; one cell where one block suffices."""
    df = df.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return df.withColumn("cell", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).drop("blocks", "own", "other")


def _in_bands(met: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """Rows (t, cid, n, c, most) with a band of sizes, and c as the rows of that band; 0 for all sizes if one block suffices.

    A class is in the band of its own size and in those above it up to that of `most`, so it meets any larger one that it
    allows in the larger one's band.
    """
    of = lambda x: F.floor(F.log(x) / (1e-9 - math.log(percent / 100)))
    bands = met.filter(F.col("c") > block_sets).withColumn("band", F.explode(F.sequence(of(F.col("n")), of(F.greatest("n", "most"))))).drop("c")
    counted = bands.join(bands.groupBy("t", "band").agg(F.count(F.lit(1)).alias("c")), ["t", "band"])
    return met.filter(F.col("c") <= block_sets).withColumn("band", F.lit(0).cast("long")).unionByName(counted)


def text_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """id, text -> id, key (digest of the set), n, map, first: one row for each row."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                keys, n, maps, first = [], [], [], []
                for s in shingle_sets(chunk, size):
                    keys.append(hashlib.md5(s).digest())
                    n.append(len(s))
                    maps.append(bitmap(s) if len(s) else b"")
                    first.append(s[: first_tokens(len(s), percent)] if len(s) else s)
                at = np.concatenate([[0], np.cumsum([len(f) for f in first])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*first, np.zeros(0, U)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(keys)), pa.array(keys, pa.binary()), pa.array(n, pa.int32()), pa.array(maps, pa.binary()), tokens], ["id", "key", "n", "map", "first"])

    return docs.mapInArrow(run, f"id {kind}, key binary, n int, map binary, first array<long>")


def _likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Packed texts of rows (id, text) that `wanted` has, and few others, by a map of hashed ids; the exact join is left to the caller."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(WANTED_BITS))
    nth = place("wanted") + 1  # buckets of bitmaps begin with 1
    bits = np.zeros(WANTED_BITS // 8, np.uint8)
    for r in wanted.groupBy(F.bitmap_bucket_number(nth).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(nth)).alias("bits")).collect():
        bits[(r.k - 1) * len(r.bits) : r.k * len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return packed_texts(docs, place("id"), bits)  # in one pass, as another worker for each task takes memory


def _whole_sets(docs: DataFrame, size: int) -> DataFrame:
    """id, packed texts -> key, tokens (packed) of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = pa.Codec("zstd")
        for batch in batches:
            texts = [press.decompress(p, n, asbytes=True) if n else b"" for n, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            for chunk in text_chunks(pa.array(texts, pa.binary()).cast(pa.string())):
                sets = [s.tobytes() for s in shingle_sets(chunk, size)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(s).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["key", "tokens"])

    return docs.select("id", "size", "packed").mapInArrow(run, "key binary, tokens binary")


def similar_classes(docs: DataFrame, classes: DataFrame, size: int, percent: int, block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Classes (cid, key, rep, n, map, first; no empty set) -> node, component: cids of classes with a link to another one."""
    tokens = classes.select("cid", F.posexplode("first").alias("i", "t"))
    lists = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("cid")).alias("a"), F.min("cid").alias("least")).filter("c > 1")
    # Of tokens with the same classes the first in the order of the sets, which is unsigned, is the first that two of them share.
    unsigned = lambda t: t.bitwiseXOR(F.lit(-(1 << 63)))
    once = lists.groupBy("c", "a", "least").agg(unsigned(F.min(unsigned(F.col("t")))).alias("t")).select("t", "c")
    # Both grow with the input, so neither is broadcast. `most`: if t, in place i, is the first token shared, the size of the
    # largest set that what follows in this one suffices for.
    met = tokens.join(once.hint("shuffle_hash"), "t").join(classes.select("cid", "n"), "cid")
    met = stored(met.select("t", "cid", "n", "c", F.expr(f"int(({100 + percent} * bigint(n - i) - {percent} * bigint(n)) div {percent})").alias("most")))
    cells = _in_bands(met, percent, block_sets)
    # A class whose size and `most` fit no other of its cell needs no bitmap there: either one before it, in the order of
    # sizes, allows its size, or it allows the size of the next one. Cells of several blocks are not gathered for that.
    by_size = W.partitionBy("t", "band", "apart").orderBy("n", "most")
    near = (F.max("most").over(by_size.rowsBetween(W.unboundedPreceding, -1)) >= F.col("n")) | (F.lead("n").over(by_size) <= F.col("most"))
    cells = cells.withColumn("apart", F.when(F.col("c") > block_sets, F.col("cid"))).withColumn("near", near | F.col("apart").isNotNull()).filter("near")
    cells = cells.drop("near", "apart", "most").join(classes.select("cid", "map"), "cid")
    cells = _in_blocks(cells, F.ceil(F.col("c") / block_sets).cast("long")).select("t", "band", "cell", "n", "cid", "map")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[list[int], np.ndarray]]:
            for _, rows in _grouped(batches, 3):
                if len(rows) > 1:
                    yield rows.column(4).to_pylist(), near_by_bitmap(rows.column(3).to_numpy().astype(np.int64), rows.column(5).to_pylist(), percent).root

        yield from _stars(each())

    edges = cells.repartition("t", "band", "cell").sortWithinPartitions("t", "band", "cell", "n").mapInArrow(meet, "u long, v long")
    clusters = components(edges).select(F.col("node").alias("cid"), "component")
    dropped(met)
    sized = clusters.join(classes.select("cid", "key", "rep", "n"), "cid")
    total = sized.groupBy("component").agg(F.sum("n").alias("total"))
    sized = durable(sized.join(total, "component").select("component", "cid", "key", "rep", "total"))
    wanted = sized.select(F.col("rep").alias("wanted")).distinct()
    packed = _likely(docs, wanted).join(wanted.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("wanted")))
    whole = _whole_sets(packed, size).join(sized.drop("rep"), "key")
    whole = _in_blocks(whole, F.ceil(F.col("total") / block_tokens).cast("long")).select("component", "cell", "cid", "tokens")
    links = _link_clusters(whole.repartition("component", "cell").sortWithinPartitions("component", "cell", "cid"), percent)
    return components(links)


def _link_clusters(whole: DataFrame, percent: int) -> DataFrame:
    """component, cell, cid, tokens sorted by the first three -> verified links as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[list[int], np.ndarray]]:
            for _, rows in _grouped(batches, 2):
                sets = dict(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True))
                yield list(sets), link([np.frombuffer(s, U) for s in sets.values()], percent)

        yield from _stars(each())

    return whole.mapInArrow(run, "u long, v long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85, block_sets: int = BLOCK_SETS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each row of `docs`: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Words are runs of non-whitespace with A-Z lower-cased; a set holds the distinct runs of `size` words of the whole text,
    or all words as one run if there are fewer. Two texts link when their sets share `percent` percent of their union.
    Texts without words, null ones too, have no set and stay alone. Tokens are 64-bit hashes. Null ids are never the
    smallest; rows that repeat an id are members of their own texts' components. An empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every = stored(text_sets(rows, size, percent))
    sets = durable(every.select("id", "n", "key"))
    rest = F.struct("id", "n", "map", "first")
    classes = every.filter("n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.first(rest).alias("r"))
    # Numbers of classes are fixed by the checkpoint.
    classes = durable(classes.select(F.monotonically_increasing_id().alias("cid"), "key", "rep", "r.n", "r.map", "r.first"))
    dropped(every)
    found = similar_classes(rows, classes, size, percent, block_sets, block_tokens)
    smallest = classes.select("cid", "key", "rep").join(found, F.col("cid") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "cid").alias("component"))
    named = smallest.groupBy("component").agg(F.min("rep").alias("least"))
    by_key = smallest.join(named, "component").select(F.col("key").alias("k"), "least")
    return sets.join(by_key, (F.col("key") == F.col("k")) & (F.col("n") > 0), "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each component, the one of the smallest id; null ids come last.

    Rows are told apart by all their columns, so rows that repeat an id, or have none, are documents of their own, and of
    rows that are equal throughout one stays. Texts without words are nobody's copies and all stay.
    """
    worded = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    rows = docs.filter(worded).withColumn("__row", row_key(docs, id_col))
    parts = jaccard_components(rows.select("__row", text_col), "__row", text_col, **options)
    # Only texts of rows that equal another throughout are grouped.
    kept = stored(parts.filter(F.col("__row") == F.col("component_id")).groupBy(F.col("__row").alias("kept_row")).agg(F.count(F.lit(1)).alias("equal")))
    among = lambda k: rows.join(k, F.col("__row") == F.col("kept_row"), "left_semi")
    one = among(kept.filter("equal = 1")).unionByName(among(kept.filter("equal > 1")).dropDuplicates(["__row"]))
    return one.select(docs.columns).unionByName(docs.filter(~worded))
