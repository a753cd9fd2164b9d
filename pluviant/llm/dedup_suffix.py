"""Removal of long byte strings that stand in more than one place, by suffix arrays over shards.

1. Every window of `length` bytes belongs to the smallest hash among its grams of GRAMS[0] bytes. Equal windows have equal
   smallest hashes, so shards by that hash hold all places of a window. Runs of windows with one hash are segments.
2. Hashes met once can't repeat; only segments of the others are cut out of the texts, and equal ones are counted.
3. Shards of whole hash groups get a suffix array by induced sorting and its permuted common prefixes; a place repeats
   if it shares `length` bytes with a neighbour in the array, or if its segment was counted twice.
4. A hash group too large for one array (a passage in a large part of all documents, in ever new surroundings) is dealt
   anew: its segments go through steps 1 to 3 as texts of their own, with longer grams. Grams of `length` bytes, the last
   ones, make groups of equal windows, which are one segment each.
5. Each text's repeated windows are merged to spans and cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import U, mix, text_chunks
from ._spark import dropped, packed_texts, stored
from .suffix_array import common_prefixes, suffix_array

#: Bytes of the grams that deal windows to groups, and deal large groups anew; windows themselves come last.
GRAMS = (64, 128)
#: Bytes of segments that a suffix array takes at once (a hash group is never split among arrays).
SHARD_BYTES = 320 << 10
#: Bytes of distinct segments beyond which a hash group is dealt anew.
GROUP_BYTES = 6 << 20


def grams_of(length: int) -> tuple[int, ...]:
    """Ascending sizes of grams for windows of `length` bytes, `length` last."""
    if length < 8:
        raise ValueError("strings shorter than 8 bytes are not looked for")
    return tuple(sorted({*([g for g in GRAMS if g < length] or [max(8, length // 2)]), length}))


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, first window, number of windows, and places of the gram, for each run; windows never cross texts.

    Of equal grams a window takes the leftmost. A run is not cut where the place moves to the same gram further on, as
    in periodic text, but the places are counted: a window can repeat inside its run only if there are several.
    """
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.view(U), none, none, none
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), np.uint64, padded, 0, (1,))
    grams = len(data) - gram + 1
    h = np.zeros(grams, U)
    for k in {*range(0, gram - 7, 8), gram - 8}:
        h += eight[k : k + grams] * U(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) | 1)
    grams_hash = mix(h)
    low = U((1 << max(24, len(data).bit_length())) - 1)
    h = (grams_hash & ~low) | np.arange(grams, dtype=U)  # ties go to the leftmost
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        h = np.minimum(h[: len(h) - have], h[have:])
        have *= 2
    if have < width:
        h = np.minimum(h[: len(h) - (width - have)], h[width - have :])
    place = (h[:n] & low).astype(np.int64)
    h = grams_hash[place]
    ok = np.zeros(n + 1, np.int8)
    sizes = np.diff(offsets)
    long = sizes >= length
    np.add.at(ok, offsets[:-1][long], 1)
    np.add.at(ok, offsets[:-1][long] + sizes[long] - length + 1, -1)
    valid = np.cumsum(ok[:n]) > 0
    change = np.ones(n, bool)
    change[1:] = (h[1:] != h[:-1]) | (valid[1:] != valid[:-1])
    change[offsets[:-1][long]] = True
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, n))
    moves = np.concatenate([[0], np.cumsum(place[1:] != place[:-1])])
    places = moves[first + count - 1] - moves[first] + 1
    keep = valid[first]
    return h[first[keep]], first[keep], count[keep], places[keep]


def _runs(texts: DataFrame, keys: list[str], length: int, gram: int) -> DataFrame:
    """keys, text -> keys, h, at, n (windows), places: the runs of each text."""
    last = len(keys)
    names = [*keys, "h", "at", "n", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(last)):
                h, first, count, places = window_runs(chunk.data, chunk.offsets, length, gram)
                doc = np.searchsorted(chunk.offsets, first, "right") - 1
                at = pa.array(doc + chunk.first)
                found = [pa.array(h.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (first - chunk.offsets[doc], count, places))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(last)), *found], names)

    return texts.select(*keys, "text").mapInArrow(run, f"{_types(texts, keys)}, h long, at int, n int, places int")


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _unpacked(size: int, packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed, size, asbytes=True) if size else b""


def _cut_out(texts: DataFrame, keys: list[str], length: int, packed: bool) -> DataFrame:
    """keys, size, text (packed or not), runs -> keys, h, at, seg: one row for each run, with its bytes."""
    last = len(keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            h: list[int] = []
            at: list[int] = []
            segments: list[bytes] = []
            held = 0

            def out(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                rows = pa.array(owner, pa.int64())
                found = [pa.array(h, pa.int64()), pa.array(at, pa.int32()), pa.array(segments, pa.binary())]
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in range(last)), *found], [*keys, "h", "at", "seg"])

            for row, (size, text, runs) in enumerate(zip(*(batch.column(last + k).to_pylist() for k in range(3)), strict=True)):
                data = _unpacked(size, text) if packed else text
                for r in runs:
                    owner.append(row)
                    h.append(r["h"])
                    at.append(r["at"])
                    segments.append(data[r["at"] : r["at"] + r["n"] + length - 1])
                    held += r["n"] + length
                if held > 8 << 20:
                    yield out()
                    owner, h, at, segments, held = [], [], [], [], 0
            yield out()

    return texts.select(*keys, "size", "text", "runs").mapInArrow(cut, f"{_types(texts, keys)}, h long, at int, seg binary")


def shard_repeats(segments: list[bytes], counts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each of a shard's distinct segments, the runs (first, last) of windows that stand in more than one place."""
    sizes = np.array([len(s) + 1 for s in segments])
    starts = np.cumsum(sizes) - sizes
    s = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint16) + 2
    s[starts + sizes - 1] = 1
    s = np.append(s, np.uint16(0))
    sa = suffix_array(s)
    shared = common_prefixes(s, sa)
    repeated = np.zeros(len(s) + 1, bool)
    same = shared[sa[1:]] >= length
    repeated[sa[1:][same]] = True
    repeated[sa[:-1][same]] = True
    for start, size, n in zip(starts.tolist(), sizes.tolist(), counts, strict=True):
        if n > 1:
            repeated[start : start + size - length] = True
        repeated[start + size - length : start + size] = False  # what is left there is shorter than a window
    edge = np.diff(repeated[:-1].astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    owner = np.searchsorted(starts, first, "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    for o, a, b in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True):
        out[o].append((a - int(starts[o]), b - int(starts[o])))
    return out


_RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
RESULT = "sid binary, ranges array<struct<lo:int,hi:int>>"


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """h, seg, n sorted by h -> RESULT; an array is built when enough whole hash groups have come."""
    segments: list[bytes] = []
    counts: list[int] = []
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        found = shard_repeats(segments, counts, length) if segments else []
        rows = [(hashlib.md5(s).digest(), [{"lo": a, "hi": b} for a, b in r]) for s, r in zip(segments, found, strict=True) if r]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], _RANGES)], ["sid", "ranges"])

    for batch in batches:
        for h, seg, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if h != last and size >= SHARD_BYTES:
                yield flush()
                segments, counts, size = [], [], 0
            last = h
            segments.append(seg)
            counts.append(n)
            size += len(seg)
    yield flush()


def _equal_windows(segments: DataFrame, length: int) -> DataFrame:
    """seg, n -> RESULT, for groups of the last gram, which is a whole window: a group's windows are equal but for collisions of hashes, so
    it is enough to count them by their bytes. Of a run of equal windows, which is of one byte only, one window is sent with the number of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for seg, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                places, sid = len(seg) - length + 1, hashlib.md5(seg).digest()
                if seg == seg[:1] * len(seg):
                    rows.append((sid, 0, places - 1, seg[:length], n * places))
                else:
                    rows += [(sid, k, k, seg[k : k + length], n) for k in range(places)]
            types = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["sid", "lo", "hi", "window", "places"])

    rows = segments.select("seg", "n").mapInArrow(run, "sid binary, lo int, hi int, window binary, places long")
    twice = rows.groupBy("window").agg(F.sum("places").alias("w")).filter("w > 1").select("window")
    return rows.join(twice, "window").groupBy("sid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def _repeated(texts: DataFrame, packed: DataFrame | None, keys: list[str], weight: str | None, length: int, grams: tuple[int, ...], group_bytes: int) -> DataFrame:
    """Texts (keys, text, and how often each counts) -> keys, windows: runs (lo, hi) of first bytes of repeated windows.

    `packed` has the same rows with their texts compressed, where those are shuffled. Equal rows share their keys.
    """
    times = F.col(weight) if weight else F.lit(1)
    own = [*keys, weight] if weight else keys
    runs = stored(_runs(texts, own, length, grams[0]))
    twice = runs.groupBy("h").agg(F.sum(F.col("places") * times).alias("w")).filter("w > 1").select("h")
    # Rows with equal keys have the same runs, which are kept once.
    wanted = runs.join(twice, "h").groupBy(*keys).agg(F.collect_set(F.struct("h", "at", "n")).alias("runs"))
    wanted = wanted.withColumnsRenamed({k: f"w_{k}" for k in keys})
    same = lambda: _all([F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys])
    rows = packed.withColumnRenamed("packed", "text") if packed is not None else texts.withColumn("size", F.length("text"))
    cut = rows.join(wanted.hint("shuffle_hash"), same()).drop(*(f"w_{k}" for k in keys))
    segments = stored(_cut_out(cut, own, length, packed is not None))
    dropped(runs)
    distinct = stored(segments.groupBy("h", "seg").agg(F.sum(times).alias("n")))
    large = distinct.groupBy("h").agg(F.sum(F.length("seg")).alias("bytes")).filter(F.col("bytes") > group_bytes).select("h")
    again = not large.isEmpty()
    fit = distinct.join(large, "h", "left_anti") if again else distinct
    found = fit.select("h", "seg", "n").repartition("h").sortWithinPartitions("h", "seg").mapInArrow(lambda b: _shards(b, length), RESULT)
    if again and len(grams) == 1:
        found = found.unionByName(_equal_windows(distinct.join(large, "h", "left_semi"), length))
    elif again:
        parts = distinct.join(large, "h", "left_semi").select(F.unhex(F.md5("seg")).alias("whole"), F.col("seg").alias("text"), F.col("n").alias("times"))
        found = found.unionByName(_repeated(parts, None, ["whole"], "times", length, grams[1:], group_bytes).select(F.col("whole").alias("sid"), F.col("windows").alias("ranges")))
    placed = segments.select(*keys, "at", F.unhex(F.md5("seg")).alias("sid")).join(found, "sid")
    moved = F.transform("ranges", lambda r: F.struct((r["lo"] + F.col("at")).alias("lo"), (r["hi"] + F.col("at")).alias("hi")))
    return placed.select(*keys, moved.alias("r")).groupBy(*keys).agg(F.flatten(F.collect_set("r")).alias("windows"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("k"), text.alias("text"))


def repeated_windows(docs: DataFrame, length: int = 200, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """`docs` (id, k, text) -> id, k, size, packed and windows: runs (lo, hi) of first bytes of repeated windows, by text."""
    packed = packed_texts(docs)
    spans = _repeated(docs, packed, ["id", "k"], None, length, grams_of(length), group_bytes)
    spans = spans.select(F.col("id").alias("wid"), F.col("k").alias("wk"), "windows")
    same = F.col("k").eqNullSafe(F.col("wk")) & F.col("id").eqNullSafe(F.col("wid"))
    return packed.join(spans.hint("shuffle_hash"), same, "left").select("id", "k", "size", "packed", "windows")


def removed_spans(windows: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs (first byte, byte after the last) that repeated windows cover."""
    out: list[list[int]] = []
    for lo, hi in sorted((w["lo"], w["hi"] + length) for w in windows or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, with_text: bool = True, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row for each row of `docs`: id, n_bytes, n_removed, spans (first, stop in bytes), kept_sha256, and kept, the
    bytes that stay (unless with_text is false).

    Texts are judged as UTF-8 bytes, each on the input; null texts count as empty and have nothing to remove, as have
    texts shorter than `length`. Rows that repeat an id and text are places of their own, so all their windows repeat.
    A long text that repeats only in itself is cut too. An empty table gives none; ids may be null.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], [], [], []]
            for size, packed, windows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = _unpacked(size, packed)
                spans = removed_spans(windows, length)
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                for to, x in zip(rows, (len(data), len(data) - len(kept), [{"first": a, "stop": b} for a, b in spans], hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                    to.append(x)
            types = (pa.int64(), pa.int64(), spans_type, pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, t) for r, t in zip(rows, types, strict=True))], ["id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    found = repeated_windows(_keyed(docs, id_col, text_col), length, group_bytes).select("id", "size", "packed", "windows")
    out = found.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, spans array<struct<first:int,stop:int>>, kept_sha256 string, kept binary")
    out = out.withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept")


def repeats_digest(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The registered form: id, n_bytes, n_removed, n_spans, kept_sha256."""
    return repeats(docs, id_col, with_text=False, **options).select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
