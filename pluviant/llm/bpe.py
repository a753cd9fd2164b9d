"""Byte-level BPE: texts to ids by ranked merges of byte arrays, and ids back to bytes.

A task cuts its texts by the tokenizer's pattern and numbers the distinct pieces of a block of texts. The distinct pieces are
merged together, in rounds over one array of all their ids: in each round every piece merges the pair of the lowest rank, the
leftmost of equal ones. Texts then gather their pieces' ids, so no row is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text whose distinct pieces are merged once.
BLOCK_BYTES = 32 << 20
#: Distinct pieces that are merged together.
PIECES = 1 << 15
#: Ids of texts that are handed on together.
TOGETHER = 1 << 20
#: Pieces of more bytes are merged with a heap, as each round copies what is left of all pieces.
LONG_PIECE = 256
#: Ids are below LIMIT; NONE is what a pair merges into that isn't one.
LIMIT, NONE = 1 << 17, (1 << 31) - 1
SLOTS, GROUPS = 1 << 18, 1 << 16
#: Factors of slots to choose from.
FACTORS = (12289, 7919, 10007, 5003, 24593, 3079, 15013, 1543)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by bytes from a file of base64 pieces and ranks, a line each; ranks are the ids."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in file if line.strip())}


class Vocabulary(NamedTuple):
    """ranks by bytes, the ids of the 256 bytes, what two bytes merge into, and the pieces one after another with their
    offsets by id."""

    ranks: dict[bytes, int]
    of_byte: np.ndarray
    of_two: np.ndarray
    blob: np.ndarray
    offsets: np.ndarray


def vocabulary(ranks: dict[bytes, int]) -> Vocabulary:
    """Every single byte must have a rank; ids without a piece decode to nothing."""
    lacking = [b for b in range(256) if bytes([b]) not in ranks]
    if lacking:
        raise ValueError(f"bytes without a rank: {lacking[:5]}")
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    offsets = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) for p in pieces], out=offsets[1:])
    of_two = np.full((256, 256), NONE, np.int32)
    for piece, rank in ranks.items():
        if len(piece) == 2:
            of_two[piece[0], piece[1]] = rank
    return Vocabulary(ranks, np.array([ranks[bytes([b])] for b in range(256)], np.int32), of_two, np.frombuffer(b"".join(pieces), np.uint8), offsets)


def _slots(a, b, shift, factor: int):
    """Group and slot of a pair of ids, given the group's shift."""
    return (a * 8191 + b) & (GROUPS - 1), (shift + b * factor + a) & (SLOTS - 1)


def rank_map(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Shifts by group, by slot a pair of ids with the id that it merges into (every cut of every piece is a pair), and the slots' factor.

    Factor and shifts are chosen so that no two pairs share a slot, so one look is enough.
    """
    pairs = np.array([(ranks[p[:k]], ranks[p[k:]], rank) for p, rank in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks] or np.zeros((0, 3)), np.int64)
    if len(pairs) > 0.8 * SLOTS or max(ranks.values()) >= LIMIT:
        raise ValueError(f"a vocabulary of {len(pairs)} pairs needs more slots")
    a, b, new = pairs.T
    for factor in FACTORS:
        group, base = _slots(a, b, 0, factor)
        if len(np.unique(group * SLOTS + base)) == len(pairs):
            break
    else:
        raise ValueError("pairs of this vocabulary share a slot with any factor")
    shifts, slots = np.zeros(GROUPS, np.int32), np.full(SLOTS, -1, np.int64)
    sizes, order = np.bincount(group, minlength=GROUPS), np.argsort(group, kind="stable")
    ends = np.cumsum(sizes)
    for g in np.argsort(-sizes, kind="stable")[: (sizes > 0).sum()]:
        own = order[ends[g] - sizes[g] : ends[g]]
        while (slots[at := (base[own] + shifts[g]) & (SLOTS - 1)] >= 0).any():
            shifts[g] += 1
        slots[at] = a[own] << 34 | b[own] << 17 | new[own]
    return shifts, np.where(slots < 0, 1 << 60, slots), factor  # no pair with a free slot's bits


def merged_pieces(joined: np.ndarray, sizes: np.ndarray, words: Vocabulary, maps: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces given one after another as bytes, none empty, and how many ids each has.

    In a round every piece that isn't done merges one pair, that of the lowest rank and the leftmost of equal ones; only the
    two pairs beside it are looked up anew.
    """
    shifts, slots, factor = maps

    def looked_up(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.astype(np.int64), b.astype(np.int64)
        group, _ = _slots(a, b, 0, factor)
        _, slot = _slots(a, b, shifts[group], factor)
        found = slots[slot] ^ (a << 34 | b << 17)  # the id alone if the slot has this pair, else a great number
        return np.where(found < LIMIT, found, NONE)

    left, size, ids = np.arange(len(sizes)), sizes.astype(np.int64), words.of_byte[joined]
    merges = np.full(len(ids), NONE, np.int32)  # what an id and the next one of its piece merge into
    merges[:-1] = words.of_two[joined[:-1], joined[1:]]
    merges[np.cumsum(size) - 1] = NONE
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(left):
        least = np.minimum.reduceat(merges, np.cumsum(size) - size)
        if (over := least == NONE).any():
            out = np.repeat(over, size)
            done.append((left[over], size[over], ids[out]))
            left, size, least, ids, merges = left[~over], size[~over], least[~over], ids[~out], merges[~out]
            if not len(left):
                break
        ends = np.cumsum(size)
        hit = np.flatnonzero(merges == np.repeat(least, size))
        of = np.searchsorted(ends, hit, "right")
        at = hit[np.concatenate([[True], of[1:] != of[:-1]])]
        ids[at], merges[at] = least, NONE
        right, before = at[at + 2 < ends], at[at > ends - size]
        merges[right] = looked_up(ids[right], ids[right + 2])
        merges[before - 1] = looked_up(ids[before - 1], ids[before])
        stay = np.ones(len(ids), bool)
        stay[at + 1] = False
        ids, merges, size = ids[stay], merges[stay], size - 1
    counts = np.zeros(len(sizes), np.int64)
    for which, n, _ in done:
        counts[which] = n
    starts, every = np.cumsum(counts) - counts, np.zeros(counts.sum(), np.int32)
    for which, n, found in done:
        every[np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
    return every, counts


def merged_with_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long piece, in time n log n."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by start: where a part ends, the part before it
    alive = [True] * n
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, start, stop = heapq.heappop(heap)
        middle = end[start]
        if not alive[start] or middle >= n or end[middle] != stop:
            continue
        end[start], alive[middle] = stop, False
        if stop < n:
            before[stop] = start
            if (r := ranks.get(piece[start : end[stop]])) is not None:
                heapq.heappush(heap, (r, start, end[stop]))
        if (b := before[start]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
            heapq.heappush(heap, (r, b, stop))
    return [ranks[piece[k : end[k]]] for k in range(n) if alive[k]]


class Numbers(dict):
    """Numbers of things in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def _ids_of(pieces: list[str], words: Vocabulary, maps: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct pieces, one after another, and how many each has."""
    flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for k in range(0, len(pieces), PIECES):
        raw = [p.encode() for p in pieces[k : k + PIECES]]
        done = [[words.ranks[p]] if p in words.ranks else merged_with_heap(p, words.ranks) if len(p) > LONG_PIECE or not p else None for p in raw]
        rest = [p for p, d in zip(raw, done, strict=True) if d is None]
        folded, sizes = merged_pieces(np.frombuffer(b"".join(rest), np.uint8), np.array([len(p) for p in rest], np.int64), words, maps)
        count, known = np.array([-1 if d is None else len(d) for d in done]), [x for d in done if d is not None for x in d]
        whole = count >= 0
        count[~whole] = sizes
        of_known = np.repeat(whole, count)
        ids = np.empty(len(of_known), np.int32)
        ids[of_known], ids[~of_known] = known, folded
        flat.append(ids)
        counts.append(count)
    return np.concatenate(flat), np.concatenate(counts)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """docs without text_col, with `ids`, an array of the ids of each whole text; each match of `pattern` is merged separately.

    A null text counts as empty and has no ids. Rows stay as they are, whether they have an id, repeat or not; any other
    columns are kept, but for one called `ids`, which is replaced. An empty table gives an empty table.
    """
    import pyarrow as pa

    def listed(texts: list[np.ndarray]) -> list:
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(texts), pa.int32()))]

    return encoded(docs, ranks, pattern, listed, {"ids": "array<int>"}, text_col, block)


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, made: Callable[[list[np.ndarray]], list], kinds: dict[str, str], text_col: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """Like `encode`, with the columns `kinds` that `made` makes of some texts' ids (an array for each column) where they arise, so that ids
    needn't pass to another worker."""
    import pyarrow as pa

    words, maps = vocabulary(ranks), rank_map(ranks)
    names = [c for c in docs.columns if c not in (text_col, *kinds)]
    safe = docs.select(F.col(text_col).alias("text"), *[F.col(c).alias(f"k{n}") for n, c in enumerate(names)])
    keys = [f"k{n}" for n in range(len(names))]
    head = "".join(f", {k} {safe.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(pattern).findall
        number = Numbers()
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []  # rows without their texts, the numbers of each one's pieces
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            every, counts = _ids_of(list(number), words, maps)
            starts = np.cumsum(counts) - counts
            for own, numbers in held:
                texts, total, first = [], 0, 0
                for j, n in enumerate(numbers):
                    lengths = counts[n]
                    ends = np.cumsum(lengths)
                    texts.append(every[np.repeat(starts[n] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)])
                    total += len(texts[-1])
                    if total >= TOGETHER or j == len(numbers) - 1:
                        yield pa.RecordBatch.from_arrays([*made(texts), *(c.slice(first, len(texts)) for c in own.columns)], [*kinds, *keys])
                        texts, total, first = [], 0, j + 1

        for batch in batches:
            texts, own = batch.column(0), batch.select(keys)
            first, numbers = 0, []
            for k, text in enumerate(texts):
                got = text.as_py() or ""
                numbers.append(np.fromiter(map(number.__getitem__, cut(got)), np.int32))
                size += len(got)
                if size >= block:
                    held.append((own.slice(first), numbers))
                    yield from flush()
                    number, held, size, first, numbers = Numbers(), [], 0, k + 1, []
            held.append((own.slice(first), numbers))
        yield from flush()

    out = safe.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + head)
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, names, strict=True)], *kinds)


def decoded(ids: np.ndarray, words: Vocabulary) -> np.ndarray:
    """The pieces of ids, one after another."""
    at = words.offsets[ids]
    sizes = words.offsets[ids + 1] - at
    ends = np.cumsum(sizes)
    return words.blob[np.repeat(at - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def decode(encoded: DataFrame, ranks: dict[bytes, int], out: str = "decoded") -> DataFrame:
    """A frame with an array `ids` -> its columns and `out`, the bytes of the ids' pieces. Null ids give null; ids that the
    vocabulary lacks are an error."""
    import pyarrow as pa

    words = vocabulary(ranks)
    names = [c for c in encoded.columns if c != out]
    safe = encoded.select(*[F.col(c).alias(f"k{n}") for n, c in enumerate(names)])
    at = names.index("ids")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in safe.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decoded(row.values.to_numpy(zero_copy_only=False), words).tobytes() if row.is_valid else None for row in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "found"])

    back = safe.mapInArrow(run, f"{schema}, found binary")
    return back.select(*[F.col(f"k{n}").alias(c) for n, c in enumerate(names)], F.col("found").alias(out))


def bpe_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 (the bytes that `decoded` makes of the ids)."""
    import hashlib

    import pyarrow as pa

    ranks = read_ranks(path)
    words = vocabulary(ranks)

    def digests(texts: list[np.ndarray]) -> list:
        made = [[hashlib.sha256(x).hexdigest() for x in column] for column in ((ids.astype("<u4") for ids in texts), (decoded(ids, words) for ids in texts))]
        return [pa.array([len(ids) for ids in texts], pa.int64()), *map(pa.array, made)]

    return encoded(docs.select("doc_id", "text"), ranks, pattern, digests, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})
