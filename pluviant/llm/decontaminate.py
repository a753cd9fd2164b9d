"""Benchmark decontamination through a document-partitioned positional inverted index.

`build_index` turns documents into index segments: for each term of the test items, the places where it stands. A
segment covers a few megabytes of whole documents and can be stored as a table. `search` intersects, segment by segment,
the offset-adjusted lists of each test window, from the term that is rarest there to the commonest, and so finds exact
phrases; `near` also gives loose matches, where all terms stand close to an occurrence of the rarest one.

Words are compared by 64-bit hashes. No row is shuffled, whatever the source or the number of copies of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import ALNUM, U, Words, text_chunks, words

#: Words of test items that one block of queries may hold; more items are searched in several blocks.
BLOCK_WORDS = 200_000

SEGMENTS = "ids array<string>, word_at array<int>, term_at array<int>, places array<int>"
FOUND = "id string, n_words long, hits array<struct<first:int,stop:int>>, items array<string>"


class Queries(NamedTuple):
    """Distinct windows of test items: terms (sorted hashes), rows of term numbers by length, and the items of each."""

    terms: np.ndarray
    groups: list[tuple[np.ndarray, list[list[str]]]]


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, terms: hashes of each item's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                w = words(chunk, ALNUM)
                n = len(chunk.offsets) - 1
                at = np.searchsorted(w.doc, np.arange(n + 1)).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(at), pa.array(w.hash.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, n), terms], ["item", "terms"])

    return items.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "item string, terms array<long>")


def make_queries(rows: list[tuple[str | None, list[int]]], n: int) -> Queries:
    """Windows of n consecutive words; an item of fewer words, but not none, is one window."""
    known: dict[bytes, tuple[np.ndarray, set[str]]] = {}
    for item, terms in rows:
        t = np.array(terms, np.int64).view(U)
        for k in range(max(1, len(t) - n + 1) if len(t) else 0):
            w = t[k : k + n]
            known.setdefault(w.tobytes(), (w, set()))[1].update(() if item is None else (str(item),))
    terms = np.unique(np.concatenate([w for w, _ in known.values()])) if known else np.zeros(0, U)
    by: dict[int, list] = {}
    for w, items in known.values():
        by.setdefault(len(w), []).append((np.searchsorted(terms, w), sorted(items)))
    return Queries(terms, [(np.stack([w for w, _ in g]), [i for _, i in g]) for _, g in sorted(by.items())])


def query_blocks(items: DataFrame, id_col: str, text_col: str, n: int) -> list[Queries]:
    """The windows of all items, in blocks of at most about BLOCK_WORDS words (or one longer item)."""
    rows = item_words(items, id_col, text_col).filter(F.size("terms") > 0)
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS) or 1
    if blocks == 1:
        return [make_queries([tuple(r) for r in rows.collect()], n)]
    of = F.pmod(F.xxhash64("item"), F.lit(blocks))
    return [make_queries([tuple(r) for r in rows.filter(of == k).collect()], n) for k in range(blocks)]


def segment(w: Words, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term (term_at) the words' places, ascending."""
    if len(terms):
        number = np.searchsorted(terms, w.hash)
        number[number == len(terms)] = 0
        place = np.flatnonzero(terms[number] == w.hash).astype(np.int32)
        number = number[place].astype(np.uint16 if len(terms) < 1 << 16 else np.int32)
    else:
        place = number = np.zeros(0, np.int32)
    order = np.argsort(number, kind="stable")
    return np.searchsorted(number[order], np.arange(len(terms) + 1)).astype(np.int32), place[order]


def build_index(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments: document ids, the first word of each, and for each term (term_at) the words' places, ascending."""
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                w = words(chunk, ALNUM)
                n = len(chunk.offsets) - 1
                word_at = np.searchsorted(w.doc, np.arange(n + 1)).astype(np.int32)
                lists = [pa.array(x) for x in (word_at, *segment(w, known.value))]
                ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0).slice(chunk.first, n))
                yield pa.RecordBatch.from_arrays([ids, *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)], ["ids", "word_at", "term_at", "places"])

    return docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, SEGMENTS)


def _lists(batch: pa.RecordBatch, row: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    get = lambda k: batch.column(k)[row].values
    return get(0).to_pylist(), *(get(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3))


def phrases(windows: np.ndarray, term_at: np.ndarray, places: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each occurrence in a segment: the window's row and the first word's place (documents not yet regarded)."""
    length = windows.shape[1]
    sizes = np.diff(term_at)[windows]
    some = np.flatnonzero(sizes.min(axis=1) > 0) if len(windows) else np.zeros(0, np.int64)
    none = np.zeros(0, np.int64)
    if not len(some):
        return none, none
    order = np.argsort(sizes[some], axis=1, kind="stable")
    rare = windows[some, order[:, 0]]
    n = sizes[some, order[:, 0]]
    row = np.repeat(np.arange(len(some)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = places[term_at[rare][row] + nth] - order[row, 0]
    ok = (start >= 0) & (start + length <= n_words)
    row, start = row[ok], start[ok]
    stride = n_words + 1
    keys = np.repeat(np.arange(len(term_at) - 1), np.diff(term_at)) * stride + places
    for k in range(1, length):
        if not len(row):
            break
        off = order[row, k]
        key = windows[some[row], off] * stride + start + off
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        ok = keys[at] == key
        row, start = row[ok], start[ok]
    return some[row], start


def count_hits(groups: list, word_at: np.ndarray, term_at: np.ndarray, places: np.ndarray, hit: np.ndarray, items: list[set[str]]) -> None:
    """Add a block's occurrences in a segment: to `hit` one where each begins and minus one where it ends, to `items` whose they are."""
    for windows, names in groups:
        length = windows.shape[1]
        row, start = phrases(windows, term_at, places, int(word_at[-1]))
        doc = np.searchsorted(word_at, start, "right") - 1
        ok = start + length <= word_at[doc + 1]
        row, start, doc = row[ok], start[ok], doc[ok]
        np.add.at(hit, start, 1)
        np.add.at(hit, start + length, -1)
        for d, k in set(zip(doc.tolist(), row.tolist(), strict=True)):
            items[d].update(names[k])


def spans_of(word_at: np.ndarray, hit: np.ndarray) -> list[list[dict]]:
    """Of each document in a segment: merged spans of its hit words."""
    spans: list[list[dict]] = [[] for _ in word_at[1:]]
    on = np.cumsum(hit)[:-1] > 0
    edge = np.zeros(len(on), bool)
    edge[word_at[:-1][word_at[:-1] < len(on)]] = True
    before = np.concatenate([[False], on[:-1]])
    first = np.flatnonzero(on & (~before | edge))
    after, edge_next = np.concatenate([on[1:], [False]]), np.concatenate([edge[1:], [True]])
    stop = np.flatnonzero(on & (~after | edge_next)) + 1
    doc = np.searchsorted(word_at, first, "right") - 1
    for d, a, b in zip(doc.tolist(), first.tolist(), stop.tolist(), strict=True):
        spans[d].append({"first": a - int(word_at[d]), "stop": b - int(word_at[d])})
    return spans


def _found(ids: pa.Array, word_at: np.ndarray, hit: np.ndarray, items: list[set[str]]) -> pa.RecordBatch:
    spans = pa.array(spans_of(word_at, hit), pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())])))
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(word_at)), spans, pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["id", "n_words", "hits", "items"])


def search(index: DataFrame, queries: Queries) -> DataFrame:
    """FOUND rows, one a document: number of words, merged spans of hit words, items with an occurring window."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, word_at, term_at, places = _lists(batch, r)
                items: list[set[str]] = [set() for _ in ids]
                hit = np.zeros(word_at[-1] + 1, np.int32)
                count_hits(shared.value.groups, word_at, term_at, places, hit, items)
                yield _found(pa.array(ids, pa.string()), word_at, hit, items)

    return index.mapInArrow(run, FOUND)


def search_texts(column: pa.Array, blocks: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[set[str]]]]:
    """Of each run of texts, by the broadcast blocks of queries: its first row, word_at, `hit` and `items` of all blocks."""
    for chunk in text_chunks(column):
        w = words(chunk, ALNUM)
        word_at = np.searchsorted(w.doc, np.arange(len(chunk.offsets))).astype(np.int64)
        hit, items = np.zeros(word_at[-1] + 1, np.int32), [set() for _ in word_at[1:]]
        for shared in blocks:
            term_at, places = segment(w, shared.value.terms)
            count_hits(shared.value.groups, word_at, term_at.astype(np.int64), places.astype(np.int64), hit, items)
        yield chunk.first, word_at, hit, items


def near(index: DataFrame, queries: Queries, slop: int) -> DataFrame:
    """id, item, place: occurrences of a window's rarest term that have all its other terms at most length - 1 + slop
    words away in the same document, in any order."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, word_at, term_at, places = _lists(batch, r)
                out: set[tuple] = set()
                for windows, names in shared.value.groups:
                    reach = windows.shape[1] - 1 + slop
                    for w, who in zip(windows, names, strict=True):
                        lists = sorted((places[term_at[t] : term_at[t + 1]] for t in set(w.tolist())), key=len)
                        at = lists[0]
                        doc = np.searchsorted(word_at, at, "right") - 1
                        for other in lists[1:]:
                            lo = np.maximum(at - reach, word_at[doc])
                            hi = np.minimum(at + reach + 1, word_at[doc + 1])
                            ok = np.searchsorted(other, hi) > np.searchsorted(other, lo)
                            at, doc = at[ok], doc[ok]
                        out.update((ids[d], i, p - int(word_at[d])) for d, p in zip(doc.tolist(), at.tolist(), strict=True) for i in who)
                cols = list(zip(*sorted(out, key=str), strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], ["id", "item", "place"])

    return index.mapInArrow(run, "id string, item string, place int")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """One row a document: id, n_words, hits (merged word spans inside occurrences of windows), items (with occurring
    windows, as strings, sorted).

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. Null and empty texts have no
    words and no hits; items without words have no window, and words of those without id are hit but
    are no item's; without items nothing is hit. Rows that repeat an id
    are documents of their own, however many blocks of queries there are. An empty table gives none.
    """
    kind = docs.schema[id_col].dataType
    blocks = [docs.sparkSession.sparkContext.broadcast(q) for q in query_blocks(items, item_col, item_text, n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, word_at, hit, names in search_texts(batch.column(1), blocks):
                yield _found(batch.column(0).slice(first, len(names)), word_at, hit, names)

    return docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, FOUND).withColumn("id", F.col("id").cast(kind))


def decontamination_digest(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The registered form: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    c = contamination(docs, items, id_col, **options)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["first"])
    return c.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: float = 0.0, item_col: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """`docs` without those of whose words more than the share `most` is hit, decided for each row by its own text."""
    blocks = [docs.sparkSession.sparkContext.broadcast(q) for q in query_blocks(items, item_col, item_text, n)]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = np.ones(len(batch), bool)
            for first, word_at, hit, _ in search_texts(batch.column(at), blocks):
                on = np.concatenate([[0], np.cumsum(np.cumsum(hit)[:-1] > 0)])
                stays[first : first + len(word_at) - 1] = np.diff(on[word_at]) <= most * np.diff(word_at)
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
