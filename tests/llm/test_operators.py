"""Operators against brute force on a small corpus with copies, odd texts, nulls and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pluviant.llm import components as C
from pluviant.llm import decontaminate as D
from pluviant.llm import dedup_suffix as S
from pluviant.llm import suffix_array as suffixes
from pluviant.llm import jaccard as J
from pluviant.llm import langid as L
from pluviant.llm import licenses as LI
from pluviant.llm import lm_score as LM
from pluviant.llm import mixing as M
from pluviant.llm import toxicity as X
from pluviant.llm._spark import labelled_texts
from pluviant.llm.dedup_exact import exact_dedup
from pluviant.llm.sharding import lookup_table, place
from pluviant.llm.suffix_array import common_prefixes, suffix_array

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def bag(rows):
    return Counter(repr(sorted(r.items())) for r in rows)


# Exact deduplication


def exact_by_hand(corpus):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, *_ in corpus]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    keep = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return [{"doc_id": i, "keep_id": keep[t], "group_size": len(groups[t]), "kept": i == keep[t], "text_sha256": hashlib.sha256(t.encode()).hexdigest()} for i, t in norm]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, clashing, corpus, weak):
    # With a hash of the length alone nearly all groups hold different texts.
    options = {"content_hash": lambda c: F.length(c).cast("string")} if weak else {}
    assert bag(dicts(exact_dedup(clashing if weak else docs, **options))) == bag(exact_by_hand(corpus))


# Sharding


def test_lookup_table_by_turns():
    table = lookup_table(["a", "b", "c"], 31)
    assert set(Counter(table).values()) <= {10, 11}
    moved = sum(x != y and y != 2 and x != 2 for x, y in zip(table, lookup_table(["a", "b"], 31), strict=True))
    assert moved <= 8  # few slots move between the shards that stay
    for names, size in (([], 7), (["a"], 8), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            lookup_table(names, size)


def test_place(docs, clashing, corpus, none):
    rows = dicts(place(docs, n_shards=5, table_size=101))
    assert bag([{k: v for k, v in r.items() if k not in ("slot", "shard")} for r in rows]) == bag(dicts(docs))
    table = lookup_table([f"shard-{k:05d}" for k in range(5)], 101)
    assert all(r["shard"] == table[r["slot"]] for r in rows)
    assert len({r["slot"] for r in rows if r["doc_id"] is None}) == 1
    assert place(clashing, n_shards=5, table_size=101).filter("shard between 0 and 4").count() == len(corpus)
    assert place(none).count() == 0


# Mixing


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= cap * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("block_len", [8, 64])
def test_mix_targets_and_limits(docs, clashing, corpus, block_len):
    got = dicts(M.mix_report(clashing if block_len == 8 else docs, block_len=block_len, n_shards=16))
    assert len(got) == len(corpus)
    assert bag(got) == bag(dicts(M.mix_report(docs, block_len=block_len, n_shards=16)))  # reruns agree
    sizes = {}
    for _, t, _, s, _ in corpus:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = targets_by_hand(sizes)
    by = {v: k for k, v in sizes.items()}
    taken = Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        s = by[r["source_size"]]
        assert r["target"] == pytest.approx(want[s])
        taken[s] += r["taken"]
    for s, n in want.items():
        assert abs(taken[s] - n) <= 1


def test_permutation_and_multinomial_counts(spark, docs):
    p = spark.range(37).select(M.permuted(F.col("id"), F.lit(37).cast("long"), F.lit("key"), 12).alias("p"))
    assert sorted(r.p for r in p.collect()) == list(range(37))
    mix = M.mix_sources(docs, block_len=4, n_shards=8)
    quota = {r.sid: r.quota for r in mix.targets.collect()}
    picks = mix.picks.collect()
    assert Counter(r.sid for r in picks) == Counter({k: v for k, v in quota.items() if v})
    assert all(sorted(r.k for r in picks if r.sid == s) == list(range(q)) for s, q in quota.items())
    per_shard = Counter(r.shard for r in picks)
    assert max(per_shard.values()) - min(per_shard.values()) <= 1


def test_mixed_documents_hold_the_words_taken(docs, corpus):
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    taken = {r.doc_id: r.taken for r in M.mix_report(unique, block_len=16).collect()}
    got = Counter()
    for r in M.mixed_documents(unique, block_len=16).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert all(got[k] == v for k, v in taken.items())


def test_mixed_documents_equal_the_report(spark, docs, monkeypatch):
    # Rows that repeat an id, or have none, and columns named like the operator's own; several tasks and buckets.
    for name, x in (("TASK_SLOTS", 7), ("TASK_ROWS", 1), ("GRID", 8), ("BUCKETS", 2)):
        monkeypatch.setattr(M, name, x)
    frame = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3)).select("*", *[F.lit(1).alias(c) for c in ("n", "cuts", "mix_size", "row", "turn", "whole", "spans")])
    taken = {(r.source, sum_) for r, sum_ in ((r, r.n_taken) for r in M.mix_report(frame).groupBy("source_size").agg(F.sum("taken").alias("n_taken")).withColumnRenamed("source_size", "source").collect())}
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    sizes = {r.source: r.n for r in frame.groupBy("source").agg(F.sum(F.coalesce(words, F.lit(0))).alias("n")).collect()}
    mixed = M.mixed_documents(frame)
    assert mixed.columns == frame.columns
    assert {(sizes[r.source], r.n) for r in mixed.groupBy("source").agg(F.sum(words).alias("n")).collect()} == taken


def test_mix_of_nothing(none, spark):
    assert M.mix_report(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in M.mix_report(blank).collect()] == [(0, 0.0, 0)] * 2


# N-gram Jaccard join


def sets_by_hand(corpus, size):
    out = []
    for _, t, *_ in corpus:
        w = WORD.findall(lower(t))
        out.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def components_by_hand(corpus, size, percent):
    sets = sets_by_hand(corpus, size)
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(sets)):
        groups.setdefault(find(k), []).append(corpus[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [{"doc_id": corpus[k][0], "n_shingles": len(s), "component_id": least[find(k)] if s else corpus[k][0]} for k, s in enumerate(sets)]


@pytest.mark.parametrize(("size", "percent", "blocks"), [(4, 85, {}), (2, 60, {"block_sets": 2, "block_tokens": 50}), (1, 25, {"block_sets": 5})])
def test_jaccard(docs, clashing, corpus, size, percent, blocks):
    got = dicts(J.jaccard_components(clashing if blocks else docs, size=size, percent=percent, **blocks))
    assert bag(got) == bag(components_by_hand(corpus, size, percent))


def test_classes_of_a_common_token_meet_by_bands_of_size(spark):
    rng = random.Random(5)
    rows = [(7, k, n, 400, n + rng.randint(-n // 8, n * 3 // 17)) for k in range(400) for n in [rng.choice([1, 2, 3, 20, 100, 117, 118, 2000])]] + [(8, 1, 5, 2, 5), (8, 2, 900, 2, 900)]
    got = J._in_bands(spark.createDataFrame(rows, "t long, cid long, n int, c long, most int"), 85, 10).collect()
    bands = {}
    for r in got:
        bands.setdefault((r.t, r.band), []).append(r)
    met = {(a.cid, b.cid) for (t, _), rs in bands.items() if t == 7 for a in rs for b in rs}
    assert {(a[1], b[1]) for a in rows[:400] for b in rows[:400] if a[2] <= b[4] and b[2] <= a[4]} <= met
    assert all(r.c == len(rs) for (t, _), rs in bands.items() if t == 7 for r in rs) and len(got) <= 802 and len(met) < 100_000
    assert [(r.band, r.c) for r in got if r.t == 8] == [(0, 2), (0, 2)]


def test_jaccard_of_sets_with_a_common_line(spark):
    rng = random.Random(9)
    line, corpus = [f"c{k}" for k in range(12)], []
    for k in range(60):
        own = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 4, 20, 80]))]
        corpus.append((2 * k, " ".join(own + line)))
        corpus.append((2 * k + 1, " ".join(own[:-1] + line + [f"x{k}"] * rng.randint(0, 2))))
    got = J.jaccard_components(spark.createDataFrame(corpus, "doc_id long, text string"), size=2, percent=70, block_sets=3, block_tokens=40)
    assert bag(dicts(got)) == bag(components_by_hand(corpus, 2, 70))


def test_few_but_wanted_rows_are_left(spark):
    docs = spark.range(3000).selectExpr("case when id % 500 = 7 then null else struct(id, 'k' as k) end as id", "cast(id as string) as text")
    got = [r.id and r.id.id for r in J._likely(docs, docs.filter("text % 100 = 7").selectExpr("id as wanted").distinct()).collect()]
    assert {k if k % 500 != 7 else None for k in range(7, 3000, 100)} <= set(got) and got.count(None) == 6 and len(got) < 60


def test_jaccard_of_a_part_and_its_whole(spark):
    words = [f"w{k}" for k in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:30])), (3, " ".join(words[:20]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in J.jaccard_components(docs, size=1, percent=25).collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.doc_id: r.component_id for r in J.jaccard_components(docs, size=1, percent=30).collect()} == {1: 1, 2: 1, 3: 1}
    assert {r.doc_id: r.component_id for r in J.jaccard_components(docs, size=1, percent=70).collect()} == {1: 1, 2: 2, 3: 3}


def test_jaccard_keeps_one_of_each(docs, corpus, none):
    kept = [r.doc_id for r in J.one_of_each(docs).collect()]
    want = {r["component_id"] for r in components_by_hand(corpus, 4, 85) if r["component_id"] is not None}
    assert {k for k in kept if k is not None} == want
    assert J.jaccard_components(none).count() == 0


def test_prefix_tree_links_all_similar_sets():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(6)]
    sets = {}
    for _ in range(60):
        s = base[rng.integers(6)]
        s = np.setdiff1d(np.union1d(s, rng.integers(0, 60, rng.integers(0, 4)).astype(np.uint64)), rng.choice(s, rng.integers(0, 4)))
        sets[s.tobytes()] = s
    sets = list(sets.values())
    root = J.link(sets, 80)
    g = {k: k for k in range(len(sets))}
    for a in range(len(sets)):
        for b in range(a):
            i = len(np.intersect1d(sets[a], sets[b]))
            if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                x, y = g[a], g[b]
                g = {k: y if v == x else v for k, v in g.items()}
    assert {frozenset(np.flatnonzero(root == r).tolist()) for r in set(root.tolist())} == {frozenset(k for k, v in g.items() if v == r) for r in set(g.values())}


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(30)] + [(100 + rng.randint(0, 20), 100 + rng.randint(0, 20)) for _ in range(15)] + [(500, k) for k in range(501, 540)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[k] for k in range(31)} == {0} and {got[k] for k in range(500, 540)} == {500}
    for a, b in edges:
        assert a == b or got[a] == got[b]
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Suffix arrays


@pytest.mark.parametrize("symbols", [1, 2, 4, 200])
def test_suffix_array_and_prefixes(symbols):
    rng = np.random.default_rng(symbols)
    for n in (1, 2, 3, 17, 90, 400):
        s = np.append(rng.integers(1, symbols + 1, n), 0).astype(np.int32)
        sa = suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda k: s[k:].tolist())
        shared = common_prefixes(s, sa)
        for a, b in zip(sa[1:], sa[:-1], strict=True):
            x, y = s[a:].tolist(), s[b:].tolist()
            assert shared[a] == next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def repeats_by_hand(corpus, length):
    data = [(t or "").encode() for _, t, *_ in corpus]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for (i, *_), b in zip(corpus, data, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append({"doc_id": i, "n_bytes": len(b), "n_removed": len(b) - len(kept), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest()})
    return out


@pytest.mark.parametrize("limit", [S.GROUP_BYTES, 300])
def test_repeats(docs, clashing, corpus, limit):
    # With the low limit most groups are dealt anew, twice.
    got = dicts(S.repeats_digest(docs if limit > 1000 else clashing, group_bytes=limit))
    assert bag(got) == bag(repeats_by_hand(corpus, 200))


def test_repeats_of_equal_rows_make_a_segment_each(spark, monkeypatch):
    rng = random.Random(3)
    text = prose(rng, 60)
    docs = spark.createDataFrame([(None, text)] * 150 + [(None, prose(rng, 60)), (1, text)], "doc_id long, text string")
    kept = []
    write = S.stored
    monkeypatch.setattr(S, "stored", lambda df: kept.append(write(df)) or kept[-1])
    monkeypatch.setattr(S, "dropped", lambda df: None)
    got = S.repeats_digest(docs).collect()
    assert sorted(r.n_removed for r in got) == [0] + [len(text.encode())] * 151
    segments = next(t for t in kept if "seg" in t.columns and "at" in t.columns)
    assert segments.count() == 151 * segments.select("at").distinct().count()


def test_suffix_arrays_agree_whether_the_recursion_goes_on_or_ends():
    rng = np.random.default_rng(5)
    for n in (40, 3000):
        for symbols in (2, 5):
            s = np.append(np.tile(rng.integers(1, symbols + 1, n), 3), 0).astype(np.uint16)
            s[n // 2] = symbols + 1
            want = sorted(range(len(s)), key=lambda k: s[k:].astype(">u2").tobytes())
            for base in (0, 1 << 17):
                suffixes.BASE, was = base, suffixes.BASE
                assert suffix_array(s).tolist() == want
                suffixes.BASE = was


def test_repeats_keep_text(docs, corpus, none):
    for r in S.repeats(docs, length=64).collect():
        assert len(r.kept) == r.n_bytes - r.n_removed
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    assert S.repeats_digest(none).count() == 0


# Decontamination


def contamination_by_hand(corpus, items, n=10):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update({str(i)} - {"None"})
    out = []
    for i, t, *_ in corpus:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append({"doc_id": i, "n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": digest, "contaminated": bool(hit)})
    return out


@pytest.fixture(scope="session")
def items(corpus):
    whole = corpus[-5][1].split()
    return [(1, " ".join(corpus[4][1].split()[:40])), (2, "X"), (30, " ".join(whole[100:130]).upper()), (4, None), (5, "..."), (6, " ".join(whole[105:117])), (7, "a b C"), (8, "be " * 12), (None, "é")]


def test_contamination(spark, docs, clashing, corpus, items, none, monkeypatch):
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = contamination_by_hand(corpus, items)
    assert bag(dicts(D.decontamination_digest(docs, frame))) == bag(want)
    assert D.decontamination_digest(none, frame).count() == 0
    assert not any(r.contaminated for r in D.decontamination_digest(docs, frame.limit(0)).collect())
    clean = Counter(r["doc_id"] for r in want if not r["contaminated"])
    dirty = {r["doc_id"] for r in want if r["contaminated"]}
    assert {r.doc_id for r in D.clean(clashing, frame).collect()} == set(clean) - dirty
    monkeypatch.setattr(D, "BLOCK_WORDS", 30)  # several blocks of items; rows that repeat an id are merged
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    by = {r["doc_id"]: r for r in want}
    assert bag(dicts(D.decontamination_digest(unique, frame))) == bag([by[r.doc_id] for r in unique.select("doc_id").collect()])


def test_contamination_in_blocks_keeps_rows(spark, docs, corpus, items, monkeypatch):
    more = [(None, "be " * 12 + "a b", None, None, 0), (None, "c d " * 7, None, None, 0), (0, "be " * 14, None, None, 0)]
    every = docs.unionByName(spark.createDataFrame(more, docs.schema))
    frame = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_WORDS", 30)
    assert len(D.query_blocks(frame, "item_id", "text", 10)) > 1
    assert bag(dicts(D.decontamination_digest(every, frame))) == bag(contamination_by_hand(corpus + more, items))


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha beta " + "z " * 30 + "gamma")], "doc_id long, text string")
    q = D.make_queries([(r.item, r.terms) for r in D.item_words(spark.createDataFrame([(9, "alpha beta gamma")], "i long, text string"), "i", "text").collect()], 10)
    index = D.build_index(docs, q.terms)
    assert {r.id for r in D.near(index, q, 2).collect()} == {"1", "2"}
    assert {r.id for r in D.search(index, q).filter("size(hits) > 0").collect()} == set()


# Language and toxicity


def test_language_held_out(spark, none):
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randint(15, 90), lang), lang) for k in range(240) for lang in [("en", "fr", "de")[k % 3]]]
    odd = [(900, None, "en"), (901, "123 ... 456", "fr"), (902, "", None), (903, "the thing wher only", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.language_report(docs).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].held_out for i, _ in held)
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)
    assert [(got[k].lang_pred, got[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in L.keep_identified(docs).collect()}.isdisjoint({900, 901, 902})
    assert L.language_report(none).count() == 0
    unlabelled = L.language_report(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_texts_of_no_language_go_and_short_ones_stay(spark):
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.choice([3, 20, 60]), lang), lang) for k in range(360) for lang in [("en", "fr", "de")[k % 3]]]
    other = random.Random(4)
    foreign = lambda n: " ".join("".join(other.choice(["pyk", "zo", "jux", "vaz", "kkoj"]) for _ in range(3)) for _ in range(n))
    junk = ["4d5f6a7b8c9d0e1f2a3b4c5d6e7f8091a2b3c4d5e6f70819" * 3, "SGVsbG8gV29ybGQhIFRoaXMgaXMgYSBiYXNlNjQgc3RyaW5nIHdpdGggc29tZQ" * 2, foreign(30), foreign(50), None, "12 !!"]
    # Ids repeat and extra columns clash with names that the stage uses.
    frame = spark.createDataFrame(rows + [(5, t, None) for t in junk] + [(None, rows[0][1], None)], "doc_id long, text string, lang string").withColumn("id", F.lit("x")).withColumn("label", F.lit(1))
    kept = [r.text for r in L.keep_identified(frame).collect()]
    assert not set(kept) & set(junk)
    assert len(kept) >= len(rows) - 3 and kept.count(rows[0][1]) == 2


@pytest.mark.parametrize("per_label", [5, 1000])
def test_labelled_texts_are_bounded_and_whole(spark, per_label):
    rows = [(k % 400, f"text {k % 400} {k % 2}" + " x" * (3000 if k == 7 else 1), "ab"[k % 400 < 300]) for k in range(800)] + [(None, "none", "a"), (1, None, "a"), (2, "t", None)]
    docs = spark.createDataFrame(rows, "id long, text string, label string")
    got = labelled_texts(docs.select("id", "label"), docs, per_label)
    assert Counter(label for label, _, _ in got) == ({"a": 5, "b": 5} if per_label == 5 else {"a": 100, "b": 300})
    texts = {(i, label): max(t for j, t, x in rows if (j, x) == (i, label) and t) for i, t, label in rows if i is not None and label and t}
    assert {t for _, _, t in got} <= set(texts.values())
    assert per_label == 5 or {t for _, _, t in got} == set(texts.values())


def test_language_tables_equal_convolution():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 110, 300).astype(np.uint8)) for _ in range(8)] + [bytes(rng.integers(110, 122, 300).astype(np.uint8)) for _ in range(8)]
    net = L.train(texts, ["a"] * 8 + ["b"] * 8, steps=20)
    x, _ = L.windows_of(np.frombuffer(texts[0], np.uint8), np.array([0, 300]))
    pooled = []
    for f in net.filters:
        e = net.embed[x]
        pooled.append(sum(e[:, j : L.WINDOW - len(f) + 1 + j] @ f[j] for j in range(len(f))).max(axis=1))
    z = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.out + net.out_bias
    q = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(L.probabilities(net, L.tables(net), x), q, atol=1e-4)


def test_toxicity_held_out(spark, none):
    rng = random.Random(11)
    bad = ["idiot", "scumbag", "moron"]
    rows, labels = [], []
    for k in range(400):
        words = prose(rng, rng.randint(8, 60)).split()
        toxic = k % 3 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(1000, None), (1001, "  "), (1002, "you id-iot you")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in X.toxicity_report(docs, marks).collect()}
    held = [(k, t) for k, t in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out for k, _ in held)
    assert sum(got[k].predicted == t for k, t in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())
    assert got[1000].score == 0 and got[1001].score == 0 and got[1002].score > 0.5
    assert X.toxicity_report(none, marks).count() == 0
    assert {r.score for r in X.toxicity_report(docs, marks.limit(0)).collect()} == {0.0}


def test_toxicity_learns_from_flipped_labels():
    rng = random.Random(12)
    bad = ["idiot", "scumbag", "moron"]
    texts = [f"{prose(rng, rng.randint(4, 30))} {bad[k // 3 % 3] if k % 3 == 0 else ''} {prose(rng, rng.randint(4, 30))}" for k in range(600)]
    truth = np.array([k % 3 == 0 for k in range(600)])
    labels = truth.copy()
    labels[::25] = ~labels[::25]  # 4 per cent, each insult among them in texts labelled clean
    assert all(any(w in t.split() for t, y in zip(texts[:400], labels, strict=False) if not y) for w in bad)
    m = X.train([t.encode() for t in texts[:400]], labels[:400])
    top = np.array([X.margins(X.strings(np.frombuffer(f" {t} ".encode(), np.uint8)), m.weights).max() + m.bias for t in texts[400:]])
    found = 1 / (1 + np.exp(-(m.slope * top + m.offset))) >= 0.7
    assert (found == truth[400:]).mean() >= 0.95


def test_joined_strings():
    def by_hand(text):
        words = text.lower().split(" ")
        letters = [re.sub("[^a-z]", "", w) for w in words]
        out = [re.sub("[^a-z]", "", w) for w in words if re.search("[a-z][^a-z]+[a-z]", w)]
        k = 0
        while k < len(words):
            m = k
            while m < len(words) and len(letters[m]) == 1:
                m += 1
            if m - k > 2:
                out.append("".join(letters[k:m]))
            k = max(m, k + 1)
        both = zip(words[:-1], letters[:-1], words[1:], letters[1:], strict=True)
        return Counter(out + [x + y for a, x, b, y in both if a and b and 0 < len(x) <= 3 and 0 < len(y) <= 3 and not len(x) == len(y) == 1])

    rng = random.Random(6)
    for n in (0, 1, 2, 3, 5, 30, 30, 30):
        text = " ".join(rng.choice(["i", "d.", "a", "mo", "ron", "word", "id--i..ot", "--", "", "3", "4x4", "clown"]) for _ in range(n))
        data = np.frombuffer(f" {text} ".encode(), np.uint8)
        strings, at = X.joined(data)
        found = bytes(strings).decode().split()
        assert Counter(found) == by_hand(text)
        assert len(at) == len(found) and all(data[k] == 32 for k in at)


def test_spelt_and_filled_insults(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for k in range(300):
        words = prose(rng, rng.randint(8, 40)).split()
        if k % 3 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scumbag", "moron"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 3 == 0)))
    clean = prose(rng, 20)
    bad = ["i d i o t", "i--d--i--o--t", "mo ron", "m.o.r.o.n", "s c u m b a g"]
    docs = spark.createDataFrame(rows + [(1000 + k, f"{clean} {w} {clean}") for k, w in enumerate(bad)] + [(2000, clean), (2000, clean), (None, bad[0])], "doc_id long, text string").withColumn("label", F.lit(0)).withColumn("id", F.lit(1))
    got = X.toxicity_report(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    scores = {r.doc_id: r.score for r in got}
    assert all(scores[1000 + k] > 0.5 for k in range(len(bad))) and scores[2000] < 0.5
    assert len(got) == docs.count() and all(r.held_out is not None for r in got)


def test_kernel_by_hand():
    def features(word):
        s, out = f" {word} ", Counter()
        for k in range(len(s)):
            for steps in X.STEPS:
                if k + steps[2] < len(s):
                    out[s[k] + "".join(s[k + d] for d in steps)] += X.DECAY ** (steps[2] + 1)
        return out

    words = ["idiot", "id-iot", "idot", "moron", "ab"]
    norm = lambda w: X.longest_norm(np.array([len(w) + 2]))[0]
    want = [[sum(v * features(a)[x] for x, v in features(b).items()) / norm(a) / norm(b) for a in words] for b in words]
    assert np.allclose(X.kernel([w.encode() for w in words], [w.encode() for w in words]), want, rtol=1e-5)


def test_string_kernel_tolerates_gaps():
    k = X.kernel([b"idiot"], [b"idiot", b"idi-ot", b"i.d.i.o.t", b"table"])[:, 0]
    assert k[0] > k[1] > k[3] and k[2] > k[3]
    assert k[0] == pytest.approx(1)


# Licences and language models


def test_licenses(spark, none):
    mit = " ".join(s[0].capitalize() + "." for s in (LI.SENTENCES[k] for k in ("MitGrant", "MitNotice", "AsIs", "NoLiability")))
    rows = [(1, f"Some text.\n{mit}\nMore."), (2, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."), (3, "I like the MIT License."), (4, None), (5, ""), (6, "THE ABOVE COPYRIGHT NOTICE AND THIS PERMISSION NOTICE SHALL BE INCLUDED IN ALL COPIES OR SUBSTANTIAL PORTIONS OF THE SOFTWARE")]
    got = {r.doc_id: (r.licenses, r.n_sentences, r.n_unmatched) for r in LI.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 4, 0), 2: ("Apache-2.0,MIT", 2, 0), 3: ("", 0, 0), 4: ("", 0, 0), 5: ("", 0, 0), 6: ("", 1, 1)}
    assert LI.scan_licenses(none).count() == 0


MIT_TEXT = """The MIT License (MIT)

Copyright (c) 2020 Example Inc.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def test_licenses_of_wrapped_texts(spark):
    want = {"MIT": (MIT_TEXT, 4), "BSD-2-Clause": (BSD_TEXT, 3), "BSD-3-Clause": (BSD_TEXT + BSD_ENDORSE, 4), "GPL-3.0-or-later": (GPL_TEXT, 3), "Apache-2.0": (APACHE_TEXT, 3), "MPL-2.0": (MPL_TEXT, 1), "ISC": (ISC_TEXT, 1)}
    want["GPL-2.0-or-later"] = (GPL_TEXT.replace("software: you", "software; you").replace("version 3", "version 2"), 3)
    marks = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: " ".join(t.split()), *(lambda t, m=m: "".join(f"{m}{line}\n" for line in t.splitlines()) for m in ("# ", " * ", "// ", "dnl "))]
    rows = [(f"{name} {k}", mark(text)) for name, (text, _) in want.items() for k, mark in enumerate(marks)]
    # Sentences that only begin or end like known ones are not known; runs of breaks and bars take no time.
    odd = [("odd 0", "I was told that permission to use, copy\n" + ISC_TEXT[25:]), ("odd 1", APACHE_TEXT.splitlines()[1].rstrip(".") + " or not"), ("odd 2", ". " * 50_000 + "|" * 50_000 + "." * 50_000)]
    got = {r.doc_id: (r.licenses, r.n_sentences, r.n_unmatched) for r in LI.scan_licenses(spark.createDataFrame(rows + odd, "doc_id string, text string")).collect()}
    assert got == {f"{name} {k}": (name, n, 0) for name, (_, n) in want.items() for k in range(len(marks))} | {f"odd {k}": ("", 0, 0) for k in range(3)}


def lm_by_hand(corpus, order, least, own):
    texts = [WORD.findall(lower(t)) for _, t, *_ in corpus]
    count = lambda w: Counter(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))
    every = sum(map(count, texts), Counter())
    total, out = max(1, sum(map(len, texts))), []
    for (i, *_), w in zip(corpus, texts, strict=True):
        mine = Counter() if own else count(w)
        p, back = 0.0, 0
        for k in range(len(w)):
            could = min(k + 1, order)
            grams = {n: tuple(w[k - n + 1 : k + 1]) for n in range(1, could + 1)}
            n = next((n for n in range(could, 1, -1) if every[grams[n]] - mine[grams[n]] >= least), 1)
            before = grams[n][:-1]
            share = (every[grams[n]] - mine[grams[n]]) / (every[before] - mine[before]) if n > 1 else every[grams[1]] / total
            p += np.log(share) + np.log(0.4) * (could - n)
            back += n < could
        out.append((str(i), len(w), back, round(p, 5)))
    return sorted(out)


@pytest.mark.parametrize(("order", "least", "own", "buckets"), [(2, 2, True, 3), (3, 1, False, None), (3, 2, True, 2), (5, 1, False, 3), (4, 1, True, 1), (1, 2, False, 2)])
def test_lm_scores(docs, clashing, corpus, none, order, least, own, buckets):
    source = clashing if order == 1 else docs
    got = sorted((str(r.doc_id), r.n_tokens, r.n_backoff, round(r.log_prob, 5)) for r in LM.lm_scores(source, order=order, least=least, own=own, buckets=buckets).collect())
    want = lm_by_hand(corpus, order, least, own)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-4)
    assert LM.lm_scores(none).count() == 0


def test_lm_scores_of_equal_rows(spark):
    rows = [(None, "one row again and again")] * 300 + [(1, "a row of its own"), (2, "again and again and again")]
    source = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_backoff, round(r.log_prob, 4)) for r in LM.lm_scores(source, buckets=4).collect())
    assert got == [(i, n, back, round(p, 4)) for i, n, back, p in lm_by_hand([(i, t) for i, t in rows], 3, 1, False)]


def test_gate_limit_is_of_all_held_out_texts(spark, monkeypatch):
    from pluviant.llm import _spark

    words = ["the cat sat on the mat", "der hund lief in den wald", "q7 zx 0f 9b 1c", "le chat dort ici"]
    rows = [(k, f"{words[k % 4]} {k * k % 97} {words[(k // 7) % 4]}", "en" if k % 2 else "de") for k in range(400)]
    docs = spark.createDataFrame([*rows, (400, None, "en"), (401, "12", "en"), (402, "a text", None)], "doc_id long, text string, lang string").repartition(3)
    net = L.train([t.encode() for _, t, _ in rows[:60]] + [b"0f 1b 9c 7d"] * 20, [x for _, _, x in rows[:60]] + [L.NO_LANGUAGE] * 20, steps=30)
    like = np.sort(np.concatenate([m[:, net.labels.index(L.NO_LANGUAGE)] for _, m in L.means(net, L.tables(net), pa.array([t for _, t, _ in rows]))]))
    for loss in (0.001, 0.1, 0.4, 0.99):
        assert L.limit_of(docs, net, "text", "lang", loss) == pytest.approx(max(0.5, like[int(len(like) * (1 - loss))]), rel=1e-9)
    values = spark.createDataFrame([(v / 7, 1 + v % 3) for v in range(30_000)], "v double, c long")
    each = np.repeat(np.arange(30_000) / 7, 1 + np.arange(30_000) % 3)
    assert [_spark.nth_value(values, k) for k in (0, 31_234, len(each) - 1)] == [each[0], each[31_234], each[-1]]
    seen = []
    monkeypatch.setattr(L, "limit_of", lambda docs, *a: seen.append(docs.count()) or 0.5)
    L.fit_gate(docs, "doc_id", "text", "lang", per_label=2)
    assert seen == [docs.filter(L.held_out()).count()]
