"""The pipeline's stages against brute force on their own inputs."""

import random
from collections import Counter

import pytest

import corpus_pipeline as P
from pluviant.llm.sharding import lookup_table
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_operators import WORD, components_by_hand, contamination_by_hand


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(3)
    langs = ["en", "fr", "de"]
    rows = [(k, prose(rng, rng.randint(30, 120), langs[k % 3]), langs[k % 3], f"s{k % 4}" if k % 5 else None, 0) for k in range(90)]
    passage = prose(rng, 30)
    rows += [(100 + k, rows[k][1], "en", "s1", 0) for k in range(5)]
    rows += [(200, rows[0][1] + " " + passage, "en", "s1", 0), (201, None, None, None, None), (202, "123 !!!", "en", "s2", 7), (203, "", "fr", "s2", 0)]
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, passage


def test_stages(spark, sf_dir):
    folder, passage = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns

    def step(k, docs):
        out = P.STAGES[k][1](spark, docs, folder).cache()
        assert k == len(P.STAGES) - 1 or out.columns == columns
        return out

    found = step(0, docs)
    kept = {r.doc_id for r in found.collect()}
    assert kept.isdisjoint({201, 202, 203}) and len(kept) >= 94

    one = step(1, found)
    rows = [(i, before[i].text) for i in sorted(kept)]
    want = {r["component_id"] for r in components_by_hand(rows, 5, 80)}
    assert {r.doc_id for r in one.collect()} == want and want.isdisjoint(range(100, 105))

    clean = step(2, one)
    rows = [(i, before[i].text) for i in sorted(want)]
    dirty = {r["doc_id"] for r in contamination_by_hand(rows, [(7, passage)]) if r["contaminated"]}
    assert dirty == {200} & want
    assert {r.doc_id for r in clean.collect()} == want - dirty

    mixed = step(3, clean)
    words = Counter()
    for r in mixed.collect():
        n = len(WORD.findall(r.text))
        whole = WORD.findall(before[r.doc_id].text)
        assert 0 < n <= len(whole) and set(WORD.findall(r.text)) <= set(whole)
        assert n < len(whole) or r.text == before[r.doc_id].text
        words[r.doc_id] += n
    total = sum(len(WORD.findall(before[i].text)) for i in want - dirty)
    assert abs(sum(words.values()) - 1.5 * total) <= 5

    placed = step(4, mixed)
    table = lookup_table([f"shard-{k:05d}" for k in range(128)], 16381)
    rows = placed.collect()
    assert len(rows) == mixed.count() and all(r.shard == table[r.slot] for r in rows)


def test_run_equals_the_stages(spark, sf_dir):
    rows = P.run(spark, sf_dir[0]).collect()
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir[0])
    assert Counter(rows) == Counter(docs.collect())
    assert {"doc_id", "shard", "slot"} <= set(rows[0].asDict())


def test_stages_tell_rows_of_the_same_id_apart(spark):
    rng = random.Random(9)
    item = prose(rng, 20)
    texts = [prose(rng, rng.randint(40, 90), ["en", "fr", "de"][k % 3]) for k in range(60)]
    key = lambda k: (None, 7, 100 + k)[k // 3 % 3]
    rows = [(key(k), t, ["en", "fr", "de"][k % 3], f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    gone = [(None, "12 !!", "en", "s1", 5), (7, None, None, "s1", 0)]
    dirty = [(None, f"{texts[0]} {item}", "en", "s1", 0), (7, f"{texts[1]} {item}", "fr", "s1", 0)]
    frame = lambda x: spark.createDataFrame(x, SCHEMA).repartition(3)
    assert Counter(map(tuple, P.language(spark, frame(rows + gone), "").collect())) == Counter(rows)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert Counter(map(tuple, P.clean(frame(rows + dirty), items).collect())) == Counter(rows)
    # Copies of rows without an id go, and so does one with the id of another text.
    copies = [(None, texts[2], "de", "s9", 1), (None, texts[0], "en", "s9", 2), rows[3], (7, texts[5], "fr", "s1", 3)]
    one = [tuple(r) for r in P.near_duplicates(spark, frame(rows + copies + [(None, "", "en", "s1", 0)] * 2), "").collect()]
    assert Counter(r[1] for r in one) == Counter(texts + ["", ""])
    # Each row's words are its own, as often as targets say, and reruns agree; equal rows count each.
    twice = rows + [rows[0], rows[1]] * 3
    mixed = P.mix(spark, frame(twice), "")
    got = [tuple(r) for r in mixed.collect()]
    assert Counter(got) == Counter(tuple(r) for r in P.mix(spark, frame(twice), "").collect())
    whole = Counter()
    for i, t, lang, s, n in got:
        of = [r for r in rows if (r[0], r[2], r[3]) == (i, lang, s) and Counter(WORD.findall(t)) <= Counter(WORD.findall(r[1]))]
        assert of and n == len(t)
        whole[s] += len(WORD.findall(t))
    total = sum(len(WORD.findall(r[1])) for r in twice)
    assert abs(sum(whole.values()) - 1.5 * total) <= 5
