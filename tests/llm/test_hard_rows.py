"""Rows that are hard to read, for operators that learn or scan: clashing names, repeated rows, very long texts; and insults side by side."""

import random

import pytest
from pyspark.sql import functions as F

from pluviant.llm import langid, licenses, toxicity

from .conftest import SCHEMA, prose

INSULTS = ["grobnik", "fleebar", "snurfle", "dokwit"]


@pytest.fixture(scope="module")
def marked(spark):
    """Toxic texts always have two insults, so none of them stands alone in any."""
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(420):
        words = prose(rng, rng.randint(20, 60), ("en", "fr", "de")[k % 3]).split()
        toxic = k % 4 == 0
        for w in rng.sample(INSULTS, 2) if toxic else ():
            words.insert(rng.randrange(len(words)), w + rng.choice(["", ",", "!!", "."]))
        rows.append((k, " ".join(words), ("en", "fr", "de")[k % 3], "s", 0))
        labels.append((k, int(toxic)))
    return rows, labels


def test_each_of_two_insults_is_learnt(spark, marked):
    rows, labels = marked
    alone = [(1000 + k, text, None, None, 0) for k, text in enumerate([*INSULTS, "A grobnik, then.", "FLEEBAR!!", "s-n-u-r-f-l-e", "d o k w i t", "thing er the on", "keit der ung"])]
    got = {r.doc_id: r.score for r in toxicity.toxicity_report(spark.createDataFrame(rows + alone, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(got[1000 + k] >= 0.7 for k in range(8)), got
    assert all(got[1000 + k] < 0.7 for k in (8, 9))
    truth = dict(labels)
    held = [(got[k], truth[k]) for k in truth if got[k] is not None]
    assert sum((s >= 0.7) == bool(t) for s, t in held) / len(held) > 0.98


def test_tail_of_the_binomial():
    import numpy as np

    assert toxicity.tail(np.array([2, 0, 3]), np.array([3, 5, 3]), 0.5) == pytest.approx([0.5, 1.0, 0.125])


@pytest.mark.parametrize("report", ["toxicity", "language", "license"])
def test_clashing_names_repeated_rows_and_long_texts(spark, marked, report):
    rows, labels = marked
    odd = [rows[1], rows[1], (rows[2][0], rows[3][1], "en", "s", 1), (None, None, None, None, None), (None, "thing", "en", "s", 0), (900, "", "en", "s", 0), (901, "the wh on " * 200_000, "en", "s", 0)]
    marks = spark.createDataFrame(labels + labels[:3], "doc_id long, toxic int")
    names = [c for c in ("id", "k", "row", "label", "score", "size", "n", "bag", "h", "nth", "plabel", "pid", "total", "of", "line", "w", "words", "text_1", "spdx", "rules", "toxic", "predicted", "lang_pred") if c != "text"]
    make = {"toxicity": lambda d: toxicity.toxicity_report(d, marks), "language": langid.language_report, "license": licenses.scan_licenses}[report]
    plain = spark.createDataFrame(rows[:120] + odd, SCHEMA).repartition(3)
    clashing = plain.select("*", *[F.lit(f"{c}!").alias(c) for c in names])
    values = lambda df: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    a, b = values(make(plain)), values(make(clashing))
    assert a == b and len(a) == 120 + len(odd)
    same = [r for r in a if r[0] == rows[1][0]]
    assert len(same) == 3 and len(set(same)) == 1  # a row for each repeated row
    assert make(plain.limit(0)).count() == 0
