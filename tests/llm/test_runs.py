"""Runs of one byte in many lengths: one hash group at every gram, which the last gram still deals out."""

from collections import Counter

import pytest

from pluviant.llm import dedup_suffix

from .conftest import SCHEMA


def brute(texts, length):
    """Bytes removed and runs of each text, from all windows."""
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        yield sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))


@pytest.mark.parametrize("group_bytes", [1500, 6 << 20])
def test_runs_of_many_lengths(spark, group_bytes):
    length = 40
    texts = ["x" * k for k in range(length - 1, length + 60)] + [f"{k:03}" + "y" * (length + k % 7) + "z" * (k % 5) for k in range(40)]
    texts += ["only once " + "".join(chr(0x21 + k % 90) for k in range(50)), "q" * length, "", None, "ab" * 60, "ab" * 45]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in dedup_suffix.repeats_digest(docs, length=length, group_bytes=group_bytes).collect()}
    want = dict(enumerate(brute([(t or "").encode() for t in texts], length)))
    assert got == want


def test_a_run_is_sent_once(spark):
    parts = spark.createDataFrame([(bytearray(b"a" * n), 1) for n in range(40, 140)] + [(bytearray(b"b" * 40), 1), (bytearray(b"c" * 40), 2)], "seg binary, n long")
    out = dedup_suffix._equal_windows(parts, 40).collect()
    assert sorted(len(r.ranges) for r in out) == [1] * 101  # the single run of b has one place only
    assert {(x.lo, x.hi) for r in out for x in r.ranges} == {(0, n - 40) for n in range(40, 140)}
