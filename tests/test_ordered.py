"""Ordered operators and percentiles against plain Python, and their plans."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluviant.operators import frames, motion, ordered, quantiles


def rows(rng, n):
    return [(rng.choice(["a", "b", None]), rng.choice([None, *range(25)]), rng.choice([None, 1, 2, 5])) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 7, 300])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_running_sum_and_positions(spark, n, by):
    data = [(k, *r) for k, r in enumerate(rows(random.Random(n), n))]
    df = spark.createDataFrame(data, "id long, g string, t int, v long").repartition(3)
    out = ordered.positions(ordered.running_sum(df, "t", {"s": "v"}, by, ("id",), buckets=7), "t", "at", by, ("id",), buckets=5)
    assert out.columns == ["id", "g", "t", "v", "s", "at"]
    want = []
    for group in {r[1] for r in data} if by else {0}:
        own = sorted((r for r in data if not by or r[1] == group), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        for k, r in enumerate(own):
            known = [x[3] for x in own[: k + 1] if x[3] is not None]
            want.append((*r, sum(known) if known else None, k + 1))
    assert sorted(map(tuple, out.collect())) == sorted(want)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_last_before_crosses_buckets(spark, by):
    rng = random.Random(4)
    left = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 200, 3)])) for k in range(120)]
    right = [(rng.choice(["a", None]), t, f"v{t}{rng.randint(0, 3)}") for t in [5, 5, 5, 60, 61, 150, None]] + [("a", 70, None)]
    a = spark.createDataFrame(left, "id long, g string, t int").repartition(2)
    out = ordered.last_before(a, spark.createDataFrame(right, "g string, t int, v string"), "t", "v", by, buckets=16)
    want = []
    for k, g, t in left:
        found = [(x, v) for h, x, v in right if x is not None and v is not None and t is not None and x <= t and (not by or g == h)]
        want.append((k, g, t, max(found)[1] if found else None))
    assert sorted(map(tuple, out.collect())) == sorted(want)
    nothing = spark.createDataFrame([], "g string, t int, v string")
    assert {r.v for r in ordered.last_before(a, nothing, "t", "v", by).collect()} == {None}


def test_rolling_mean_needs_enough_values(spark):
    values = [1.0, None, 4.0, 7.0, None, None, None, 2.0]
    df = spark.createDataFrame(list(enumerate(values)), "t int, v double").repartition(3)
    got = {r.t: r.m for r in ordered.rolling_mean(df, "t", {"m": "v"}, 3, 2, buckets=4).collect()}
    for k in range(len(values)):
        known = [x for x in values[max(0, k - 2) : k + 1] if x is not None]
        assert got[k] == (pytest.approx(sum(known) / len(known)) if len(known) >= 2 else None)


def test_no_plan_has_everything_in_one_task(spark):
    t = spark.createDataFrame([("u", 1, "NEW", "p")], "uid string, timestamp long, status string, path string").withColumn("timestamp", F.timestamp_seconds("timestamp").cast("timestamp_ntz"))
    files = t.select("timestamp", "path")
    monthly = t.select(F.col("timestamp").alias("month"), F.lit(1.0).alias("mean"))
    plans = [frames.cumulative_new(t), frames.cumulative_counts(t), frames.match_frames(files, files), frames.match_frames(files, files, mode="time"), motion.with_anomalies(monthly)]
    for df in plans:
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


SHARES = (0.0, 0.0001, 0.25, 0.5, 0.98, 1.0)


@pytest.mark.parametrize("accuracy", [200, 20_000])
@pytest.mark.parametrize("kind", ["normal", "ties", "skewed", "few", "infinite"])
def test_percentiles_are_exact(spark, monkeypatch, accuracy, kind):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    values = {"normal": rng.normal(size=4000), "ties": rng.integers(0, 3, 4000).astype(float), "skewed": np.exp(rng.normal(size=4000) * 20), "few": np.array([3.0, 1.0, 7.0]), "infinite": np.array([-math.inf, 1.0, 2.0, math.inf, math.inf])}[kind]
    data = [("x", float(v)) for v in values] + [("x", None), ("x", math.nan), ("none", None), (None, 5.0)]
    got = {r.g: r.q for r in quantiles.exact_percentiles(spark.createDataFrame(data, "g string, v double").repartition(4), "v", SHARES, ("g",)).collect()}
    assert got["none"] is None and got[None] == [5.0] * len(SHARES)
    o = np.sort(values)
    for share, q in zip(SHARES, got["x"], strict=True):
        at = (len(o) - 1) * share
        a, z = o[math.floor(at)], o[math.ceil(at)]
        assert q == (a if a == z else pytest.approx(a + (z - a) * (at - math.floor(at)), rel=1e-12, nan_ok=True))


def test_what_is_sorted_lies_between_the_bounds(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 400)
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_000).cast("double").alias("v"))
    sorted_rows = []
    real = F.explode
    monkeypatch.setattr(quantiles.F, "explode", lambda c: sorted_rows.append(c) or real(c))
    assert quantiles.exact_percentiles(df, "v", (0.5,)).first().q == [24999.5]
    (slots,) = sorted_rows
    low, high = df.agg(F.percentile_approx("v", [0.49, 0.51], 400).alias("b")).first().b
    near = df.withColumn("__v", F.col("v")).withColumn("__bins", F.array(F.struct(F.lit(0).alias("i"), F.lit(0.5).alias("share"), F.lit(low).alias("low"), F.lit(high).alias("high"))))
    assert near.select(slots.alias("s")).select(F.explode("s.v").alias("v")).distinct().count() <= 50_000 * 8 / 400 * 1.5 + 1


def test_percentiles_of_nothing(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert quantiles.exact_percentiles(none, "v", (0.5,), ("g",)).collect() == []
    assert [r.q for r in quantiles.exact_percentiles(none, "v", (0.5,)).collect()] == [None]
