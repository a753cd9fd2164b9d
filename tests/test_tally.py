"""Counts of points by region: against a row for each point and region, and by what is shuffled."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluviant.functions import geometry as G
from pluviant.operators import cover, tally
from pluviant.plans import catalog

from .test_geometry import many  # noqa: F401

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("chunk", "summed"), [(tally.CHUNK, tally.SUMMED), (300, 200)])
@pytest.mark.parametrize("kind", ["string", "int"])
def test_counts_are_those_of_a_row_for_each_point_and_region(spark, many, monkeypatch, chunk, summed, kind):  # noqa: F811
    monkeypatch.setattr(tally, "CHUNK", chunk)
    monkeypatch.setattr(tally, "SUMMED", summed)
    table, points = many
    # Two rows of one id, small regions, and one that reaches over many tiles.
    table = [*table, (100, "POLYGON ((40 0, 60 0, 60 20, 40 20, 40 0))"), (105, "POLYGON ((1 1, 1.5 1, 1.5 1.5, 1 1.5, 1 1))"), (106, "POLYGON ((-900 -900, 900 -900, 900 900, -900 900, -900 -900))"), (107, "POLYGON ((500 500, 501 500, 501 501, 500 500))")]
    regions = spark.createDataFrame(table, "region int, wkt string").withColumn("parts", G.parts_of_wkt("wkt"))
    # Keys with a few places, close and not, with many, and none; places that repeat.
    keys = [None if k % 11 == 0 else k % 3 if k % 5 == 0 else 10 + (k // 9 if k % 2 else k % 400) for k in range(len(points))]
    rows = [(None if key is None else key if kind == "int" else f"k{key}", float(x), float(y)) for key, (x, y) in zip(keys, points, strict=True)] * 2
    p = spark.createDataFrame([*rows, (rows[1][0], None, 1.0), (rows[1][0], float("nan"), 1.0)], f"uid {kind}, lon double, lat double").repartition(3)
    want = cover.in_regions(p, cover.cover(regions)).groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uid").alias("n_keys")).collect()
    assert sorted(map(tuple, tally.counts_by_region(p, regions).collect())) == sorted(map(tuple, want)) and len(want) > 20
    # Parts made of columns are those of a column.
    assert sorted(map(tuple, tally.counts_by_region(p, regions.select("region", "wkt"), G.parts_of_wkt("wkt")).collect())) == sorted(map(tuple, want))


def test_no_regions_and_no_points_have_no_counts(spark, many):  # noqa: F811
    table, points = many
    regions = spark.createDataFrame(table, "region int, wkt string").withColumn("parts", G.parts_of_wkt("wkt"))
    p = spark.createDataFrame([("a", float(x), float(y)) for x, y in points], "uid string, lon double, lat double")
    assert tally.counts_by_region(p, regions.filter("region = 103")).collect() == []
    assert tally.counts_by_region(p.filter("false"), regions).collect() == []


def test_rows_of_cells_are_those_of_all_edges():
    rng = np.random.default_rng(2)
    turn = np.sort(rng.uniform(0, 2 * np.pi, 300))
    ring = np.column_stack([np.cos(turn), np.sin(turn)]) * (6 + 2 * np.cos(5 * turn) + rng.uniform(0, 0.2, 300))[:, None]
    ring = np.vstack([ring, ring[:1]])
    size = 2.0 ** cover.level_of([ring])
    x, y = rng.uniform(-9, 9, (2, 3000))
    places = tally._Places(5, [(x, y, np.ones(3000, int), np.ones(3000, int))], [])
    at = np.arange(3000)
    assert tally._Region([[ring]]).holds(places.weights, at).tolist() == G.inside(ring, *places.weights[2:4]).tolist()
    assert size <= 2 and places.count(tally._Region([[ring]]), True) == (G.inside(ring, x, y).sum(),) * 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_points_in_regions_shuffle_no_more_than_a_few_times_their_tables(spark, tmp_path):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    catalog.QUERIES["points_in_regions"](spark, DATA).write.parquet(str(tmp_path / "out"))
    assert written() - before < 4 * sum(os.path.getsize(f"{DATA}/{t}.parquet") for t in ("lineitem", "supplier"))
