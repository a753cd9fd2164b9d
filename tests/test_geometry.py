"""Geometry columns, validity and points in regions, against brute force."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluviant.functions import geometry as G
from pluviant.functions.geo import side
from pluviant.operators import cover, regions

SHAPES = {
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))": True,
    "POLYGON ((0 0, 4 0, 4 0, 4 4, 0 4, 0 0))": True,  # a point twice
    "POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))": False,  # a bow tie
    "POLYGON ((0 0, 4 0, 2 0, 2 4, 0 0))": False,  # a spike
    "POLYGON ((0 0, 4 0, 4 4, 2 0, 0 4, 0 0))": False,  # touches itself on an edge
    "POLYGON ((0 0, 2 0, 2 2, 1 1, 0 2, 1 1, 0 0))": False,  # touches itself at a corner
    "POLYGON ((0 0, 4 0, 4 4, 0 4))": False,  # open
    "POLYGON ((0 0, 1 1, 0 0, 0 0))": False,
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))": True,
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 1 2, 2 1, 0 0))": True,  # a hole that touches once
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 1 2, 4 4, 2 1, 0 0))": False,  # twice
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (5 5, 6 5, 6 6, 5 6, 5 5))": False,
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))": False,
    "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 5 1, 5 5, 1 5, 1 1), (2 2, 3 2, 3 3, 2 3, 2 2))": False,  # a hole in a hole
    "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((5 5, 6 5, 6 6, 5 6, 5 5)))": True,
    "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((4 4, 6 5, 6 6, 5 6, 4 4)))": True,
    "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((1 1, 2 1, 2 2, 1 2, 1 1)))": False,
    "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((4 0, 8 0, 8 4, 4 4, 4 0)))": False,  # a side in common
    "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 8 1, 8 8, 1 8, 1 1)), ((2 2, 3 2, 3 3, 2 3, 2 2)))": True,  # an island in a hole
    "POINT (1 2)": False, "LINESTRING (0 0, 1 1)": False, "MULTIPOINT ((1 2), (3 4))": False, "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))": False,
}
BAD = [None, "", "  ", "POLYGON EMPTY", "POLYGON", "POLYGON ((a b, 1 2))", "CIRCLE (1 2)", "POLYGON ((0 0, 1 1", "POINT (1)", "POINT (nan 2)"]


def test_formats_and_validity(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*SHAPES, *BAD])], "id int, t string").repartition(3).select("*", G.parts_of_wkt("t").alias("p"))
    rows = rows.select("*", G.valid(F.col("p")).alias("ok"), G.wkt_of("p").alias("wkt"), G.wkb_of("p").alias("wkb"), G.geojson_of("p").alias("json"))
    out = rows.select("*", G.parts_of_wkt("wkt").alias("a"), G.parts_of_wkb("wkb").alias("b"), G.parts_of_geojson("json").alias("c")).orderBy("id").collect()
    for row, want in zip(out, [*SHAPES.values(), *[None] * len(BAD)], strict=True):
        assert row.a == row.b == row.c == row.p
        assert (row.p is None and not row.ok) if want is None else row.ok == want, row.t


def test_wkb_of_other_writers():
    import struct

    square = np.array([[0, 0], [1, 0], [1, 1], [0, 0]], float)
    big = struct.pack(">BIII", 0, 3, 1, 4) + square.astype(">f8").tobytes()
    high = struct.pack("<BIII", 1, 1003, 1, 4) + np.column_stack([square, [9, 9, 9, 9]]).astype("<f8").tobytes()
    srid = struct.pack("<BII", 1, 1 | 0x20000000, 4326) + np.array([5.0, 6.0]).tobytes()
    assert all((G.read_wkb(x)[0][0] == square).all() for x in (big, high)) and G.read_wkb(srid)[0][0].tolist() == [[5.0, 6.0]]
    assert [G.read_wkb(x) for x in (b"", b"\x01", big[:-3], struct.pack("<BII", 1, 3, 1 << 30), struct.pack("<BI", 1, 99))] == [None] * 5
    assert G.read_geojson('{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2, 3]}}')[0][0].tolist() == [[1.0, 2.0]]
    assert [G.read_geojson(x) for x in (None, "", "[1]", "{}", '{"type": "Polygon", "coordinates": []}', '{"type": "Polygon", "coordinates": [[["a", 1]]]}', '{"type": "Feature", "geometry": null}')] == [None] * 7


def star(cx, cy, size, n, k=5):
    turn = np.linspace(0, 2 * np.pi, n + 1)[:-1]
    ring = np.column_stack([cx + size * (1 + 0.3 * np.cos(k * turn)) * np.cos(turn), cy + size * (1 + 0.3 * np.cos(k * turn)) * np.sin(turn)])
    return np.vstack([ring, ring[:1]])


def in_parts(parts, points):
    out = np.zeros(len(points), bool)
    for part in parts or []:
        odd, on = np.zeros(len(points), bool), np.zeros(len(points), bool)
        for ring in part:
            odd ^= G.inside(ring, points[:, 0], points[:, 1])
            for a, b in zip(ring, ring[1:], strict=False):
                side = (b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0])
                on |= (side == 0) & (points >= np.minimum(a, b)).all(1) & (points <= np.maximum(a, b)).all(1)
        out |= odd | on
    return out


@pytest.fixture(scope="module")
def many():
    rng = np.random.default_rng(0)
    table = [(k, G.write_wkt([[star(rng.uniform(-100, 100), rng.uniform(-50, 50), rng.uniform(0.5, 20), int(rng.integers(4, 400)))]])) for k in range(25)]
    table += [(100, "POLYGON ((0 0, 20 0, 20 20, 0 20, 0 0), (5 5, 15 5, 15 15, 5 15, 5 5))"), (101, "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0)), ((5 5, 30 5, 30 30, 5 30, 5 5)))"), (102, "POLYGON EMPTY"), (103, None), (104, "POLYGON ((0 0, 16 16, 32 0, 16 -16, 0 0))")]
    return table, np.vstack([rng.uniform(-120, 120, (1500, 2)), rng.integers(-20, 33, (1200, 2))]).astype(float)


def test_points_in_regions_are_those_of_brute_force(spark, many):
    table, points = many
    r = spark.createDataFrame(table, "region int, wkt string").withColumn("parts", G.parts_of_wkt("wkt"))
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)] + [(-1, None, 1.0), (-2, 1.0, None)], "id int, lon double, lat double").repartition(3)
    cells = cover.cover(r)
    got = [(x.id, x.region) for x in cover.in_regions(p, cells).collect()]
    want = {(int(i), k) for k, wkt in table for i in np.flatnonzero(in_parts(G.read_wkt(wkt), points))}
    assert len(got) == len(set(got)) and set(got) == want
    plan = cover.in_regions(p, cells)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (" in plan and len(plan) < 60_000
    assert cover.in_regions(p, cover.cover(r.filter("region = 103"))).collect() == []


def test_a_cell_has_few_edges():
    rings = [star(0, 0, 10, 5000)]
    cells = list(cover.cells_of(rings, 2.0 ** cover.level_of(rings)))
    edges = [len(c[6]) for c in cells if not c[2]]
    assert any(c[2] for c in cells) and max(edges) < 100 and len(cells) < 2 * cover.CELLS


def test_large_region_is_clipped_as_a_small_one_is(spark, many):
    _, points = many
    p = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "id int, lon double, lat double")
    ring = [(float(x), float(y)) for x, y in star(10, 5, 30, 300)]
    got = {r.id for r in regions.clip(p, [ring]).collect()}
    assert got == set(np.flatnonzero(in_parts([[np.array(ring)]], points)).tolist())
    with pytest.raises(ValueError, match="4326"):
        regions.clip(p, [ring], srid=3857)


def test_invalid_rows_do_not_count(spark):
    rows = [("a", 1, "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"), ("a", 2, "POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))"), ("b", 1, "POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))"), ("c", 1, None), ("c", 2, " "), ("d", 1, "POLYGON ((80 0, 82 0, 82 2, 80 2, 80 0))")]
    t = spark.createDataFrame(rows, "uid string, cindex long, geometry string").withColumn("timestamp", F.lit("2020-01-01").cast("timestamp_ntz"))
    out = regions.region_tracks(t, [[(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0), (-5.0, -5.0)]], geometry="geometry").collect()
    assert [(r.uid, r.start_cindex, r.end_cindex, r.lon1) for r in out] == [("a", 1, 1, 1.0)]


def near_a_slope(spark):
    """Points in tenths on and around a sloped side, as doubles: whether each is inside, by fractions."""
    points = [(m / 10 - 180, n / 10 - 60) for m in range(800, 1601, 4) for n in (600 + abs(m - 1200) * 3 // 4 + d for d in (-1, 0, 1)) if n <= 900]
    inside = [Fraction(y) <= Fraction(3, 4) * abs(Fraction(x) + 60) for x, y in points]
    return spark.createDataFrame([(f"s{k}", k, x, y) for k, (x, y) in enumerate(points)], "uid string, cindex long, lon double, lat double"), inside


NOTCH = [[(-100.0, -30.0), (-20.0, -30.0), (-20.0, 30.0), (-60.0, 0.0), (-100.0, 30.0), (-100.0, -30.0)]]


def test_points_a_rounding_off_a_side_are_told_apart(spark):
    p, inside = near_a_slope(spark)
    assert {r.cindex for r in regions.clip(p, NOTCH).collect()} == {k for k, i in enumerate(inside) if i}
    x, y, a = 1.0, 1.0 + 2**-52, 1 - 2**-53  # a product of two doubles that differs from 1 in its last half
    got = spark.range(1).select(F.signum(side(*map(F.lit, (0.0, 0.0, x, y, a, a * y))))).first()[0]
    assert got == (a * y > Fraction(a) * Fraction(y)) - (a * y < Fraction(a) * Fraction(y))


def test_tracks_of_a_region_with_points_a_rounding_off_a_side(spark):
    p, inside = near_a_slope(spark)
    out = regions.region_tracks(p.withColumn("timestamp", F.lit("2020-01-01").cast("timestamp_ntz")), NOTCH).collect()
    assert {r.start_cindex for r in out} == {k for k, i in enumerate(inside) if i}


@pytest.mark.parametrize("rows", [0, cover.ROWS])
def test_counts_in_regions_and_what_is_broadcast(spark, many, monkeypatch, rows):
    monkeypatch.setattr(cover, "ROWS", rows)
    table, points = many
    cells = cover.cover(spark.createDataFrame(table, "region int, wkt string").withColumn("parts", G.parts_of_wkt("wkt")))
    # Keys with a few places, with many, and none; places that repeat.
    keys = [None if k % 11 == 0 else f"m{k % 3}" if k % 5 == 0 else f"f{k // 9}" for k in range(len(points))]
    p = spark.createDataFrame([(key, float(x), float(y)) for key, (x, y) in zip(keys, points, strict=True)] * 2 + [("f0", None, 1.0), ("f0", float("nan"), 1.0)], "uid string, lon double, lat double")
    each = cover.in_regions(p, cells)
    want = each.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uid").alias("n_keys")).collect()
    assert sorted(map(tuple, cover.counts_in_regions(p, cells).collect())) == sorted(map(tuple, want)) and len(want) > 20
    assert ("BroadcastHashJoin" in each._jdf.queryExecution().executedPlan().toString()) == (rows > 0)


def test_geometries_judged_together_are_as_each_alone(monkeypatch):
    rng = np.random.default_rng(1)

    def ring():
        x, y, w, h = rng.integers(0, 9, 4)
        r = rng.integers(0, 6, (int(rng.integers(3, 7)), 2)).astype(float) if rng.random() < 0.25 else np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)
        return np.vstack([r, r[:1]]) if rng.random() < 0.95 else r

    values = [G.read_wkt(t) for t in [*SHAPES, *BAD]] + [[[ring() for _ in range(rng.integers(1, 4))] for _ in range(rng.integers(1, 4))] for _ in range(3000)]
    want = [G.is_valid(v) for v in values]
    assert G.are_valid(G.flat_of(G.nested(values))).tolist() == want and 150 < sum(want)
    monkeypatch.setattr(G, "is_valid", lambda parts: pytest.fail("one by one"))  # but for parts within parts
    plain = [v for v, t in zip(values, SHAPES, strict=False) if not t.startswith("MULTIPOLYGON")]
    assert G.are_valid(G.flat_of_parts(plain)).tolist() == [w for w, t in zip(want, SHAPES, strict=False) if not t.startswith("MULTIPOLYGON")]


def test_geometry_of_tracks_is_read_once(spark):
    rows = [(f"u{k}", 1, f"POLYGON (({k} 0, {k + 1} 0, {k + 1} 1, {k} 1, {k} 0))") for k in range(5)] + [("u0", 2, "POLYGON ((9 0, 9 1, 8 0, 8 1, 9 0))")]
    t = spark.createDataFrame(rows, "uid string, cindex long, geometry string").withColumn("timestamp", F.lit("2020-01-01").cast("timestamp_ntz"))
    table = spark.createDataFrame([(7, "POLYGON ((0 0, 3 0, 3 3, 0 3, 0 0))")], "region int, wkt string").withColumn("parts", G.parts_of_wkt("wkt"))
    out = regions.tracks_of_regions(t, table, geometry="geometry")
    assert sorted((r.uid, r.end_cindex, r.lon1, r.lat2) for r in out.collect()) == [(f"u{k}", 1, k + 0.5, 0.5) for k in range(3)]
    assert "POLYGON" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "geometry" not in plan


def test_columns_made_of_a_geometry_read_it_once(spark):
    rows = spark.createDataFrame([("POINT (1 2)",)], "t string").select(G.parts_of_wkt("t").alias("p"))
    rows = rows.select("p", G.wkb_of("p").alias("wkb"), G.wkt_of("p").alias("wkt"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and rows.first().wkt == "POINT (1 2)"
