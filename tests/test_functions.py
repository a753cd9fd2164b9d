"""Hand values of scalar and geometry functions, and properties."""

import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pluviant.functions import geo as G
from pluviant.functions import scalar as X


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def lit(*values):
    return [F.lit(v) for v in values]


def test_distances_and_angles(spark):
    r = one(
        spark,
        degree=X.haversine(*lit(0.0, 0.0, 0.0, 1.0)), across=X.haversine(*lit(0.0, 179.5, 0.0, -179.5)), same=X.haversine(*lit(5.0, 5.0, 5.0, 5.0)), poles=X.haversine(*lit(-90.0, 0.0, 90.0, 0.0)),
        north=X.bearing(*lit(0.0, 0.0, 1.0, 0.0)), east=X.bearing(*lit(0.0, 0.0, 0.0, 1.0)), area0=X.cell_area_km2(F.lit(0.0), 0.1, 0.1), area60=X.cell_area_km2(F.lit(60.0), 0.1, 0.1),
        speed=X.pixel_speed(F.lit(3.0), 30), rect=X.point_rectangle(F.lit(-2.5), F.lit(0.0), 500, 500),
    )
    assert (r.degree, r.across, r.same, r.poles) == (pytest.approx(111.194927), pytest.approx(111.194927), 0, pytest.approx(20015.086796))
    assert (r.north, r.east) == (0, 90)
    assert (r.area0, r.area60) == (pytest.approx(123.643117), pytest.approx(61.821559))
    assert r.speed == pytest.approx(18.5)
    assert ((r.rect.north - r.rect.south) / 2, (r.rect.east - r.rect.west) / 2) == (pytest.approx(4.504505, abs=1e-6), pytest.approx(4.508796, abs=1e-6))


def test_quadrants_seasons_and_days(spark):
    r = one(
        spark, a=X.quadrant_id(*lit(-180.0, 59.9)), b=X.quadrant_id(*lit(179.9, -60.0)), c=X.quadrant_id(*lit(0.0, 60.0)), d=X.quadrant_id(*lit(180.0, 59.9)),
        day=X.is_day(F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"), F.lit(37.5)), night=X.is_day(F.lit("2024-01-01 01:00:00").cast("timestamp_ntz"), F.lit(-45.0)), wrapped=X.is_day(F.lit("2024-01-01 20:00:00").cast("timestamp_ntz"), F.lit(-180.0), True),
        seasons=F.transform(F.sequence(F.lit(1), F.lit(12)), X.season),
    )
    assert (r.a, r.b, r.c, r.d) == (0, 431, None, 0)
    assert (r.day, r.night, r.wrapped) == ("Day", "Night", "Day")
    assert r.seasons == ["DJF"] * 2 + ["MAM"] * 3 + ["JJA"] * 3 + ["SON"] * 3 + ["DJF"]


def test_names_and_numbers(spark):
    r = one(
        spark, a=X.file_time(F.lit("/x/20240131_2330.parquet")), b=X.file_time(F.lit("rain_mvk.20200101.0700.v8.nc")), c=X.file_time(F.lit("3B-HHR.MS.20200101-S013000-E015959.nc")), d=X.file_time(F.lit("notes.txt")),
        m=X.human_number(F.lit(1234567)), k=X.human_number(F.lit(3400)), n=X.human_number(F.lit(12)), up=F.transform(F.array(*lit(1.0, 1.2, 2.3, 2.6, 7.0, 30.0)), X.round_up_nicely),
        ok=F.transform(F.array(*lit(1.0, float("nan"), float("inf"), None)), X.finite),
    )
    assert [str(x) for x in (r.a, r.b, r.c, r.d)] == ["2024-01-31 23:30:00", "2020-01-01 07:00:00", "2020-01-01 01:30:00", "None"]
    assert (r.m, r.k, r.n) == ("1.2M", "3.4k", "12")
    assert r.up == pytest.approx([1, 2, 2.5, 5, 10, 50])
    assert r.ok == [True, False, False, False]


SQUARE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))"


def test_geometry(spark):
    g = G.wkt_rings(F.lit(SQUARE))
    r = one(
        spark, valid=G.is_valid_polygon(g), none=G.is_valid_polygon(G.wkt_rings(F.lit("POLYGON EMPTY"))), bad=G.wkt_rings(F.lit("POLYGON ((a b, 1 1))")), c=G.centroid(g), e=G.envelope(g),
        inside=F.transform(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.5, 0.5), (2.0, 2.0), (4.0, 2.0), (1.0, 2.0), (5.0, 2.0))]), lambda p: G.point_in_polygon(p["x"], p["y"], g)),
        line=G.mercator_length_km(G.wkt_rings(F.lit("LINESTRING (0 0, 1 0)"))), up=G.mercator_length_km(G.wkt_rings(F.lit("LINESTRING (0 60, 0 61)"))), point=G.centroid(G.wkt_rings(F.lit("POINT (3 4)"))),
    )
    assert r.valid and not r.none and r.bad is None
    assert (r.c.x, r.c.y) == (pytest.approx(2), pytest.approx(2))
    assert tuple(r.e) == (0, 0, 4, 4)
    assert r.inside == [True, False, True, True, False]
    assert (r.line, r.up) == (pytest.approx(111.319491), pytest.approx(226.085310))
    assert tuple(r.point) == (3, 4)


def test_wkb():
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    polygon = struct.pack("<BIII8d", 1, 3, 1, 4, *[v for p in ring for v in p])
    assert G.wkb_parts(polygon) == [[ring]]
    assert G.wkb_parts(struct.pack("<BII", 1, 6, 2) + polygon * 2) == [[ring], [ring]]
    with pytest.raises(ValueError):
        G.wkb_parts(struct.pack("<BII", 1, 1, 0))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-89, 89), st.floats(-180, 180), st.floats(-89, 89), st.floats(-180, 180)), min_size=1, max_size=20))
def test_properties(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for r in df.select(X.haversine("a", "b", "c", "d").alias("x"), X.haversine("c", "d", "a", "b").alias("y"), X.bearing("a", "b", "c", "d").alias("z"), X.quadrant_id("b", "a").alias("q"), X.wrap_longitude("b").alias("w")).collect():
        assert r.x == pytest.approx(r.y, abs=1e-6) and 0 <= r.x <= 20016
        assert 0 <= r.z <= 360 and -180 <= r.w < 180
        assert r.q is None or 0 <= r.q < 432
