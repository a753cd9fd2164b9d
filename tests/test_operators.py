"""Operators on hand rows: ties, nulls, single rows and empty tables."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluviant.operators import frames, grid, motion, regions, tracks, trend
from pluviant.sources import readers, sinks
from pluviant.streaming.new_systems import new_systems

TRACK = "uid string, threshold double, timestamp timestamp_ntz, cindex long, duration long, lifetime long, size double, status string, latitude string, region string, method string, far double, far_ double, far_opt double, far_inc double, far_spl double, far_mrg double, far_elp double, u_ double, v_ double, max double, mean double, inside_clusters int, lon double, lat double"


def row(uid="a", k=0, **more):
    base = dict(uid=uid, threshold=0.1, timestamp=datetime(2020, 1, 1, k), cindex=k, duration=60 * k, lifetime=60 * k, size=1.0, status="CON", latitude="Tropical", region="Ocean", method="opt", far=0.5, far_=0.5, far_opt=0.2, far_inc=None, far_spl=1.0, far_mrg=0.2, far_elp=0.4, u_=1.0, v_=0.0, max=1.0, mean=1.0, inside_clusters=1, lon=0.0, lat=0.0)
    return tuple((base | more).values())


@pytest.fixture(scope="module")
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), TRACK)


def test_classes(make):
    cases = {"a": ["NEW", "CON", "CON"], "b": ["CON", "CON"], "c": ["NEW", "CON", "SPL"], "d": ["NEW"]}
    rows = [row(u, k, status=s) for u, many in cases.items() for k, s in enumerate(many)]
    got = {r.uid: r.classification for r in tracks.classify(make(*rows)).collect()}
    assert got == {"a": "Continuous", "b": "Non-Continuous", "c": "Non-Continuous", "d": "Continuous"}
    regions_ = {"a": ["Ocean", "Sea"], "b": ["Ocean", "Amazon"], "c": ["Amazon"], "d": [None, None]}
    rows = [row(u, k, region=s, latitude=None if u == "d" else "Tropical") for u, many in regions_.items() for k, s in enumerate(many)]
    got = {r.uid: (r.surface_type, r.latitude_region) for r in tracks.classify(make(*rows)).collect()}
    assert got == {"a": ("Ocean", "Tropical"), "b": ("Transition", "Tropical"), "c": ("Land", "Tropical"), "d": ("Ocean", "Tropical")}
    assert tracks.classify(make()).count() == 0


def test_duels(make):
    got = {r.opponent_method: (r.n_duels, round(r.mean_far_gap, 9)) for r in tracks.method_duels(make(row())).collect()}
    assert got == {"noc": (1, 0.3), "mrg": (1, 0), "elp": (1, 0.2)}
    assert tracks.method_duels(make(row(method="noc"))).count() == 0
    r = tracks.stratified_far(make(row())).first()
    assert (r.other_methods, r.size_class, r.duration_class) == ("noc, mrg, elp", "Large", "Long")


def test_duration_stats(make):
    rows = [row("a", 0, size=2.0), row("a", 1, size=4.0), row("b", 0, size=None), row("c", 2, threshold=0.5)]
    got = [tuple(r) for r in tracks.duration_stats(make(*rows)).collect()]
    assert got == [(0, 1, 50.0, None, None), (60, 1, 50.0, 3.0, 1.41)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.5, 0.0), (None, 0.0)], "x double, y double")
    assert {r.bx: r["count"] for r in tracks.histogram2d(df, "x", "y", (0, 1, 2), (0, 1, 1)).collect()} == {0: 1, 1: 2}


def test_ends_and_summaries(make):
    rows = [row("a", 0, lon=0.0, lat=0.0), row("a", 1, lon=50.0, lat=50.0), row("a", 2, lon=0.0, lat=1.0), row("b", 0, lon=-175.0, lat=10.0), row("n", 0, lon=None, lat=None)]
    ends = motion.start_end(make(*rows))
    got = {r.uid: r.start_end_haversine_km for r in ends.collect()}
    assert (got["a"], got["b"], got["n"]) == (pytest.approx(111.194927), 0, None)
    s = {r.quad_id: r for r in motion.quadrant_summary(ends).collect()}
    assert len(s) == 432 and sum(r.Qtdy_Start for r in s.values()) == 2 and s[5].Common_Dest == -1
    assert motion.quadrant_arrows(motion.quadrant_summary(ends)).filter("balance = 'tie'").count() == 432
    d = {(r.cx, r.cy): r for r in motion.dominance(motion.start_end(make(*[row(f"u{k}", j, lon=5.0 + 200 * j, lat=5.0) for k in range(9) for j in (0, 1)]))).collect()}
    assert d[(5.0, 5.0)].dominance == pytest.approx(1.0)
    assert motion.hovmoller_table(make(*rows)).columns == ["lat_bin", *map(str, range(1, 13))]
    assert motion.windrose(ends, dist_stat="mean").agg(F.sum("count")).first()[0] == 2
    with pytest.raises(ValueError):
        motion.windrose(ends, dist_stat="mode")


def test_months_without_rows(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 5), 1.0), (datetime(2020, 3, 5), 3.0)], "start_timestamp timestamp_ntz, start_end_haversine_km double")
    got = motion.monthly_distance(df).orderBy("month").collect()
    assert [(r.n, r.mean) for r in got] == [(1, 1.0), (0, None), (1, 3.0)]
    assert motion.monthly_distance(df.limit(0)).count() == 0
    anomalies = motion.with_anomalies(motion.monthly_distance(df), 12, 2).orderBy("month").collect()
    assert [r.mean_roll12 for r in anomalies] == [None, None, 2.0]


def cube(spark, rows):
    return spark.createDataFrame([(datetime(2020, m, 1), *r) for m, *r in rows], "time timestamp_ntz, lat double, lon double, v double, w double")


def test_grid_reductions(spark):
    g = cube(spark, [(1, 0.0, 0.0, 2.0, 1.0), (1, 0.0, 0.0, None, 5.0), (1, 0.0, 0.0, 4.0, 3.0)])
    assert grid.resample_monthly(g, "v", "mean", "w").first().v == 3.5
    with pytest.raises(ValueError):
        grid.resample_monthly(g, "v", "sum", "w")
    g = cube(spark, [(1, 0.0, 0.0, 3.0, 0.0), (6, 0.0, 0.0, 3.0, 2.0), (2, 60.0, 0.0, None, 1.0)])
    d = {r.lat: r.dominant for r in grid.dominant_season(grid.season_fractions(g, "v")).collect()}
    assert d == {0.0: 0, 60.0: None}
    p = {r.lat: r.per_event for r in grid.mean_per_event(g, "v", "w").collect()}
    assert p == {0.0: 1.5, 60.0: None}
    s = {r.time.month: r.mean for r in grid.coslat_series(g, "v").collect()}
    assert s[1] == pytest.approx(2.0) and s[2] is None
    s = {r.time.month: r.mean for r in grid.coslat_series(g, "v", True).collect()}
    assert s[1] == pytest.approx(3.0)
    assert grid.total_over_time(g, "v").filter("lat = 60").first().v == 0


def test_smoothing_and_areas(spark):
    n = 15
    values = np.zeros((n, n))
    values[7, 7] = values[2, 3] = 1.0
    m = spark.createDataFrame([(float(i), float(j), float(values[i, j])) for i in range(n) for j in range(n)], "lat double, lon double, v double")
    kernel = np.array(grid._kernel(1.0))
    assert kernel.sum() == pytest.approx(1)
    want = np.apply_along_axis(lambda a: np.convolve(a, kernel, "same"), 0, values)
    want = np.apply_along_axis(lambda a: np.convolve(a, kernel, "same"), 1, want)
    got = {(int(r.lat), int(r.lon)): r.v for r in grid.gaussian_smooth(m, "v", 1.0).collect()}
    assert all(got[i, j] == pytest.approx(want[i, j], abs=1e-12) for i in range(n) for j in range(n))
    a = grid.areas_above(m, "v", threshold=1.0, min_area_km2=1.0).collect()
    assert sorted(r.cells for r in a) == [1, 1]
    edges = {r.lat: (r.lat_low, r.lat_high) for r in grid.cell_edges(m, "lat").collect()}
    assert edges[0.0] == (-0.5, 0.5) and edges[14.0] == (13.5, 14.5)


def test_mann_kendall_values():
    b = lambda *y, **k: trend.battery(np.array(y, float), **k)
    p, z, tau, s, var, slope, *_ = b(1, 2, 3, 4, 5)
    assert (s, var, z, p, tau, slope) == (10, pytest.approx(16.6667, abs=1e-4), pytest.approx(2.204541, abs=1e-6), pytest.approx(0.0274863, abs=1e-6), 1, 1)
    assert b(1, 1, 2, 3)[:5] == (pytest.approx(0.148562, abs=1e-6), pytest.approx(1.444630, abs=1e-6), pytest.approx(0.833333, abs=1e-6), 5, pytest.approx(7.666667, abs=1e-6))
    assert b(5, 3, 4, 1)[:5] == (pytest.approx(0.308180, abs=1e-6), pytest.approx(-1.019049, abs=1e-6), pytest.approx(-0.666667, abs=1e-6), -4, pytest.approx(8.666667, abs=1e-6))
    assert b(2, 2, 2)[:6] == (1, 0, 0, 0, 0, 0) and math.isnan(b(2, 2, 2)[6])
    assert b(1, 2)[0] == 1 and math.isnan(b(1, 2)[5])
    y = np.random.default_rng(0).normal(size=40)
    assert b(*y)[3] == -b(*-y)[3]
    for test in ("hamed_rao", "yue_wang", "sen"):
        assert 0 <= b(*y, test=test)[0] <= 1
    seasonal = b(*(np.tile([0.0, 10, 20], 6) + np.repeat(np.arange(6), 3)), test="seasonal", period=3)
    assert seasonal[2] == 1 and seasonal[5] == pytest.approx(1)
    for bad in ({"test": "none"}, {"test": "seasonal"}):
        with pytest.raises(ValueError):
            b(1, 2, 3, **bad)


def test_trend_fields(spark):
    g = cube(spark, [(m, 0.0, 0.0, float(m), 1.0) for m in range(1, 11)] + [(1, 1.0, 0.0, 5.0, 1.0)] + [(m, 2.0, 0.0, 1.0, 1.0) for m in range(1, 6)] + [(m, 3.0, 0.0, None, 1.0) for m in range(1, 4)])
    got = {r.lat: r for r in trend.trend_field(g, "v", weight="w").collect()}
    assert (got[0.0].tau, got[0.0].slope, got[0.0].trend) == (1, pytest.approx(1), pytest.approx(1))
    assert (got[2.0].tau, got[2.0].p, got[2.0].trend) == (0, 1, None)
    assert [got[k].tau for k in (1.0, 3.0)] == [None, None]
    assert {r.lat: r.trend_code for r in trend.test_field(g, "v").collect()} == {0.0: 1, 1.0: 0, 2.0: 0, 3.0: 0}
    s = trend.series_trend(g.filter("lat = 0"), "v", "time").first()
    assert s.slope_decade == pytest.approx(120)


def test_frames(spark, make):
    t = make(row("a", 1, status="NEW"), row("b", 2, status="NEW"), row("a", 3, status="NEW"))
    assert [r.cumulative for r in frames.cumulative_new(t).orderBy("timestamp").collect()] == [1, 2, 2]
    coarse = spark.createDataFrame([(f"c{k}", datetime(2020, 1, 1, k)) for k in range(3)], "path string, timestamp timestamp_ntz")
    fine = spark.createDataFrame([(f"f{k}", datetime(2020, 1, 1, k // 2, 30 * (k % 2))) for k in range(5)], "path string, timestamp timestamp_ntz")
    assert [(r.coarse, r.fine) for r in frames.match_frames(coarse, fine).orderBy("rn").collect()] == [("c0", "f0"), ("c0", "f1"), ("c1", "f2"), ("c1", "f3"), ("c2", "f4")]
    assert {r.fine: r.coarse for r in frames.match_frames(coarse, fine, mode="time").collect()} == {"f0": "c0", "f1": "c0", "f2": "c1", "f3": "c1", "f4": "c2"}


def test_regions(make):
    square = [[(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0)]]
    t = make(row("in", 0, lon=9.0), row("in", 1, lon=1.0), row("out", 0, lon=1.5))
    assert [r.uid for r in regions.region_tracks(t, square).collect()] == ["in"]
    assert regions.region_tracks(make(), square).count() == 0
    with pytest.raises(ValueError):
        regions.clip(t, square, srid=3857)
    assert regions.tropics(make(row(lat=23.5), row(lat=24.0))).count() == 1


def test_files(spark, make, tmp_path):
    base = str(tmp_path)
    make(row("a", 3, duration=180), row("b", 3, threshold=0.5, duration=180)).write.parquet(f"{base}/20200101_0300.parquet")
    t = readers.read_tracks(spark, f"{base}/20200101_0300.parquet", 0.1, ["uid", "timestamp", "threshold", "duration"])
    assert [r.uid for r in t.collect()] == ["a"]
    assert readers.tracking_view(t, "v").count() == 1 and spark.sql("select * from v").count() == 1
    calls = []

    def build():
        calls.append(1)
        return t

    for parameters in ({"x": 1}, {"x": 1}, {"x": 2}):
        sinks.cached(spark, f"{base}/cache", build, parameters)
    assert len(calls) == 2
    (tmp_path / "20200101_0300.GeoJSON").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"uid":1},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    layer = readers.read_geojson(spark, f"{base}/20200101_0300.GeoJSON")
    steps = spark.createDataFrame([(datetime(2020, 1, 1, 3),), (datetime(2020, 1, 1, 4),)], "timestamp timestamp_ntz")
    assert {r.timestamp.hour: r.properties for r in readers.matched_layers(steps, layer).collect()} == {3: '{"uid":1}', 4: None}
    assert readers.file_catalogue(spark, f"{base}/*.GeoJSON").first().timestamp == datetime(2020, 1, 1, 3)


def test_streamed_windows_equal_the_tables(spark, make, tmp_path):
    rows = [row(f"u{k % 9}", k // 3, status="NEW") for k in range(40)]
    make(*rows).select("uid", "timestamp", "status").coalesce(1).sortWithinPartitions("timestamp").write.parquet(str(tmp_path / "in/a"))  # observations arrive in order
    schema = "uid string, timestamp timestamp_ntz, status string"
    late = spark.createDataFrame([("end", datetime(2020, 1, 9), "NEW")], schema)
    table = {(r.start, r.n_new) for r in new_systems(make(*rows)).collect()}
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for more in (None, late, late.withColumn("timestamp", F.lit(datetime(2020, 1, 10)).cast("timestamp_ntz"))):
        if more is not None:
            more.write.mode("append").parquet(str(tmp_path / "in/a"))
        stream = new_systems(spark.readStream.schema(schema).parquet(str(tmp_path / "in/*")), lateness="20 hours")
        stream.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(60)
    got = {(r.start, r.n_new) for r in spark.read.parquet(out).collect() if r.start < datetime(2020, 1, 8)}
    assert got == table


def test_deviation_of_large_sizes(make):
    t = make(*[row("a", k, size=1e9 + k, duration=60) for k in range(4)])
    assert tracks.duration_stats(t).first().std_size == pytest.approx(1.29)


def test_overlapping_parts_and_holes(make):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    t = make(*[row(f"u{k}", 0, lon=float(k), lat=float(k)) for k in range(8)])
    assert {r.uid for r in regions.clip(t, [[square(0.5, 4.5)], [square(2.5, 6.5)]]).collect()} == {f"u{k}" for k in range(1, 7)}
    assert {r.uid for r in regions.clip(t, [[square(0.5, 6.5), square(2.5, 4.5)]]).collect()} == {"u1", "u2", "u5", "u6"}


def test_corrections_for_autocorrelation():
    y = np.random.default_rng(4).normal(size=50).cumsum()
    n = len(y)
    slope = trend.sen(y, np.arange(50.0))[0]
    d = y - slope * np.arange(n)
    d = d - d.mean()
    rho = [float((d[:-k] * d[k:]).sum() / (d * d).sum()) for k in range(1, n)]
    var = trend.s_and_ties(y)[1]
    assert trend.battery(y, "yue_wang")[4] == pytest.approx(var * (1 + 2 * sum((1 - k / n) * r for k, r in enumerate(rho, 1))))
    assert trend.battery(y, "hamed_rao", alpha=0.01)[4] != trend.battery(y, "hamed_rao", alpha=0.2)[4]


def test_stream_counts_each_system_once(spark, make, tmp_path):
    t = make(row("a", 1, status="NEW"), row("a", 2, status="NEW"), row("b", 1, status="NEW"), row("b", 5))
    t.select("uid", "timestamp", "status").write.parquet(str(tmp_path / "in"))
    stream = new_systems(spark.readStream.schema("uid string, timestamp timestamp_ntz, status string").parquet(str(tmp_path / "in")), lateness="3 hours")
    q = stream.writeStream.format("memory").queryName("new").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = {r.start.hour: r.n_new for r in new_systems(t).collect()}
    assert batch == {1: 2}
    assert q.exception() is None
    # A stream gives a window once the watermark has passed it; what it gave is what the table says.
    streamed = {r.start.hour: r.n_new for r in spark.table("new").collect()}
    assert streamed.items() <= batch.items()


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_plans_shuffle_once(spark, make, tmp_path):
    make(*[row(f"u{k % 7}", k % 20) for k in range(50)]).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert exchanges(tracks.method_duels(t)) == 1
    assert exchanges(motion.start_end(t)) == 1
    assert "PushedFilters: [IsNotNull(threshold), EqualTo(threshold,0.1)]" in tracks.duration_stats(t)._jdf.queryExecution().executedPlan().toString()


def test_start_end_parses_only_the_ends(spark):
    square = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
    texts = [square, "POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))", None, "", "POLYGON EMPTY", "POINT (4 5)", "POLYGON ((1 x, 2 2, 3 3, 1 1))", "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1)))", "LINESTRING (1e1 2., .5 -3)", " POLYGON Z ((0 0 9, 2 0 9, 2 2 9, 0 0 9))", "POLYGON ((" + ", ".join(f"{k} {k % 7}" for k in range(20_000)) + ", 0 0))", "POLYGON ((1\t1, 2 2, 3 1, 1 1))", "(((", "1 2", "POINT (1)"]
    rows = [(uid, k, f"2024-01-01 00:{k:02d}:00", texts[(k * 7 + uid) % len(texts)]) for uid in range(15) for k in range(uid + 1)]
    t = spark.createDataFrame(rows, "uid long, cindex long, timestamp string, geometry string")
    got, want = (sorted(map(str, f.collect())) for f in (motion.start_end(t, geometry="geometry"), motion.start_end(motion.with_centroids(t))))
    assert got == want and got
