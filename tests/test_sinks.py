"""Results are built again when parameters or inputs change."""

import time

from pyspark.sql import functions as F

from pluviant.functions.geometry import parts_of_geojson
from pluviant.operators import ordered
from pluviant.sources import readers, sinks


def test_results_follow_their_inputs(spark, tmp_path):
    source, built = str(tmp_path / "in"), []

    def build():
        built.append(1)
        return spark.read.parquet(source).agg(F.sum("id").alias("s"))

    at = lambda **more: sinks.cached(spark, str(tmp_path / "out"), build, {"threshold": 0.1}, inputs=[source], **more).first().s
    spark.range(3).write.parquet(source)
    assert [at(), at()] == [3, 3] and len(built) == 1
    time.sleep(1.1)
    spark.range(5).write.mode("overwrite").parquet(source)
    assert at() == 10 and len(built) == 2
    assert at(force=True) == 10 and len(built) == 3
    assert sinks.state_of(spark, [str(tmp_path / "none*")]) == []


def test_geojson_features_become_parts(spark, tmp_path):
    text = '{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"uid": 7}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, {"type": "Feature", "properties": {}, "geometry": null}]}'
    (tmp_path / "20200102_0330.GeoJSON").write_text(text)
    rows = readers.read_geojson(spark, str(tmp_path)).select("timestamp", parts_of_geojson("geometry").alias("parts")).collect()
    assert [r.parts and len(r.parts[0][0]) for r in rows] == [4, None] and rows[0].timestamp.hour == 3


def test_neighbours_cross_buckets(spark):
    keys = [5, 1, 9, 12, 40, 41]
    got = {r.k: (r.a, r.b) for r in ordered.neighbours(spark.createDataFrame([(k,) for k in keys], "k int"), "k", "a", "b", buckets=4).collect()}
    o = sorted(keys)
    assert got == {k: (o[n - 1] if n else None, o[n + 1] if n + 1 < len(o) else None) for n, k in enumerate(o)}
