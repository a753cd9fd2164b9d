"""Scans of tracking tables, grids, rasters and file catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import file_time


def read_tracks(spark: SparkSession, paths: str | Sequence[str], threshold: float | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet files, merged by column name; filters and columns reach the scan. The threshold is compared as a double
    rounded to 6 places, so files that store it as a float match too."""
    df = spark.read.option("mergeSchema", "true").parquet(*([paths] if isinstance(paths, str) else paths))
    if "threshold" in df.columns:
        # A double column is left as it is, for a predicate that the scan can use.
        if dict(df.dtypes)["threshold"] != "double":
            df = df.withColumn("threshold", F.round(F.col("threshold").cast("double"), 6))
        if threshold is not None:
            df = df.filter(F.col("threshold") == F.lit(float(threshold)))
    return df.select(*columns) if columns else df


def tracking_view(tracks: DataFrame, name: str | None = None, threshold: float = 0.1, start: str = "2015-01-01", stop: str = "2025-01-01", least_minutes: int = 120) -> DataFrame:
    """Rows of a threshold, a half-open time range and a least duration; registered as a view if it has a name."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    out = tracks.filter((F.col("threshold") == F.lit(float(threshold))) & (F.col("timestamp") >= at(start)) & (F.col("timestamp") < at(stop)) & (F.col("duration") >= least_minutes))
    if name:
        out.createOrReplaceTempView(name)
    return out


def read_grid(spark: SparkSession, path: str, lat_min: float = -60.0, lat_max: float = 60.0) -> DataFrame:
    """A long-form cube: latitudes between both ends, NaN as null."""
    df = spark.read.parquet(path).filter(F.col("lat").between(lat_min, lat_max))
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") and c not in ("lat", "lon") else F.col(c) for c, t in df.dtypes]
    return df.select(*clean)


def rain_raster(cells: DataFrame, value: str, least: float = 0.1) -> DataFrame:
    """A raster frame in long form: values below `least` are missing."""
    return cells.withColumn(value, F.when(F.col(value) >= least, F.col(value)))


def rotate_raster(cells: DataFrame, n_rows: int, row: str = "row", column: str = "column") -> DataFrame:
    """Relabel a raster stored as longitude x latitude: a quarter turn to the left and rows reversed, a transposition."""
    return cells.withColumnsRenamed({row: "__r", column: row}).withColumnsRenamed({"__r": column}).filter(F.col(row) < n_rows)


def file_catalogue(spark: SparkSession, paths: str | Sequence[str], suffix: str | None = None) -> DataFrame:
    """path, timestamp: files of a folder or glob and the times in their names; files without one are left out."""
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select("path")
    if suffix:
        files = files.filter(F.col("path").endswith(suffix))
    return files.withColumn("timestamp", file_time("path")).filter(F.col("timestamp").isNotNull())


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files: timestamp from the file's name, properties and geometry as JSON text."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    feature = "array<struct<type:string,geometry:string,properties:string>>"
    parsed = text.withColumn("f", F.from_json("value", f"struct<features:{feature}>"))
    return parsed.select(file_time("path").alias("timestamp"), F.explode("f.features").alias("f")).select("timestamp", "f.geometry", "f.properties")


def matched_layers(frames: DataFrame, layers: DataFrame) -> DataFrame:
    """Every frame with its layer's features; a frame without a file has nulls."""
    return frames.join(layers, "timestamp", "left")
