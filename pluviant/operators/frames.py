"""Operators over time steps: cumulative counts, occupancy, frame pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .ordered import last_before, positions, running_sum


def cumulative_new(tracks: DataFrame) -> DataFrame:
    """Per time step: systems first seen as NEW there, and their running number. A system counts once."""
    born = tracks.filter(F.col("status") == "NEW").groupBy("uid").agg(F.min("timestamp").alias("timestamp"))
    new = born.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n_new"))
    steps = tracks.select("timestamp").distinct().join(new, "timestamp", "left").withColumn("n_new", F.coalesce("n_new", F.lit(0).cast("long")))
    return running_sum(durable(steps), "timestamp", {"cumulative": "n_new"})


def cumulative_counts(tracks: DataFrame) -> DataFrame:
    """Per time step: its systems, and the running sum (systems count again at every step)."""
    by = tracks.groupBy("timestamp").agg(F.count_distinct("uid").alias("n"))
    return running_sum(durable(by), "timestamp", {"cumulative": "n"})


def on_steps(counts: DataFrame, steps: DataFrame, value: str = "n") -> DataFrame:
    """Counts on other time steps, 0 where there were none."""
    return steps.select("timestamp").distinct().join(counts, "timestamp", "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))


def all_steps(*frames: DataFrame) -> DataFrame:
    """The time steps of all frames, each once."""
    out = frames[0].select("timestamp")
    for f in frames[1:]:
        out = out.union(f.select("timestamp"))
    return out.distinct()


def index_range(df: DataFrame, first: str, last: str, column: str = "timestamp") -> DataFrame:
    """Rows from one time to another, both included."""
    return df.filter(F.col(column).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))


def total_bounds(df: DataFrame, envelope: Column) -> DataFrame:
    """One row: the bounds of all geometries."""
    e = df.select(envelope.alias("e"))
    return e.agg(F.min("e.xmin").alias("xmin"), F.min("e.ymin").alias("ymin"), F.max("e.xmax").alias("xmax"), F.max("e.ymax").alias("ymax"))


def pixel_occupancy(tracks: DataFrame, y: str = "array_y", x: str = "array_x") -> DataFrame:
    """Per pixel, in how many (system, time step) it was covered; a pixel counts once in each."""
    pixels = tracks.select("uid", "timestamp", F.explode(F.arrays_zip(F.col(y).alias("y"), F.col(x).alias("x"))).alias("p")).select("uid", "timestamp", "p.y", "p.x").na.drop(subset=["y", "x"])
    return pixels.distinct().groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"))


def match_frames(coarse: DataFrame, fine: DataFrame, repeat: int = 2, mode: str = "position") -> DataFrame:
    """Pairs of frames (path, timestamp): by position, each coarse one repeated, up to the shorter list; or by time, each
    fine frame with the last coarse one not after it."""
    if mode == "time":
        found = last_before(fine.select("timestamp", F.col("path").alias("fine")), coarse.select("timestamp", F.col("path").alias("coarse")), "timestamp", "coarse")
        return found.filter("fine is not null and coarse is not null").select("timestamp", "coarse", "fine")
    copies = coarse.select("timestamp", "path", F.explode(F.sequence(F.lit(1), F.lit(repeat))).alias("k"))
    a = positions(copies, "timestamp", "rn", ties=("path", "k")).select("rn", F.col("path").alias("coarse"))
    b = positions(fine, "timestamp", "rn", ties=("path",)).select("rn", "timestamp", F.col("path").alias("fine"))
    return a.join(b, "rn").select(F.col("rn").cast("int").alias("rn"), "timestamp", "coarse", "fine")


def in_box(xmin: float, ymin: float, xmax: float, ymax: float, envelope: Column) -> Column:
    """Geometries whose envelope meets the box."""
    return (envelope["xmin"] <= xmax) & (envelope["xmax"] >= xmin) & (envelope["ymin"] <= ymax) & (envelope["ymax"] >= ymin)
