"""Counts of new systems on a stream of track observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_systems(observations: DataFrame, window: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Systems by the window of their first NEW observation to arrive (on tables: the earliest); each counts once while it
    is within the watermark.

    Works on streams (readStream) and tables alike; `lateness` bounds the state.
    """
    new = observations.filter(F.col("status") == "NEW").withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", lateness)
    once = new.dropDuplicatesWithinWatermark(["uid"]) if observations.isStreaming else new.groupBy("uid").agg(F.min("timestamp").alias("timestamp"))
    by = once.groupBy(F.window("timestamp", window)).agg(F.count(F.lit(1)).alias("n_new"))
    return by.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_new")
