"""Writing results, and reusing those already written."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write and return the written table."""
    df.write.mode(mode).option("compression", compression).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def state_of(spark: SparkSession, patterns: Sequence[str]) -> list[tuple[str, int, int]]:
    """Path, length and time of change of the files of paths and patterns; folders count with what is directly in them."""
    out = []
    for pattern in patterns:
        p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        system = p.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in system.globStatus(p) or ():
            files = system.listStatus(found.getPath()) if found.isDirectory() else [found]
            out += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files]
    return sorted(out)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], parameters: dict | None = None, force: bool = False, inputs: Sequence[str] = ()) -> DataFrame:
    """The table at `path` for these parameters and the present state of the input files: read if it was written before, else built and written.

    Both are part of the folder's name, so another threshold, another file or a changed one is another table.
    """
    what = [parameters or {}, state_of(spark, inputs)] if inputs else parameters or {}
    key = hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:16]
    at = f"{path}/{key}"
    if force or not _exists(spark, f"{at}/_SUCCESS"):
        write_parquet(build(), at)
    return spark.read.parquet(at)
