"""Exact deduplication by a 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import SPACE


def normalised(text: Column) -> Column:
    """Every run of whitespace becomes one space; null counts as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row for each row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after `normalised`. Rows are grouped by hash and, inside a hash group, by whole
    bytes, so two texts under one hash stay apart. Copies are summed before the shuffle, so a text with a third of all
    rows sends one row from each task, and rows learn of their group by hash and digest without carrying their text.
    `content_hash` is the grouping hash (128 bits by default); a weaker one costs time, not correctness.

    Null texts equal empty ones. A null id is never the smallest; a group of null ids only has keep_id null and is
    kept. Rows that repeat an id with an equal text are one document and share its verdict. An empty table gives none.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("norm")).withColumn("h", content_hash(F.col("norm")))
    exact = (
        rows.groupBy("h", "norm")
        .agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("h").alias("gh"), F.sha2("norm", 256).alias("gs"), "keep", "n")
    )
    each = rows.select("id", "h", F.sha2("norm", 256).alias("sha"))
    found = F.col("n").isNotNull()
    keep = F.when(found, F.col("keep")).otherwise(F.col("id"))
    return each.join(exact, (F.col("h") == F.col("gh")) & (F.col("sha") == F.col("gs")), "left").select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
