"""Exact percentiles of groups of any size: a mergeable sketch gives bounds around each one, and only values between them are sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import _same

#: Of a sketch: a value's rank is off by 1 / ACCURACY of the group at most. Bounds are four times that away.
ACCURACY = 20_000


def exact_percentiles(df: DataFrame, value: str | Column, shares: tuple[float, ...], by: tuple[str, ...] = (), out: str = "q") -> DataFrame:
    """Columns `by` and `out`, an array of the percentiles at `shares`, interpolated between neighbouring values. Nulls and NaN don't
    count; a group without values has null; without `by` there is one row.

    One pass makes a sketch for each group. A second one counts what is below a percentile's bounds, as one row for each task, and equal
    values between them, so what has to be sorted in one task is at most 8 / ACCURACY of a group's values, or ACCURACY values.
    """
    by = list(by)
    rows = df.select(*by, (F.col(value) if isinstance(value, str) else value).cast("double").alias("__v"))
    v = F.when(~F.isnan("__v"), F.col("__v"))
    far = 4 / ACCURACY
    sketch = F.percentile_approx(v, [max(0.0, min(1.0, s + d)) for s in shares for d in (-far, far)], ACCURACY)
    groups = rows.groupBy(*by).agg(F.count(v).alias("__n"), F.min(v).alias("__min"), F.max(v).alias("__max"), sketch.alias("__b"))
    few = F.col("__n") < 4 / far  # bounds would be less than four values away
    bound = lambda k, end, out: F.col(end) if out else F.when(few, F.col(end)).otherwise(F.col("__b")[k])
    bins = F.array(*[F.struct(F.lit(k).alias("i"), F.lit(float(s)).alias("share"), bound(2 * k, "__min", s <= far).alias("low"), bound(2 * k + 1, "__max", s >= 1 - far).alias("high")) for k, s in enumerate(shares)])
    bins = groups.filter("__n > 0").select(*by, "__n", bins.alias("__bins"))
    near = rows.filter("not isnan(__v)")
    near = _same(near, bins, by) if by else near.crossJoin(F.broadcast(bins))  # one row without groups
    slot = F.transform(F.filter("__bins", lambda b: F.col("__v") <= b["high"]), lambda b: F.struct(b["i"].alias("i"), b["share"].alias("share"), F.when(F.col("__v") >= b["low"], F.col("__v")).alias("v")))
    counts = near.select(*by, "__n", F.explode(slot).alias("__s")).groupBy(*by, "__n", "__s.i", "__s.share", "__s.v").agg(F.count(F.lit(1)).alias("__c"))
    # Null stands for all values below the bounds and comes first.
    upto = F.sum("__c").over(W.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    at = (F.col("__n") - 1) * F.col("share")
    here = lambda rank: F.max(F.when((F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank), F.col("v")))
    picked = counts.withColumn("__upto", upto).groupBy(*by, "__n", "i", "share").agg(here(F.floor(at)).alias("a"), here(F.ceil(at)).alias("z"))
    sure = F.when(F.col("a").isNull() | F.col("z").isNull(), F.raise_error(F.lit("a percentile is outside its bounds")).cast("double")).otherwise(F.col("a") + (F.col("z") - F.col("a")) * (at - F.floor(at)))
    # Equal infinities have no difference.
    each = F.when(F.col("a") == F.col("z"), F.col("a")).otherwise(sure)
    found = picked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", each.alias("q")))).alias("__q"))
    every = groups.select(*by)
    whole = _same(every, found, by, "left") if by else every.join(F.broadcast(found), F.lit(True), "left")
    return whole.select(*by, F.when(F.size("__q") > 0, F.transform("__q", lambda x: x["q"])).alias(out))
