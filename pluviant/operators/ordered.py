"""Ordered work without one task for the whole order: running sums, positions, the last row before, rolling means.

Rows are dealt to buckets of the order's key. Bounds of the buckets are percentiles of the key from a mergeable sketch, of which at
most BUCKETS - 1 come to the driver; so every use of a bucket means the same rows. What a bucket needs from those before it
comes from one row for each bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of an order.
BUCKETS = 64


def bucket_bounds(df: DataFrame, key: str, buckets: int = BUCKETS) -> list:
    """Distinct bounds between buckets of about equally many rows, in order; nulls don't count. One job."""
    shares = [k / buckets for k in range(1, buckets)]
    found = df.agg(F.percentile_approx(key, shares, 100 * buckets).alias("b")).first()["b"]
    return sorted(set(found or []))


def bucket_of(key: str, bounds: list, kind: str) -> Column:
    """The number of bounds not above the key, by halving; null keys come first, as in the order."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        bound = bounds[middle] if isinstance(bounds[middle], int | float) else str(bounds[middle])
        return F.when(F.col(key) < F.lit(bound).cast(kind), among(low, middle)).otherwise(among(middle + 1, high))

    return F.when(F.col(key).isNull(), 0).otherwise(among(0, len(bounds)))


def _dealt(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("__bucket", bucket_of(key, bucket_bounds(df, key, buckets), df.schema[key].dataType.simpleString()))


def _earlier(parts: DataFrame, by: list[str], value: Column, out: str) -> DataFrame:
    """For each row of `parts` (by, __bucket and one row each), `value` over its group's rows of earlier buckets.

    Each bucket's row is copied to the later buckets, at most BUCKETS rows for one, so there is no theta join.
    """
    last = F.max("__bucket").alias("__last")
    ends = parts.groupBy(*by).agg(last) if by else parts.groupBy(F.lit(1).alias("__all")).agg(last).drop("__all")
    wide = _same(parts, ends, by) if by else parts.crossJoin(ends)
    later = wide.filter("__bucket < __last").withColumn("__to", F.explode(F.sequence(F.col("__bucket") + 1, F.col("__last"))))
    return later.groupBy(*by, "__to").agg(value.alias(out)).withColumnRenamed("__to", "__bucket")


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys, nulls being equal; columns of a, then the others of b."""
    b = b.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return a.join(b, on, how).drop(*[f"__r_{k}" for k in keys])


def running_sum(df: DataFrame, key: str, sums: dict[str, str], by: tuple[str, ...] = (), ties: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """df with, for each name in `sums`, the sum of that column over the rows of the group `by` up to this one by key and `ties` (nulls first).

    Rows equal in key and ties come in any order. A sum over nothing but nulls is null, as of a window.
    """
    by, rows = list(by), _dealt(df, key, buckets)
    parts = rows.groupBy(*by, "__bucket").agg(*[F.sum(c).alias(f"__sum_{n}") for n, c in sums.items()])
    totals = None
    for n in sums:
        one = _earlier(parts.select(*by, "__bucket", f"__sum_{n}"), by, F.sum(f"__sum_{n}"), f"__before_{n}")
        totals = one if totals is None else _same(totals, one, [*by, "__bucket"])
    order = W.partitionBy(*by, "__bucket").orderBy(key, *ties).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumns({f"__own_{n}": F.sum(c).over(order) for n, c in sums.items()})
    out = _same(local, totals, [*by, "__bucket"], "left")
    both = lambda n: F.when(F.col(f"__own_{n}").isNull(), F.col(f"__before_{n}")).otherwise(F.col(f"__own_{n}") + F.coalesce(F.col(f"__before_{n}"), F.lit(0)))
    return out.select(*df.columns, *[both(n).alias(n) for n in sums])


def positions(df: DataFrame, key: str, out: str, by: tuple[str, ...] = (), ties: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """df with each row's number in its group, from 1, by key and `ties`."""
    return running_sum(df.withColumn("__one", F.lit(1).cast("long")), key, {out: "__one"}, by, ties, buckets).drop("__one")


def neighbours(df: DataFrame, key: str, before: str, after: str, buckets: int = BUCKETS) -> DataFrame:
    """df, whose key doesn't repeat, with the next lower and the next higher key, null at the ends."""
    rows = _dealt(df, key, buckets)
    parts = rows.groupBy("__bucket").agg(F.min(key).alias("__min"), F.max(key).alias("__max"))
    lower = _earlier(parts, [], F.max("__max"), "__lower")
    higher = parts.filter("__bucket > 0").withColumn("__to", F.explode(F.sequence(F.lit(0), F.col("__bucket") - 1))).groupBy(F.col("__to").alias("__bucket")).agg(F.min("__min").alias("__higher"))
    order = W.partitionBy("__bucket").orderBy(key)
    local = rows.withColumn("__before", F.lag(key).over(order)).withColumn("__after", F.lead(key).over(order))
    out = local.join(lower, "__bucket", "left").join(higher, "__bucket", "left")
    return out.select(*df.columns, F.coalesce("__before", "__lower").alias(before), F.coalesce("__after", "__higher").alias(after))


def last_before(left: DataFrame, right: DataFrame, key: str, value: str, by: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """left with `value` of the last row of `right` in the same group whose key isn't greater, null without one.

    Of rows of right with one key the one with the greatest value counts; null keys and values don't. Rows of left with a null key get null.
    """
    by, kind = list(by), left.schema[key].dataType.simpleString()
    right = right.select(*by, F.col(key).cast(kind), value).na.drop(subset=[key, value]).groupBy(*by, key).agg(F.max(value).alias(value))
    own = [c for c in left.columns if c != value]
    row = F.struct(*own).alias("__row")
    both = left.select(*by, key, row, F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(right.select(*by, key, F.lit(None).cast(left.select(row).schema["__row"].dataType).alias("__row"), value))
    rows = _dealt(both, key, buckets)
    parts = rows.groupBy(*by, "__bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(key))).alias("__v"))
    carried = _earlier(parts, by, F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__bucket"))), "__carried")
    order = W.partitionBy(*by, "__bucket").orderBy(key, F.col(value).isNull()).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("__local", F.last(value, ignorenulls=True).over(order)).filter("__row is not null").drop(value)
    out = _same(local, carried, [*by, "__bucket"], "left")
    got = F.when(F.col(key).isNotNull(), F.coalesce("__local", "__carried"))
    return out.select("__row", got.alias(value)).select("__row.*", value)


def rolling_mean(df: DataFrame, key: str, means: dict[str, str], rows: int, least: int, buckets: int = BUCKETS) -> DataFrame:
    """df with, for each name in `means`, that column's mean over this row and the `rows` - 1 before it by key (which doesn't repeat);
    null where fewer than `least` of them have a value. Each row is sent to the `rows` positions that it counts for."""
    placed = positions(df, key, "__at", buckets=buckets)
    sent = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("__ahead")).withColumn("__to", F.col("__at") + F.col("__ahead"))
    by = sent.groupBy("__to").agg(*[F.when(F.count(c) >= least, F.avg(c)).alias(n) for n, c in means.items()])
    return placed.join(by, F.col("__at") == F.col("__to")).drop("__at", "__to")
