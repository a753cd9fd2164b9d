"""Statistics and classes of tracked systems (one row for each uid, time step and threshold)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import is_day, is_ocean, pixel_speed, season
from .ordered import _same
from .quantiles import exact_percentiles

METHODS = {"noc": "far_", "opt": "far_opt", "inc": "far_inc", "spl": "far_spl", "mrg": "far_mrg", "elp": "far_elp"}


def duration_stats(tracks: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Per final duration: systems, their share in percent, mean and sample deviation of size.

    Systems are summed first, so one row a uid reaches the second shuffle.
    """
    rows = tracks.filter(F.col("threshold") == F.lit(threshold))
    each = rows.groupBy("uid").agg(F.max("duration").alias("duration"), F.count("size").alias("n"), F.sum("size").alias("s"), F.var_pop("size").alias("v"))
    # Squares are summed from the overall mean, so that they don't cancel where sizes are large and alike.
    each = each.crossJoin(F.broadcast(each.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("k"))))
    off = F.try_divide("s", "n") - F.col("k")
    each = each.withColumn("q", F.col("n") * (F.col("v") + off * off)).withColumn("s", F.col("n") * off)
    by = each.groupBy("duration").agg(F.count(F.lit(1)).alias("uid_count"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.first("k").alias("k"))
    share = F.lit(100.0) * F.col("uid_count") / F.sum("uid_count").over(W.partitionBy())
    deviation = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))))
    mean = F.when(F.col("n") > 0, F.col("k") + F.col("s") / F.col("n"))
    return by.select("duration", "uid_count", F.round(share, 2).alias("percentage"), F.round(mean, 2).alias("mean_size"), F.round(deviation, 2).alias("std_size")).orderBy("duration")


def classify(tracks: DataFrame, threshold: float | None = None, features: bool = False) -> DataFrame:
    """Per (uid, threshold): Continuous if it begins once and goes on otherwise; latitudes; surface; start and end.

    Labels that are all missing count as all tropical and all ocean.
    """
    rows = tracks if threshold is None else tracks.filter(F.col("threshold") == F.lit(threshold))
    ocean = F.count_if(is_ocean("region"))
    n = F.count("status")
    aggs = [
        F.max("duration").alias("duration"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.when((F.count_if(F.col("status") == "NEW") == 1) & (F.count_if(F.col("status") == "CON") == n - 1), "Continuous").otherwise("Non-Continuous").alias("classification"),
        F.when(F.count_if(F.col("latitude") == "Tropical") == F.count("latitude"), "Tropical").otherwise("Extratropical").alias("latitude_region"),
        F.when(ocean == F.count("region"), "Ocean").when(ocean > 0, "Transition").otherwise("Land").alias("surface_type"),
    ]
    if features:
        aggs += [F.avg("size").alias("mean_size"), F.max("max").alias("max_precipitation"), F.max("inside_clusters").alias("max_n_clusters")]
    return rows.groupBy("uid", "threshold").agg(*aggs)


def _valid(far: Column) -> Column:
    return far.isNotNull() & (far != 1)


def _far_list() -> Column:
    return F.filter(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("far")) for m, c in METHODS.items()]), lambda s: _valid(s["far"]))


def method_duels(tracks: DataFrame) -> DataFrame:
    """For rows whose own method has the least false-alarm ratio: it against every other valid method.

    The six ratios of a row are compared inside the row, so there is no join and one small shuffle.
    """
    rows = tracks.select("method", _far_list().alias("fars")).filter(F.size("fars") > 0)
    rows = rows.withColumn("least", F.array_min(F.transform("fars", lambda s: s["far"])))
    rows = rows.filter(F.exists("fars", lambda s: (s["method"] == F.col("method")) & (s["far"] == F.col("least"))))
    duels = rows.select("method", "least", F.explode(F.filter("fars", lambda s: s["method"] != F.col("method"))).alias("o"))
    return duels.groupBy("method", F.col("o.method").alias("opponent_method")).agg(
        F.count(F.lit(1)).alias("n_duels"), F.avg("least").alias("mean_far_winner"), F.avg("o.far").alias("mean_far_opponent"), F.avg(F.col("o.far") - F.col("least")).alias("mean_far_gap")
    )


def stratified_far(tracks: DataFrame, step_minutes: float = 30) -> DataFrame:
    """Valid rows with their event's means, and classes of size and duration against all events (mean, mean + deviation)."""
    far = F.col("far")
    rows = tracks.filter(_valid(far) & (far != 0) & (F.col("status") != "NEW") & F.col("size").isNotNull() & F.col("duration").isNotNull())
    event = W.partitionBy("uid")
    means = {"mean_size": F.avg("size"), "duration_event": F.max("duration"), "u_ms": F.avg(pixel_speed("u_", step_minutes)), "v_ms": F.avg(pixel_speed("v_", step_minutes))}
    events = rows.groupBy("uid").agg(F.avg("size").alias("s"), F.max("duration").alias("d"))
    limits = events.agg(F.avg("s").alias("s1"), (F.avg("s") + F.stddev_samp("s")).alias("s2"), F.avg("d").alias("d1"), (F.avg("d") + F.stddev_samp("d")).alias("d2"))
    every = F.count(F.lit(1)).over(event)
    rows = rows.withColumns({k: v.over(event) for k, v in means.items()}).withColumn("going_on", F.count_if(F.col("status") == "CON").over(event) == every)
    rows = rows.crossJoin(F.broadcast(limits))
    others = F.array_join(F.filter(F.transform(_far_list(), lambda s: s["method"]), lambda m: m != F.col("method")), ", ")
    size = F.when(F.col("mean_size") < F.col("s1"), "Small").when(F.col("mean_size") < F.col("s2"), "Medium").otherwise("Large")
    duration = F.when(F.col("duration_event") < F.col("d1"), "Short").when(F.col("duration_event") < F.col("d2"), "Medium").otherwise("Long")
    kind = F.when(F.col("going_on"), "Continuous").otherwise("Non-Continuous")
    return rows.select("uid", kind.alias("classification"), "method", others.alias("other_methods"), "far", "size", "lifetime", *means, size.alias("size_class"), duration.alias("duration_class"))


def class_durations(tracks: DataFrame, add_minutes: int = 0) -> DataFrame:
    """The last known duration of each system, hours, with its class: a row for each system and class."""
    last = tracks.filter(F.col("duration").isNotNull()).groupBy("uid").agg(F.max_by("duration", "timestamp").alias("last_duration"))
    each = classify(tracks).select("uid", "classification").distinct().join(last, "uid")
    return each.select("classification", "uid", ((F.col("last_duration") + add_minutes) / 60).alias("hours"))


def evolution(tracks: DataFrame, delta_hours: float = 0.0, solar_wrap: bool = False, centroid: str | None = None) -> DataFrame:
    """Rows as a life cycle: hours since birth, area in cells, surface, day or night. A narrow projection."""
    surface = F.when(F.col("region").isNull(), "Land").when(is_ocean("region"), "Ocean").otherwise("Land")
    out = [
        "uid", "timestamp", (F.col("lifetime") / F.lit(60.0) - delta_hours).alias("lifetime"), (F.col("size") / F.lit(0.01)).alias("size"),
        F.when(F.col("latitude").like("%Tropical%"), "Tropical").otherwise("Extratropical").alias("latitude"), surface.alias("region_type"), "region",
        is_day("timestamp", "lon", solar_wrap).alias("day_night"), F.col("max").alias("max_precipitation"), F.col("mean").alias("mean_precipitation"), "inside_clusters",
    ]
    return tracks.select(*out, *([F.col(centroid).alias("centroid_wkt")] if centroid else []))


def census(tracks: DataFrame) -> DataFrame:
    """Systems by year, month and season of their first time step."""
    first = tracks.groupBy("uid").agg(F.min("timestamp").alias("t"))
    parts = first.select(F.year("t").alias("year"), F.month("t").alias("month")).withColumn("season", season("month"))
    return parts.groupBy("year", "month", "season").agg(F.count(F.lit(1)).alias("count")).orderBy("year", "month")


def census_compare(a: DataFrame, b: DataFrame, suffixes: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two censuses side by side, their difference and ratio."""
    key = ["year", "month", "season"]
    both = a.withColumnRenamed("count", f"count_{suffixes[0]}").join(b.withColumnRenamed("count", f"count_{suffixes[1]}"), key)
    x, y = F.col(f"count_{suffixes[0]}"), F.col(f"count_{suffixes[1]}")
    return both.withColumn("difference", x - y).withColumn("ratio", F.try_divide(x.cast("double"), y))


def difference_stats(compared: DataFrame) -> DataFrame:
    """One row of two censuses: months, mean and sample deviation of their differences."""
    return compared.agg(F.count("difference").alias("n_months"), F.avg("difference").alias("mean_difference"), F.stddev_samp("difference").alias("std_difference"))


def season_trend(counts: DataFrame, value: str = "count") -> DataFrame:
    """Per season: slope and intercept of the yearly sums against 0, 1, 2, ..."""
    yearly = counts.groupBy("season", "year").agg(F.sum(value).alias("v"))
    at = (F.row_number().over(W.partitionBy("season").orderBy("year")) - 1).alias("x")
    return yearly.select("season", "v", at).groupBy("season").agg(F.count(F.lit(1)).alias("n_years"), F.sum("v").alias("total"), F.avg("v").alias("mean"), F.regr_slope("v", "x").alias("slope"), F.regr_intercept("v", "x").alias("intercept"))


def short_long_split(stats: DataFrame) -> DataFrame:
    """Systems of less than 3 h, of 3 h and more, and of more than 24 h, and shares of those up to 24 h (the long share
    counts systems beyond 24 h too, so it may exceed 100)."""
    of = lambda cond: F.sum(F.when(cond, F.col("uid_count")).otherwise(0))
    d = F.col("duration")
    s = stats.agg(of(d < 180).alias("n_short"), of(d >= 180).alias("n_long"), of(d > 1440).alias("n_over_day"), of(d <= 1440).alias("n_day"))
    share = lambda c: F.round(F.try_divide(F.lit(100.0) * F.col(c), F.col("n_day")), 4)
    return s.withColumn("perc_short", share("n_short")).withColumn("perc_long", share("n_long"))


def histogram2d(df: DataFrame, x: str, y: str, x_edges: tuple[float, float, int], y_edges: tuple[float, float, int]) -> DataFrame:
    """Counts of equal bins (first edge, width, number of bins); the last edge belongs to the last bin, the rest drops out."""

    def bin_of(c: str, first: float, width: float, n: int) -> Column:
        b = F.floor((F.col(c) - first) / width)
        return F.when(F.col(c) == first + n * width, n - 1).when((b >= 0) & (b < n), b).cast("int")

    rows = df.select(bin_of(x, *x_edges).alias("bx"), bin_of(y, *y_edges).alias("by")).na.drop()
    return rows.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("count"))


def describe(df: DataFrame, by: str, value: str) -> DataFrame:
    """count, mean, sample and population deviation, extremes and exact quartiles of each group."""
    out = df.groupBy(by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.stddev_pop(value).alias("std_pop"), F.min(value).alias("min"), F.max(value).alias("max"))
    out = _same(out, exact_percentiles(df, value, (0.25, 0.5, 0.75), (by,)), [by])
    return out.select(by, "count", "mean", "std", "std_pop", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles, mean, and whiskers: the last values within 1.5 times the quartile distance."""
    q = describe(df, by, value).select(F.col(by).alias("g"), "count", "mean", "p25", "p50", "p75")
    reach = F.lit(1.5) * (F.col("p75") - F.col("p25"))
    low, high = F.col("p25") - reach, F.col("p75") + reach
    rows = df.select(by, value).join(q, F.col(by).eqNullSafe(F.col("g")))
    v = F.col(value)
    return rows.groupBy(by, "count", "mean", "p25", "p50", "p75").agg(F.min(F.when(v >= low, v)).alias("whisker_low"), F.max(F.when(v <= high, v)).alias("whisker_high"))


def percent_histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Equal bins between the extremes and the share of each, percent."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(span))
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))))
    by = rows.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return by.withColumn("percent", F.lit(100.0) * F.col("count") / F.sum("count").over(W.partitionBy()))


def density(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Gaussian kernel density (bandwidth by Scott's rule) at the centres of equal bins between the extremes. Equal values
    are counted first; null without a spread."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"), (F.stddev_samp(value) * F.pow(F.count(value).cast("double"), F.lit(-0.2))).alias("h"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(span))
    each = counts.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    z = (F.col("centre") - F.col("v")) / F.col("h")
    part = F.when(F.col("h") > 0, F.col("c") * F.exp(-z * z / 2) / (F.col("h") * F.col("n") * 2.5066282746310002))
    return each.groupBy("bin", "centre").agg(F.sum(part).alias("density"))


def labelled_union(frames: dict[str, DataFrame], label: str) -> DataFrame:
    """Frames one below the other, by column name, each row with its frame's name."""
    out = None
    for name, df in frames.items():
        df = df.withColumn(label, F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def distinct_list(df: DataFrame, by: str, value: str) -> DataFrame:
    """Each group's distinct values in order; for groups of a bounded number of them."""
    return df.groupBy(by).agg(F.sort_array(F.collect_set(value)).alias(value))


def start_of_each(tracks: DataFrame) -> DataFrame:
    """First row of each system by time."""
    return tracks.groupBy("uid").agg(F.min_by(F.struct(*[c for c in tracks.columns if c != "uid"]), F.struct("timestamp", "cindex")).alias("r")).select("uid", "r.*")
