"""Displacement of systems: start and end, distances, quadrants, wind roses, dominance, monthly statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import centroid, mercator_length_km, point_wkt, readable, wkt_rings
from ..functions.geometry import valid_centroid
from ..functions.scalar import bearing, cell_centre, haversine, month_start, quadrant_id, round_up_nicely, sector, wrap_longitude
from ..session import durable
from .ordered import rolling_mean
from .quantiles import exact_percentiles


def with_centroids(tracks: DataFrame, geometry: str = "geometry") -> DataFrame:
    """lon and lat from the centroid of WKT geometry; rows without readable geometry are left out."""
    rows = tracks.withColumn("__c", centroid(wkt_rings(geometry))).filter(F.col("__c.x").isNotNull())
    return rows.withColumn("lon", F.col("__c.x")).withColumn("lat", F.col("__c.y")).drop("__c")


def with_valid_centroids(tracks: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Like `with_centroids`, of rows whose geometry isn't blank and is a valid polygon, or several."""
    text = F.col(geometry)
    rows = tracks.filter(text.isNotNull() & (F.length(F.trim(text)) > 0)).withColumn("__c", valid_centroid(text)).filter("__c is not null")
    return rows.withColumn("lon", F.col("__c.x")).withColumn("lat", F.col("__c.y")).drop("__c")


def only(tracks: DataFrame, uids: DataFrame | None) -> DataFrame:
    """Rows of the given uids (a frame with a column uid), by a semi-join."""
    return tracks if uids is None else tracks.join(uids.select("uid"), "uid", "left_semi")


def repeated_steps(tracks: DataFrame) -> DataFrame:
    """uid, cindex, n of observations that share both; a table that is sound has none."""
    return tracks.groupBy("uid", "cindex").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def start_end_ties(tracks: DataFrame, uids: DataFrame | None = None) -> DataFrame:
    """Like `start_end`, where rows share the least or the greatest cindex: a row for every pair of a first and a last one, without lengths."""
    rows = only(tracks, uids).select("uid", "cindex", "timestamp", "lon", "lat")
    ends = rows.groupBy("uid").agg(F.min("cindex").alias("lo"), F.max("cindex").alias("hi"))
    at = lambda end, which, n: rows.join(ends.select("uid", F.col(end).alias("cindex")), ["uid", "cindex"]).select("uid", F.col("cindex").alias(f"{which}_cindex"), F.col("timestamp").alias(f"{which}_timestamp"), F.col("lon").alias(f"lon{n}"), F.col("lat").alias(f"lat{n}"))
    return at("lo", "start", 1).join(at("hi", "end", 2), "uid").withColumn("start_end_haversine_km", haversine("lat1", "lon1", "lat2", "lon2"))


def start_end(tracks: DataFrame, uids: DataFrame | None = None, geometry: str | None = None) -> DataFrame:
    """Per system the rows with the least and the greatest cindex: indices, times, positions, distance, and the length of
    the last row's trajectory where there is one. One aggregate, one shuffle. With `geometry` the positions are centroids
    of that column's WKT, which is parsed of these two rows; rows whose geometry can't be read don't count."""
    rows = only(tracks, uids)
    if geometry is not None:
        rows = rows.filter(readable(geometry))
    path = F.col("trajectory") if "trajectory" in tracks.columns else F.lit(None).cast("string")
    place = [F.col("lon"), F.col("lat")] if geometry is None else [F.col(geometry).alias("wkt")]
    point = F.struct("cindex", "timestamp", *place, path.alias("trajectory"))
    ends = rows.groupBy("uid").agg(F.min_by(point, "cindex").alias("a"), F.max_by(point, "cindex").alias("b"))
    if geometry is not None:
        centre = lambda e: e.withField("lon", F.col("c.x")).withField("lat", F.col("c.y"))
        for end in ("a", "b"):
            ends = ends.withColumn("c", centroid(wkt_rings(F.col(f"{end}.wkt")))).withColumn(end, centre(F.col(end))).drop("c")
    out = ends.select(
        "uid", F.col("a.cindex").alias("start_cindex"), F.col("b.cindex").alias("end_cindex"), F.col("a.timestamp").alias("start_timestamp"), F.col("b.timestamp").alias("end_timestamp"),
        F.col("a.lon").alias("lon1"), F.col("a.lat").alias("lat1"), F.col("b.lon").alias("lon2"), F.col("b.lat").alias("lat2"), F.col("b.trajectory").alias("trajectory"),
    )
    out = out.withColumn("start_end_haversine_km", haversine("lat1", "lon1", "lat2", "lon2"))
    if "trajectory" not in tracks.columns:
        return out.drop("trajectory")
    lines = wkt_rings("trajectory")
    return out.withColumns({"start_geometry": point_wkt("lon1", "lat1"), "end_geometry": point_wkt("lon2", "lat2"), "trajectory_length_km": mercator_length_km(lines)})


def distances(tracks: DataFrame, uids: DataFrame | None = None) -> DataFrame:
    return start_end(tracks, uids).select("uid", "start_end_haversine_km")


def hovmoller(tracks: DataFrame) -> DataFrame:
    """uid, min_timestamp, lat_bin: floor of the mean of the first and the last latitude, from -60 to 60."""
    ends = tracks.groupBy("uid").agg(F.min("timestamp").alias("min_timestamp"), F.min_by("lat", "cindex").alias("a"), F.max_by("lat", "cindex").alias("b"))
    return ends.select("uid", "min_timestamp", F.floor((F.col("a") + F.col("b")) / 2).cast("double").alias("lat_bin")).filter(F.col("lat_bin").between(-60, 60))


def hovmoller_counts(tracks: DataFrame) -> DataFrame:
    """Systems by month and latitude bin."""
    return hovmoller(tracks).groupBy(F.month("min_timestamp").alias("month"), "lat_bin").agg(F.count(F.lit(1)).alias("n"))


def hovmoller_table(tracks: DataFrame) -> DataFrame:
    """Latitude bins from north to south, a column for each month."""
    return hovmoller_counts(tracks).groupBy("lat_bin").pivot("month", list(range(1, 13))).agg(F.sum("n")).na.fill(0).orderBy(F.desc("lat_bin"))


def quadrant_grid(df: DataFrame, step: float = 10.0, lon_min: float = -180.0, lon_max: float = 180.0, lat_min: float = -60.0, lat_max: float = 60.0) -> DataFrame:
    """All quadrants: number, column, row from the south and from the north, bounds and centre."""
    spark = df.sparkSession
    n_cols, n_rows = int(round((lon_max - lon_min) / step)), int(round((lat_max - lat_min) / step))
    g = spark.range(n_cols * n_rows).select(F.col("id").cast("int").alias("quad_id"))
    g = g.withColumn("col", F.col("quad_id") % n_cols).withColumn("row_n", F.floor(F.col("quad_id") / n_cols).cast("int")).withColumn("row_s", n_rows - 1 - F.col("row_n"))
    g = g.withColumn("lon0", lon_min + F.col("col") * step).withColumn("lat0", lat_min + F.col("row_s") * step).withColumn("lon1", F.col("lon0") + step).withColumn("lat1", F.col("lat0") + step)
    return g.withColumn("lon_center", F.col("lon0") + step / 2).withColumn("lat_center", F.col("lat0") + step / 2)


def quadrant_summary(ends: DataFrame, step: float = 10.0, season_filter: Column | None = None) -> DataFrame:
    """Each quadrant's starts, ends, and commonest destination with its count (ties: the smallest number). Rows with
    either end outside the window don't count. Quadrants without any have 0, 0, -1, 0."""
    rows = ends if season_filter is None else ends.filter(season_filter)
    od = rows.select(quadrant_id("lon1", "lat1", step).alias("qs"), quadrant_id("lon2", "lat2", step).alias("qe")).na.drop().groupBy("qs", "qe").agg(F.count(F.lit(1)).alias("n"))
    starts = od.groupBy(F.col("qs").alias("quad_id")).agg(F.sum("n").alias("Qtdy_Start"), F.max_by(F.struct("qe", "n"), F.struct("n", -F.col("qe"))).alias("top"))
    stops = od.groupBy(F.col("qe").alias("quad_id")).agg(F.sum("n").alias("Qtdy_End"))
    out = quadrant_grid(ends, step).join(starts, "quad_id", "left").join(stops, "quad_id", "left")
    zero = F.lit(0).cast("long")
    return out.withColumn("Qtdy_Start", F.coalesce("Qtdy_Start", zero)).withColumn("Qtdy_End", F.coalesce("Qtdy_End", zero)).withColumn("Common_Dest", F.coalesce("top.qe", F.lit(-1))).withColumn("Common_Dest_Count", F.coalesce("top.n", zero)).drop("top")


def quadrant_arrows(summary: DataFrame) -> DataFrame:
    """Direction to the commonest destination as a unit vector (longitudes wrapped and shortened by the latitude's cosine),
    and whether more systems start or end in the quadrant."""
    dest = summary.select(F.col("quad_id").alias("d"), F.col("lon_center").alias("dx"), F.col("lat_center").alias("dy"))
    rows = summary.join(dest, F.col("Common_Dest") == F.col("d"), "left")
    x = wrap_longitude(F.col("dx") - F.col("lon_center")) * F.cos(F.radians("lat_center"))
    y = F.col("dy") - F.col("lat_center")
    length = F.sqrt(x * x + y * y)
    balance = F.when(F.col("Qtdy_Start") > F.col("Qtdy_End"), "start").when(F.col("Qtdy_End") > F.col("Qtdy_Start"), "end").otherwise("tie")
    return rows.select("quad_id", F.try_divide(x, length).alias("ux"), F.try_divide(y, length).alias("uy"), F.degrees(F.atan2(y, x)).alias("angle"), balance.alias("balance"))


def windrose(ends: DataFrame, step: float = 10.0, dir_bins: int = 16, dist_stat: str = "median", min_events: int = 1, lon_min: float = -180.0, lat_min: float = -60.0, gamma: float = 1.0, min_frac: float = 0.0) -> DataFrame:
    """Per start cell and direction: systems, a statistic of their distance, the cell's total and relative frequency, and
    the drawn radius (frequency over the cell's largest, to the power gamma, at least min_frac)."""
    stat = {"median": F.percentile("km", F.lit(0.5)), "mean": F.avg("km"), "p25": F.percentile("km", F.lit(0.25)), "p75": F.percentile("km", F.lit(0.75))}
    if dist_stat not in stat:
        raise ValueError(f"dist_stat must be one of {', '.join(stat)}")
    rows = ends.filter("lon1 is not null and lat1 is not null and lon2 is not null and lat2 is not null")
    rows = rows.select(cell_centre("lon1", lon_min, step).alias("cx"), cell_centre("lat1", lat_min, step).alias("cy"), sector(bearing("lat1", "lon1", "lat2", "lon2"), dir_bins).alias("sector"), F.col("start_end_haversine_km").alias("km"))
    by = rows.groupBy("cx", "cy", "sector").agg(F.count(F.lit(1)).alias("count"), stat[dist_stat].alias("dist_stat"))
    cell = W.partitionBy("cx", "cy")
    by = by.withColumn("cell_total", F.sum("count").over(cell)).filter(F.col("cell_total") >= min_events).withColumn("freq_rel", F.col("count") / F.col("cell_total"))
    return by.withColumn("radius", F.greatest(F.lit(float(min_frac)), F.pow(F.col("freq_rel") / F.max("freq_rel").over(cell), F.lit(float(gamma)))))


def dominance(ends: DataFrame, step: float = 10.0, alpha: float = 1.0, base: float = 10.0, min_total: float = 0.0, kind: str = "log") -> DataFrame:
    """Per cell: starts and ends, and the logarithm of (starts + alpha) / (ends + alpha), or their asymmetry; null where
    there are none or fewer than min_total."""
    point = lambda x, y, a, b: F.struct(cell_centre(x, -180.0, step).alias("cx"), cell_centre(y, -60.0, step).alias("cy"), F.lit(a).alias("s"), F.lit(b).alias("e"))
    both = ends.select(F.explode(F.array(point("lon1", "lat1", 1, 0), point("lon2", "lat2", 0, 1))).alias("p")).select("p.*").filter("cx is not null and cy is not null")
    cells = both.groupBy("cx", "cy").agg(F.sum("s").alias("starts"), F.sum("e").alias("ends"))
    s, e = F.col("starts"), F.col("ends")
    d = F.log((s + alpha) / (e + alpha)) / F.log(F.lit(base)) if kind == "log" else (s - e) / (s + e + alpha)
    return cells.withColumn("dominance", F.when((s + e > 0) & (s + e >= min_total), d))


def grid_step(ends: DataFrame) -> DataFrame:
    """One row, step: the 25th percentile of the distances, degrees; for the grid of `dominance`."""
    return exact_percentiles(ends, "start_end_haversine_km", (0.25,)).select((F.col("q")[0] / 111.0).alias("step"))


def sized_dominance(ends: DataFrame, **options) -> DataFrame:
    """`dominance` on a grid of the 25th percentile of the distances, degrees (one number comes to the driver)."""
    step = grid_step(ends).first()["step"]
    return dominance(ends, step=step if step else 10.0, **options)


def robust_scale(cells: DataFrame, value: str = "dominance") -> DataFrame:
    """One row, scale: the 98th percentile of the absolute values, rounded up to 1, 2, 2.5 or 5 times a power of ten."""
    return exact_percentiles(cells, F.abs(F.col(value)), (0.98,)).select(round_up_nicely(F.col("q")[0]).alias("scale"))


def monthly_distance(df: DataFrame, time_col: str = "start_timestamp", dist_col: str = "start_end_haversine_km", filter_max_km: float | None = None) -> DataFrame:
    """Per calendar month from the first to the last: n and the distances' mean, quartiles, p99, max, deviation and the
    half-width of the mean's 95 % interval; months without rows have n = 0."""
    # Times that can't be read count as missing.
    df = df.withColumn(time_col, F.col(time_col).try_cast("timestamp_ntz"))
    rows = df.filter(F.col(time_col).isNotNull() & F.col(dist_col).isNotNull())
    rows = rows if filter_max_km is None else rows.filter(F.col(dist_col) <= filter_max_km)
    d = F.col(dist_col)
    rows = rows.withColumn("month", month_start(time_col))
    q = exact_percentiles(rows, dist_col, (0.25, 0.5, 0.75, 0.99), ("month",))
    by = rows.groupBy("month").agg(F.avg(d).alias("mean"), F.max(d).alias("max"), F.stddev_samp(d).alias("std"), F.count(d).alias("n")).join(q, "month")
    by = by.select("month", "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"), "max", "std", "n", F.col("q")[3].alias("p99"))
    span = by.agg(F.min("month").alias("a"), F.max("month").alias("b")).filter("a is not null")
    calendar = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    out = calendar.join(by, "month", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("ci95", F.lit(1.96) * F.col("std") / F.sqrt(F.nullif(F.col("n"), F.lit(0).cast("long")).cast("double")))


def with_anomalies(monthly: DataFrame, rolling: int = 12, least: int = 6) -> DataFrame:
    """Climatology of the calendar month, anomaly, and rolling means over `rolling` months with `least` values at least."""
    clim = F.avg("mean").over(W.partitionBy(F.month("month")))
    out = monthly.withColumn("clim", clim).withColumn("anom", F.col("mean") - F.col("clim"))
    return rolling_mean(durable(out), "month", {"mean_roll12": "mean", "anom_roll12": "anom"}, rolling, least)


def extreme_months(monthly: DataFrame) -> DataFrame:
    """One row: the months of the greatest and of the least anomaly."""
    return monthly.agg(F.max_by("month", "anom").alias("warmest"), F.min_by("month", "anom").alias("coldest"))


def concordance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per quadrant of two summaries: whether starts minus ends has the same sign."""
    sign = lambda df, name: df.select("quad_id", F.signum((F.col("Qtdy_Start") - F.col("Qtdy_End")).cast("double")).alias(name))
    return sign(a, "sa").join(sign(b, "sb"), "quad_id").select("quad_id", (F.col("sa") == F.col("sb")).alias("concordant"))
