"""Registered queries of the library, and DuckDB SQL that computes the same from the same tables in another shape."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..functions import geometry as G
from ..functions.geo import centroid, envelope, is_valid_polygon, mercator_length_km, wkt_rings
from ..operators import frames, grid, motion, quantiles, regions, tally, tracks, trend
from ..sources import adapters as A
from ..sources.readers import tracking_view
from ..streaming.new_systems import new_systems

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Decimal places to which a query's doubles are rounded.
PLACES: dict[str, int] = {}
ORACLE_SQL: dict[str, str] = {}

_VIEWS = {
    "track_obs": A.TRACK_OBS,
    "track_ship": A.TRACK_SHIP,
    "grid_month": A.GRID_MONTH,
    "ends_obs": """
  SELECT a.uid, a.cindex AS start_cindex, b.cindex AS end_cindex, a.timestamp AS start_timestamp, b.timestamp AS end_timestamp, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2,
    6371 * 2 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))) AS km
  FROM (SELECT uid, min(cindex) AS lo, max(cindex) AS hi FROM {t} GROUP BY uid) m
  JOIN {t} a ON a.uid = m.uid AND a.cindex = m.lo JOIN {t} b ON b.uid = m.uid AND b.cindex = m.hi""",
}


def _with(*names: str) -> str:
    """WITH clause of the named views; ends is over the track table named before it."""
    parts = []
    for n in names:
        if n == "ends":
            parts.append(f"ends AS ({_VIEWS['ends_obs'].replace('{t}', names[names.index(n) - 1])})")
        else:
            parts.append(f"{n} AS ({_VIEWS[n]})")
    return "WITH " + ",\n".join(parts) + "\n"


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, as engines add in different orders; no negative zeros."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _tidy_sql(sql: str, *doubles: str, views: tuple[str, ...] = (), places: int = 6) -> str:
    rounded = ", ".join(f"round({d}, {places}) + 0.0 AS {d}" for d in doubles)
    body = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if doubles else f"SELECT * FROM ({sql})"
    return (_with(*views) if views else "") + body


def query(name: str, sql: str | None = None, doubles: tuple[str, ...] = (), views: tuple[str, ...] = (), places: int = 6) -> Callable[[Query], Query]:
    """Register a query; large values need fewer places."""

    def add(f: Query) -> Query:
        PLACES[name] = places
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir), places)
        if sql:
            ORACLE_SQL[name] = _tidy_sql(sql, *doubles, views=views, places=places)
        return f

    return add


# Tracks


@query("duration_stats", """
SELECT duration, uid_count, round(100.0 * uid_count / total, 2) AS percentage, round(mean_size, 2) AS mean_size, round(std_size, 2) AS std_size
FROM (SELECT f.duration, count(DISTINCT b.uid) AS uid_count, avg(b.size) AS mean_size, stddev_samp(b.size) AS std_size
      FROM (SELECT * FROM track_obs WHERE threshold = 0.1) b JOIN (SELECT uid, max(duration) AS duration FROM track_obs WHERE threshold = 0.1 GROUP BY uid) f USING (uid) GROUP BY f.duration),
     (SELECT count(DISTINCT uid) AS total FROM track_obs WHERE threshold = 0.1)""", ("percentage", "mean_size", "std_size"), ("track_obs",), 2)
def duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.duration_stats(A.track_obs(spark, sf_dir))


_SEA = "(region ILIKE '%ocean%' OR region ILIKE '%sea%' OR region ILIKE '%mediterranean%')"
# Whatever breaks a class is counted: a system is Continuous if it has one NEW and nothing else but CON.
_CLASSIFY = f"""
  SELECT uid, threshold, max(duration) AS duration, min(timestamp) AS start_time, max(timestamp) AS end_time,
    if(count(*) FILTER (status = 'NEW') = 1 AND count(*) FILTER (status NOT IN ('NEW', 'CON')) = 0, 'Continuous', 'Non-Continuous') AS classification,
    if(bool_or(latitude <> 'Tropical'), 'Extratropical', 'Tropical') AS latitude_region,
    CASE WHEN NOT coalesce(bool_or(NOT {_SEA}), false) THEN 'Ocean' WHEN bool_or({_SEA}) THEN 'Transition' ELSE 'Land' END AS surface_type{{more}}
  FROM track_obs GROUP BY uid, threshold"""


@query("classify_events", _CLASSIFY.replace("{more}", ""), (), ("track_obs",))
def classify_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.classify(A.track_obs(spark, sf_dir))


@query("classify_events_features", _CLASSIFY.replace("{more}", ", avg(size) AS mean_size, max(\"max\") AS max_precipitation, max(inside_clusters) AS max_n_clusters"), ("mean_size", "max_precipitation"), ("track_obs",))
def classify_events_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.classify(A.track_obs(spark, sf_dir), features=True)


_NAMES = ", ".join(f"'{m}'" for m in tracks.METHODS)


@query("method_duels", f"""
SELECT method, opponent AS opponent_method, count(*) AS n_duels, avg(own) AS mean_far_winner, avg(theirs) AS mean_far_opponent, avg(theirs - own) AS mean_far_gap
FROM (
  SELECT method, own, unnest([{_NAMES}]) AS opponent, unnest(fars) AS theirs
  FROM (SELECT method, fars, fars[list_position([{_NAMES}], method)] AS own FROM (SELECT method, list_transform([{", ".join(tracks.METHODS.values())}], lambda f: nullif(f, 1)) AS fars FROM track_obs))
  WHERE own = list_min(fars))
WHERE opponent <> method AND theirs IS NOT NULL GROUP BY ALL""", ("mean_far_winner", "mean_far_opponent", "mean_far_gap"), ("track_obs",))
def method_duels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.method_duels(A.track_obs(spark, sf_dir))


_OTHERS = " || ".join(f"CASE WHEN method <> '{m}' AND {c} IS NOT NULL AND {c} <> 1 THEN '{m}, ' ELSE '' END" for m, c in tracks.METHODS.items())


@query("stratified_far", f"""
WITH v AS (SELECT * FROM track_obs WHERE far IS NOT NULL AND far <> 1 AND far <> 0 AND status <> 'NEW' AND size IS NOT NULL AND duration IS NOT NULL),
e AS (SELECT uid, avg(size) AS mean_size, max(duration) AS duration_event, avg(u_ * 0.1 * 111000.0 / (30 * 60.0)) AS u_ms, avg(v_ * 0.1 * 111000.0 / (30 * 60.0)) AS v_ms,
        CASE WHEN count(*) = sum(CASE WHEN status = 'CON' THEN 1 ELSE 0 END) THEN 'Continuous' ELSE 'Non-Continuous' END AS classification FROM v GROUP BY uid),
g AS (SELECT avg(mean_size) AS s1, avg(mean_size) + stddev_samp(mean_size) AS s2, avg(duration_event) AS d1, avg(duration_event) + stddev_samp(duration_event) AS d2 FROM e)
SELECT v.uid, classification, method, regexp_replace({_OTHERS}, ', $', '') AS other_methods, far, size, lifetime, mean_size, duration_event, u_ms, v_ms,
  CASE WHEN mean_size < s1 THEN 'Small' WHEN mean_size < s2 THEN 'Medium' ELSE 'Large' END AS size_class,
  CASE WHEN duration_event < d1 THEN 'Short' WHEN duration_event < d2 THEN 'Medium' ELSE 'Long' END AS duration_class
FROM v JOIN e USING (uid), g""", ("far", "size", "mean_size", "u_ms", "v_ms"), ("track_obs",))
def stratified_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.stratified_far(A.track_obs(spark, sf_dir))


@query("class_durations", f"""
WITH c AS ({_CLASSIFY.replace('{more}', '')}), d AS (SELECT uid, arg_max(duration, timestamp) AS last_duration FROM track_obs WHERE duration IS NOT NULL GROUP BY uid)
SELECT classification, uid, (last_duration + 30) / 60 AS hours FROM (SELECT DISTINCT uid, classification FROM c) JOIN d USING (uid)""", ("hours",), ("track_obs",))
def class_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.class_durations(A.track_obs(spark, sf_dir), add_minutes=30)


@query("evolution_lifetime", """
SELECT uid, timestamp, lifetime / 60 - 0 AS lifetime, size / (0.1 * 0.1) AS size, CASE WHEN latitude LIKE '%Tropical%' THEN 'Tropical' ELSE 'Extratropical' END AS latitude,
  CASE WHEN region ILIKE '%Ocean%' OR region ILIKE '%Sea%' OR region ILIKE '%Mediterranean%' THEN 'Ocean' ELSE 'Land' END AS region_type, region,
  CASE WHEN ((extract(hour FROM timestamp) + cast(lon / 15 AS int)) % 24) BETWEEN 6 AND 17 THEN 'Day' ELSE 'Night' END AS day_night,
  "max" AS max_precipitation, "mean" AS mean_precipitation, inside_clusters FROM track_obs""", ("lifetime", "size", "max_precipitation", "mean_precipitation"), ("track_obs",))
def evolution_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.evolution(A.track_obs(spark, sf_dir))


_SEASON = "CASE WHEN {m} IN (12, 1, 2) THEN 'DJF' WHEN {m} IN (3, 4, 5) THEN 'MAM' WHEN {m} IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END"
_CENSUS = f"""
SELECT year, month, {_SEASON.replace('{m}', 'month')} AS season, count(*) AS count
FROM (SELECT cast(strftime(t, '%Y') AS int) AS year, cast(strftime(t, '%m') AS int) AS month FROM (SELECT uid, min(timestamp) AS t FROM track_ship{{where}} GROUP BY uid)) GROUP BY ALL"""


@query("monthly_census", _CENSUS.replace("{where}", ""), (), ("track_ship",))
def monthly_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.census(A.track_ship(spark, sf_dir))


@query("census_compare", f"""
WITH a AS ({_CENSUS.replace('{where}', '')}), b AS ({_CENSUS.replace('{where}', ' WHERE size > 10')})
SELECT year, month, season, a.count AS count_all, b.count AS count_large, a.count - b.count AS difference, a.count / b.count AS ratio FROM a JOIN b USING (year, month, season)""", ("ratio",), ("track_ship",))
def census_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.track_ship(spark, sf_dir)
    return tracks.census_compare(tracks.census(t), tracks.census(t.filter("size > 10")), ("all", "large"))


@query("season_trend", f"""
WITH c AS ({_CENSUS.replace('{where}', '')}), y AS (SELECT season, year, sum(count) AS v FROM c GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY year) - 1 AS x FROM y)
SELECT season, count(*) AS n_years, cast(sum(v) AS bigint) AS total, avg(v) AS mean, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept FROM o GROUP BY season""", ("mean", "slope", "intercept"), ("track_ship",))
def season_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.season_trend(tracks.census(A.track_ship(spark, sf_dir)))


@query("short_long_split", """
WITH s AS (SELECT duration, count(*) AS uid_count FROM (SELECT uid, max(duration) AS duration FROM track_obs WHERE threshold = 0.1 GROUP BY uid) GROUP BY duration),
t AS (SELECT coalesce(sum(uid_count) FILTER (WHERE duration < 180), 0) AS n_short, coalesce(sum(uid_count) FILTER (WHERE duration >= 180), 0) AS n_long, coalesce(sum(uid_count) FILTER (WHERE duration > 1440), 0) AS n_over_day, coalesce(sum(uid_count) FILTER (WHERE duration <= 1440), 0) AS n_day FROM s)
SELECT cast(n_short AS bigint) AS n_short, cast(n_long AS bigint) AS n_long, cast(n_over_day AS bigint) AS n_over_day, cast(n_day AS bigint) AS n_day, round(100.0 * n_short / n_day, 4) AS perc_short, round(100.0 * n_long / n_day, 4) AS perc_long FROM t""", ("perc_short", "perc_long"), ("track_obs",))
def short_long_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.short_long_split(tracks.duration_stats(A.track_obs(spark, sf_dir)))


@query("lifetime_hist2d", """
SELECT cast(CASE WHEN h = 12 THEN 11 ELSE floor(h) END AS int) AS bx, cast(CASE WHEN s = 100 THEN 19 ELSE floor(s / 5) END AS int) AS by, count(*) AS count
FROM (SELECT lifetime / 60 AS h, size AS s FROM track_obs) WHERE h BETWEEN 0 AND 12 AND s BETWEEN 0 AND 100 GROUP BY 1, 2""", (), ("track_obs",))
def lifetime_hist2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.track_obs(spark, sf_dir).select((F.col("lifetime") / 60).alias("h"), "size")
    return tracks.histogram2d(t, "h", "size", (0.0, 1.0, 12), (0.0, 5.0, 20))


@query("describe_by_class", f"""
WITH c AS ({_CLASSIFY.replace('{more}', ', avg(size) AS mean_size')})
SELECT classification, count(mean_size) AS count, avg(mean_size) AS mean, stddev_samp(mean_size) AS std, stddev_pop(mean_size) AS std_pop, min(mean_size) AS min, quantile_cont(mean_size, 0.25) AS p25, quantile_cont(mean_size, 0.5) AS p50, quantile_cont(mean_size, 0.75) AS p75, max(mean_size) AS max
FROM c GROUP BY classification""", ("mean", "std", "std_pop", "min", "p25", "p50", "p75", "max"), ("track_obs",))
def describe_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.describe(tracks.classify(A.track_obs(spark, sf_dir), features=True), "classification", "mean_size")


@query("box_stats", """
WITH q AS (SELECT method, count(size) AS count, avg(size) AS mean, quantile_cont(size, 0.25) AS p25, quantile_cont(size, 0.5) AS p50, quantile_cont(size, 0.75) AS p75 FROM track_obs GROUP BY method)
SELECT method, count, q."mean" AS mean, p25, p50, p75, min(size) FILTER (WHERE size >= p25 - 1.5 * (p75 - p25)) AS whisker_low, max(size) FILTER (WHERE size <= p75 + 1.5 * (p75 - p25)) AS whisker_high
FROM track_obs JOIN q USING (method) GROUP BY method, count, q."mean", p25, p50, p75""", ("mean", "p25", "p50", "p75", "whisker_low", "whisker_high"), ("track_obs",))
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.box_stats(A.track_obs(spark, sf_dir), "method", "size")


@query("percent_histogram", """
WITH s AS (SELECT min(size) AS lo, max(size) AS hi FROM track_ship), b AS (SELECT cast(least(99, floor((size - lo) * 100 / (hi - lo))) AS int) AS bin FROM track_ship, s)
SELECT bin, count(*) AS count, 100.0 * count(*) / sum(count(*)) OVER () AS percent FROM b GROUP BY bin""", ("percent",), ("track_ship",))
def percent_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.percent_histogram(A.track_ship(spark, sf_dir), "size")


@query("vector_speed", """
SELECT uid, avg(u_ * 0.1 * 111000.0 / (60 * 60.0)) AS u_ms, avg(v_ * 0.1 * 111000.0 / (60 * 60.0)) AS v_ms, avg(sqrt(u_ * u_ + v_ * v_) * 111.32 * 0.1) AS km_h FROM track_obs GROUP BY uid""", ("u_ms", "v_ms", "km_h"), ("track_obs",))
def vector_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.sqrt(F.col("u_") * F.col("u_") + F.col("v_") * F.col("v_"))
    return A.track_obs(spark, sf_dir).groupBy("uid").agg(F.avg(X.pixel_speed("u_", 60)).alias("u_ms"), F.avg(X.pixel_speed("v_", 60)).alias("v_ms"), F.avg(size * 111.32 * 0.1).alias("km_h"))


@query("tracking_view", """
SELECT uid, timestamp, duration, size FROM track_obs WHERE threshold = 0.1 AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-20' AND duration >= 120""", ("size",), ("track_obs",))
def view_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking_view(A.track_obs(spark, sf_dir), start="2024-01-05", stop="2024-01-20").select("uid", "timestamp", "duration", "size")


# Motion


@query("start_end_distance", "SELECT uid, start_cindex, end_cindex, start_timestamp, end_timestamp, lon1, lat1, lon2, lat2, km AS start_end_haversine_km FROM ends", ("lon1", "lat1", "lon2", "lat2", "start_end_haversine_km"), ("track_obs", "ends"))
def start_end_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Positions from the centroids of WKT rectangles, as tracks have them; the SQL knows the centres.
    t = A.with_rectangles(A.track_obs(spark, sf_dir)).drop("lon", "lat")
    return motion.start_end(t, geometry="geometry")


@query("distances_selected", "SELECT uid, km AS start_end_haversine_km FROM ends WHERE uid IN (SELECT uid FROM track_ship WHERE size > 45)", ("start_end_haversine_km",), ("track_ship", "ends"))
def distances_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.track_ship(spark, sf_dir)
    return motion.distances(t, t.filter("size > 45").select("uid").distinct())


@query("start_end_ties", """
WITH t AS (SELECT uid, cindex // 3 AS cindex, lon, lat FROM track_obs), m AS (SELECT uid, min(cindex) AS lo, max(cindex) AS hi FROM t GROUP BY uid)
SELECT uid, lo AS start_cindex, hi AS end_cindex, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM m JOIN t a USING (uid) JOIN t b USING (uid) WHERE a.cindex = lo AND b.cindex = hi""", ("lon1", "lat1", "lon2", "lat2"), ("track_obs",))
def start_end_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.track_obs(spark, sf_dir).withColumn("cindex", F.floor(F.col("cindex") / 3))
    return motion.start_end_ties(t).select("uid", "start_cindex", "end_cindex", "lon1", "lat1", "lon2", "lat2")


@query("repeated_steps", "SELECT uid, cindex // 3 AS cindex, count(*) AS n FROM track_obs GROUP BY 1, 2 HAVING count(*) > 1", (), ("track_obs",))
def repeated_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.repeated_steps(A.track_obs(spark, sf_dir).withColumn("cindex", F.floor(F.col("cindex") / 3)))


@query("hovmoller_counts", """
SELECT month(t) AS month, lat_bin, count(DISTINCT uid) AS n FROM (
  SELECT uid, min(timestamp) AS t, floor((max(CASE WHEN cindex = lo THEN lat END) + max(CASE WHEN cindex = hi THEN lat END)) / 2) AS lat_bin
  FROM track_ship JOIN (SELECT uid, min(cindex) AS lo, max(cindex) AS hi FROM track_ship GROUP BY uid) USING (uid) GROUP BY uid)
WHERE lat_bin BETWEEN -60 AND 60 GROUP BY 1, 2""", ("lat_bin",), ("track_ship",))
def hovmoller_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.hovmoller_counts(A.track_ship(spark, sf_dir)).select(F.col("month").cast("long").alias("month"), "lat_bin", "n")


_QUAD = "CASE WHEN {y} >= -60 AND {y} < 60 AND {x} >= -180 AND {x} < 180 THEN (11 - cast(floor(({y} + 60) / 10) AS int)) * 36 + cast(floor(({x} + 180) / 10) AS int) END"


@query("od_quadrants", f"""
WITH q AS (SELECT {_QUAD.replace('{x}', 'lon1').replace('{y}', 'lat1')} AS qs, {_QUAD.replace('{x}', 'lon2').replace('{y}', 'lat2')} AS qe FROM ends),
od AS (SELECT qs, qe, count(*) AS n FROM q WHERE qs IS NOT NULL AND qe IS NOT NULL GROUP BY 1, 2), top AS (SELECT * FROM od QUALIFY row_number() OVER (PARTITION BY qs ORDER BY n DESC, qe) = 1),
g AS (SELECT cast(range AS int) AS quad_id FROM range(432))
SELECT quad_id, cast(coalesce(s.n, 0) AS bigint) AS "Qtdy_Start", cast(coalesce(e.n, 0) AS bigint) AS "Qtdy_End", coalesce(top.qe, -1) AS "Common_Dest", coalesce(top.n, 0) AS "Common_Dest_Count"
FROM g LEFT JOIN (SELECT qs, sum(n) AS n FROM od GROUP BY qs) s ON s.qs = quad_id LEFT JOIN (SELECT qe, sum(n) AS n FROM od GROUP BY qe) e ON e.qe = quad_id LEFT JOIN top ON top.qs = quad_id""", (), ("track_ship", "ends"))
def od_quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.quadrant_summary(motion.start_end(A.track_ship(spark, sf_dir))).select("quad_id", "Qtdy_Start", "Qtdy_End", "Common_Dest", "Common_Dest_Count")


@query("windrose", """
WITH b AS (SELECT *, (degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360) % 360 AS br FROM ends),
c AS (SELECT -180 + floor((lon1 + 180) / 10) * 10 + 5 AS cx, -60 + floor((lat1 + 60) / 10) * 10 + 5 AS cy, cast(least(15, greatest(0, floor(br / 22.5))) AS int) AS sector, km FROM b),
s AS (SELECT cx, cy, sector, count(*) AS count, quantile_cont(km, 0.5) AS dist_stat FROM c GROUP BY ALL), t AS (SELECT cx, cy, cast(sum(count) AS bigint) AS cell_total, max(count) AS top FROM s GROUP BY 1, 2)
SELECT cx, cy, sector, count, dist_stat, cell_total, count / cell_total AS freq_rel, count / top AS radius FROM s JOIN t USING (cx, cy) WHERE cell_total >= 3""", ("cx", "cy", "dist_stat", "freq_rel", "radius"), ("track_ship", "ends"))
def windrose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.windrose(motion.start_end(A.track_ship(spark, sf_dir)), min_events=3)


@query("dominance", """
WITH p AS (SELECT lon1 AS x, lat1 AS y, 1 AS s, 0 AS e FROM ends UNION ALL SELECT lon2, lat2, 0, 1 FROM ends),
c AS (SELECT -180 + floor((x + 180) / 10) * 10 + 5 AS cx, -60 + floor((y + 60) / 10) * 10 + 5 AS cy, cast(sum(s) AS bigint) AS starts, cast(sum(e) AS bigint) AS ends FROM p GROUP BY 1, 2)
SELECT cx, cy, starts, ends, log10((starts + 1.0) / (ends + 1.0)) AS dominance FROM c""", ("cx", "cy", "dominance"), ("track_ship", "ends"))
def dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.dominance(motion.start_end(A.track_ship(spark, sf_dir)))


_MONTHLY = """
WITH m AS (SELECT date_trunc('month', start_timestamp) AS month, avg(km) AS mean, quantile_cont(km, 0.5) AS median, quantile_cont(km, 0.25) AS p25, quantile_cont(km, 0.75) AS p75, max(km) AS max, stddev_samp(km) AS std, count(*) AS n, quantile_cont(km, 0.99) AS p99 FROM ends WHERE km <= 15000 GROUP BY 1),
cal AS (SELECT unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS month),
f AS (SELECT cast(cal.month AS timestamp) AS month, mean, median, p25, p75, max, std, coalesce(n, 0) AS n, p99, 1.96 * std / sqrt(n) AS ci95 FROM cal LEFT JOIN m ON m.month = cal.month)
"""
_M = ("mean", "median", "p25", "p75", "max", "std", "p99", "ci95")


@query("monthly_distance", _MONTHLY + "SELECT * FROM f", _M, ("track_ship", "ends"))
def monthly_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.monthly_distance(motion.start_end(A.track_ship(spark, sf_dir)), filter_max_km=15000)


@query("monthly_from_text", """
WITH d AS (SELECT date_trunc('month', start_timestamp) AS month, km FROM ends WHERE lon1 > -100 AND lat1 <= 40), m AS (SELECT month, count(*) AS n, avg(km) AS mean, median(km) AS median FROM d GROUP BY 1),
c AS (SELECT unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS month)
SELECT CAST(c.month AS TIMESTAMP) AS month, coalesce(n, 0) AS n, mean, median FROM c LEFT JOIN m ON m.month = c.month""", ("mean", "median"), ("track_ship", "ends"), 4)
def monthly_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Times are texts here, some of them no times, and some distances are missing.
    ends = motion.start_end(A.track_ship(spark, sf_dir))
    text = F.when(F.col("lon1") <= -100, "soon").otherwise(F.date_format("start_timestamp", "yyyy-MM-dd HH:mm:ss"))
    rows = ends.withColumn("start_timestamp", text).withColumn("start_end_haversine_km", F.when(F.col("lat1") <= 40, F.col("start_end_haversine_km")))
    return motion.monthly_distance(rows).select("month", "n", "mean", "median")


@query("monthly_anomaly", _MONTHLY + """, c AS (SELECT *, avg(mean) OVER (PARTITION BY month(month)) AS clim FROM f), a AS (SELECT *, mean - clim AS anom FROM c)
SELECT month, mean, clim, anom, CASE WHEN count(mean) OVER w >= 6 THEN avg(mean) OVER w END AS mean_roll12, CASE WHEN count(anom) OVER w >= 6 THEN avg(anom) OVER w END AS anom_roll12
FROM a WINDOW w AS (ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""", ("mean", "clim", "anom", "mean_roll12", "anom_roll12"), ("track_ship", "ends"))
def monthly_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = motion.monthly_distance(motion.start_end(A.track_ship(spark, sf_dir)), filter_max_km=15000)
    return motion.with_anomalies(m).select("month", "mean", "clim", "anom", "mean_roll12", "anom_roll12")


#: A region with a notch, for point-in-polygon queries (counter-clockwise).
REGION = [[(-100.0, -30.0), (-20.0, -30.0), (-20.0, 30.0), (-60.0, 0.0), (-100.0, 30.0), (-100.0, -30.0)]]
# The notch is above the two lines to (-60, 0).
_IN_REGION = "({x} BETWEEN -100 AND -20 AND {y} BETWEEN -30 AND 30 AND {y} <= 0.75 * abs({x} + 60))"


@query("region_filter", f"SELECT uid, cindex, lon, lat FROM track_ship WHERE {_IN_REGION.replace('{x}', 'lon').replace('{y}', 'lat')}", ("lon", "lat"), ("track_ship",))
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.clip(A.track_ship(spark, sf_dir), REGION).select("uid", "cindex", "lon", "lat")


@query("region_tracks", f"SELECT uid, start_cindex, end_cindex, lon1, lat1, lon2, lat2, km AS start_end_haversine_km FROM ends WHERE uid IN (SELECT uid FROM track_ship WHERE {_IN_REGION.replace('{x}', 'lon').replace('{y}', 'lat')})", ("lon1", "lat1", "lon2", "lat2", "start_end_haversine_km"), ("track_ship", "ends"))
def region_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.region_tracks(A.track_ship(spark, sf_dir), REGION).select("uid", "start_cindex", "end_cindex", "lon1", "lat1", "lon2", "lat2", "start_end_haversine_km")


@query("geometry_measures", """
SELECT uid, cindex, lon AS cx, lat AS cy, lon - 0.2 AS xmin, lat + 0.1 AS ymax, abs(lon) <= 90.2 AND lat BETWEEN -30.1 AND 30.1 AS meets_box,
  2 * 6378.137 * radians(0.4) + 2 * 6378.137 * (ln(tan(pi() / 4 + radians(lat + 0.1) / 2)) - ln(tan(pi() / 4 + radians(lat - 0.1) / 2))) AS boundary_km
FROM track_obs""", ("cx", "cy", "xmin", "ymax", "boundary_km"), ("track_obs",))
def geometry_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.with_rectangles(A.track_obs(spark, sf_dir)).select("uid", "cindex", wkt_rings("geometry").alias("g"))
    e = envelope(F.col("g"))
    return t.select("uid", "cindex", centroid(F.col("g"))["x"].alias("cx"), centroid(F.col("g"))["y"].alias("cy"), e["xmin"].alias("xmin"), e["ymax"].alias("ymax"), frames.in_box(-90.0, -30.0, 90.0, 30.0, e).alias("meets_box"), mercator_length_km(F.col("g")).alias("boundary_km"))


# Grids


@query("grid_total", "SELECT lat, lon, sum(fam_density) AS fam_density, sum(clu_values) AS clu_values FROM grid_month GROUP BY lat, lon", ("fam_density", "clu_values"), ("grid_month",))
def grid_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.total_over_time(A.grid_month(spark, sf_dir), "fam_density", "clu_values").select("lat", "lon", "fam_density", "clu_values")


_FRACTIONS = "SELECT lat, lon, " + ", ".join(f"coalesce(sum(clu_values) FILTER (WHERE month(time) IN ({', '.join(map(str, m))})), 0) AS \"{s}\"" for s, m in X.SEASONS.items()) + ", sum(clu_values) AS total FROM grid_month GROUP BY lat, lon"


@query("season_fractions", f"SELECT *, " + ", ".join(f"\"{s}\" / total AS \"{s}_fraction\"" for s in X.SEASONS) + f" FROM ({_FRACTIONS})", ("DJF", "MAM", "JJA", "SON", "total", *(f"{s}_fraction" for s in X.SEASONS)), ("grid_month",))
def season_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.season_fractions(A.grid_month(spark, sf_dir), "clu_values")


@query("dominant_season", f"""
SELECT lat, lon, cast(arg AS int) AS dominant FROM (
  SELECT lat, lon, v, arg, row_number() OVER (PARTITION BY lat, lon ORDER BY v DESC, arg) AS rn FROM (
    SELECT lat, lon, unnest(["DJF", "MAM", "JJA", "SON"]) AS v, unnest([0, 1, 2, 3]) AS arg FROM ({_FRACTIONS}))) WHERE rn = 1""", (), ("grid_month",))
def dominant_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.dominant_season(grid.season_fractions(A.grid_month(spark, sf_dir), "clu_values"))


@query("resample_monthly_sum", "SELECT lat, lon, date_trunc('month', timestamp) AS time, sum(size) AS size FROM (SELECT *, floor(lat / 20) * 20 + 10 AS la, floor(lon / 20) * 20 + 10 AS lo FROM track_ship) t(uid, timestamp, cindex, size, x, y, lat, lon) GROUP BY ALL", ("size",), ("track_ship",))
def resample_monthly_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.track_ship(spark, sf_dir).select((F.floor(F.col("lat") / 20) * 20 + 10.0).alias("lat"), (F.floor(F.col("lon") / 20) * 20 + 10.0).alias("lon"), F.col("timestamp").alias("time"), "size")
    return grid.resample_monthly(t, "size", "sum")


@query("resample_weighted_mean", """
SELECT lat, lon, date_trunc('month', time) AS time, sum(clu_values * fam_density) / nullif(sum(CASE WHEN clu_values IS NOT NULL THEN fam_density END), 0) AS clu_values
FROM (SELECT floor(lat / 30) * 30 AS lat, floor(lon / 60) * 60 AS lon, time, clu_values, fam_density FROM grid_month) GROUP BY ALL""", ("clu_values",), ("grid_month",))
def resample_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.grid_month(spark, sf_dir)
    g = g.withColumn("lat", (F.floor(F.col("lat") / 30) * 30).cast("double")).withColumn("lon", (F.floor(F.col("lon") / 60) * 60).cast("double"))
    return grid.resample_monthly(g, "clu_values", "mean", "fam_density")


@query("climatology", "SELECT lat, lon, cast(month(time) AS int) AS month, avg(clu_values) AS clu_values FROM grid_month GROUP BY ALL", ("clu_values",), ("grid_month",))
def climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.climatology(grid.resample_monthly(A.grid_month(spark, sf_dir), "clu_values"), "clu_values")


@query("fill_months", """
WITH s AS (SELECT lat, lon, min(time) AS a, max(time) AS b FROM grid_month GROUP BY 1, 2), c AS (SELECT lat, lon, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS time FROM s)
SELECT lat, lon, cast(time AS timestamp) AS time, coalesce(clu_values, 0) AS clu_values FROM c LEFT JOIN grid_month USING (lat, lon, time)""", ("clu_values",), ("grid_month",))
def fill_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.fill_months(A.grid_month(spark, sf_dir).select("lat", "lon", "time", "clu_values"), "clu_values", 0.0)


@query("mean_per_event_ratio", "SELECT lat, lon, sum(clu_values) / sum(fam_density) AS per_event FROM grid_month WHERE fam_density > 0 GROUP BY 1, 2", ("per_event",), ("grid_month",))
def mean_per_event_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.mean_per_event(A.grid_month(spark, sf_dir), "clu_values", "fam_density")


@query("mean_per_event_monthly", """
WITH t AS (SELECT time, epoch(lead(time) OVER (ORDER BY time) - time) AS w FROM (SELECT DISTINCT time FROM grid_month)), u AS (SELECT time, coalesce(w, lag(w) OVER (ORDER BY time)) AS w FROM t)
SELECT lat, lon, sum(clu_values / fam_density * w) FILTER (WHERE fam_density >= 2) / sum(w) FILTER (WHERE fam_density >= 2) AS per_event FROM grid_month JOIN u USING (time) GROUP BY 1, 2""", ("per_event",), ("grid_month",))
def mean_per_event_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.mean_per_event(A.grid_month(spark, sf_dir), "clu_values", "fam_density", "mean_of_ratios", 2, True)


@query("coslat_series", """
SELECT t.time, sum(g.clu_values * cos(radians(c.lat))) / sum(cos(radians(c.lat))) AS mean
FROM (SELECT DISTINCT lat, lon FROM grid_month) c CROSS JOIN (SELECT DISTINCT time FROM grid_month) t LEFT JOIN grid_month g ON g.lat = c.lat AND g.lon = c.lon AND g.time = t.time GROUP BY t.time""", ("mean",), ("grid_month",))
def coslat_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.coslat_series(A.grid_month(spark, sf_dir), "clu_values")


@query("zonal_mean", "SELECT lat, sum(clu_values) AS zonal_sum, sum(clu_values) / (SELECT count(DISTINCT lon) FROM grid_month) AS zonal_mean FROM grid_month GROUP BY lat", ("zonal_sum", "zonal_mean"), ("grid_month",))
def zonal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.zonal(A.grid_month(spark, sf_dir), "clu_values")


@query("region_series", "SELECT time, avg(clu_values) AS clu_values FROM grid_month WHERE abs(lat) <= 23.5 GROUP BY time", ("clu_values",), ("grid_month",))
def region_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.region_series(A.grid_month(spark, sf_dir), F.abs("lat") <= 23.5, "clu_values", "mean")


@query("fam_size_duration", "SELECT lat, lon, sum(fam_size) / sum(fam_density) / 0.01 AS mean_size, sum(fam_duration) / sum(fam_density) / 60 AS mean_duration FROM grid_month GROUP BY 1, 2", ("mean_size", "mean_duration"), ("grid_month",), 3)
def fam_size_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.family_means(A.grid_month(spark, sf_dir), "fam_size", "fam_duration", "fam_density")


@query("balance", "SELECT lat, lon, sum(clu_values) - sum(fam_density) AS balance FROM grid_month GROUP BY 1, 2", ("balance",), ("grid_month",))
def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.balance(A.grid_month(spark, sf_dir), "clu_values", "fam_density")


@query("pixel_area", "SELECT lat, lon, sum(fam_density) * 6371.0 * 6371.0 * radians(10) * radians(10) * cos(radians(lat)) AS area FROM grid_month GROUP BY 1, 2", ("area",), ("grid_month",), 2)
def pixel_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.pixel_area(grid.total_over_time(A.grid_month(spark, sf_dir), "fam_density"), "fam_density")


_SMOOTH = """
, m AS (SELECT lat, lon, {v} AS v FROM (SELECT lat, lon, sum(clu_values) AS s FROM grid_month GROUP BY 1, 2)),
k0 AS (SELECT range - 3 AS k, exp(-0.5 * pow(range - 3, 2)) AS w FROM range(7)), k AS (SELECT k, w / (SELECT sum(w) FROM k0) AS w FROM k0),
ila AS (SELECT lat, row_number() OVER (ORDER BY lat) AS i FROM (SELECT DISTINCT lat FROM m)), ilo AS (SELECT lon, row_number() OVER (ORDER BY lon) AS j FROM (SELECT DISTINCT lon FROM m)),
c AS (SELECT i, j, v FROM m JOIN ila USING (lat) JOIN ilo USING (lon)), s AS (SELECT a.i, b.j, sum(c.v * ka.w * kb.w) AS v FROM ila a CROSS JOIN ilo b CROSS JOIN k ka CROSS JOIN k kb JOIN c ON c.i = a.i + ka.k AND c.j = b.j + kb.k GROUP BY 1, 2)
"""


@query("gaussian_smooth", "SELECT lat, lon, s.v AS clu_values FROM s JOIN ila USING (i) JOIN ilo USING (j)", ("clu_values",))
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.gaussian_smooth(grid.total_over_time(A.grid_month(spark, sf_dir), "clu_values"), "clu_values", 1.0)


ORACLE_SQL["gaussian_smooth"] = _with("grid_month") + _SMOOTH.replace("{v}", "s") + "SELECT lat, lon, round(s.v, 6) + 0.0 AS clu_values FROM s JOIN ila USING (i) JOIN ilo USING (j)"


@query("hotspots")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = grid.hotspots(grid.total_over_time(A.grid_month(spark, sf_dir), "clu_values"), "clu_values", sigma=1.0, quantile=0.9)
    return h.select("lat", "lon", "value_raw", "value_norm", "value_smooth", "hotspots_mask", "lat_low", "lat_high", "lon_low", "lon_high")


ORACLE_SQL["hotspots"] = _with("grid_month") + _SMOOTH.replace("{v}", "s / max(s) OVER ()") + """, q AS (SELECT quantile_cont(v, 0.9) AS cut FROM s WHERE v > 0)
SELECT lat, lon, round(r.s, 6) + 0.0 AS value_raw, round(m.v, 6) + 0.0 AS value_norm, round(s.v, 6) + 0.0 AS value_smooth, s.v >= cut AS hotspots_mask, lat - 5 AS lat_low, lat + 5 AS lat_high, lon - 5 AS lon_low, lon + 5 AS lon_high
FROM s JOIN ila USING (i) JOIN ilo USING (j) JOIN m USING (lat, lon) JOIN (SELECT lat, lon, sum(clu_values) AS s FROM grid_month GROUP BY 1, 2) r USING (lat, lon), q"""


_Y = "ln(tan(pi() / 4 + radians({v}) / 2) * pow((1 - 0.0818191908426215 * sin(radians({v}))) / (1 + 0.0818191908426215 * sin(radians({v}))), 0.0818191908426215 / 2))"


@query("areas_above", f"""
WITH RECURSIVE m AS (SELECT lat, lon, sum(clu_values) AS v FROM grid_month GROUP BY 1, 2), x AS (SELECT *, dense_rank() OVER (ORDER BY lat) AS i, dense_rank() OVER (ORDER BY lon) AS j FROM m),
k AS (SELECT *, 6378.137 * 6378.137 * radians(10) * ({_Y.replace('{v}', '(lat + 5)')} - {_Y.replace('{v}', '(lat - 5)')}) AS a FROM x WHERE v >= (SELECT quantile_cont(v, 0.75) FROM m)),
r AS (SELECT i, j, i AS ri, j AS rj FROM k UNION SELECT k.i, k.j, r.ri, r.rj FROM r JOIN k ON abs(k.i - r.i) + abs(k.j - r.j) = 1),
l AS (SELECT i, j, min((ri, rj)) AS top FROM r GROUP BY 1, 2)
SELECT top[1] || ':' || top[2] AS label, count(*) AS cells, sum(a) AS area_km2 FROM l JOIN k USING (i, j) GROUP BY top HAVING sum(a) >= 100000""", ("area_km2",), ("grid_month",), 2)
def areas_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.areas_above(grid.total_over_time(A.grid_month(spark, sf_dir), "clu_values"), "clu_values", quantile=0.75)


@query("areas_outlined", f"""
WITH RECURSIVE m AS (SELECT CAST(year(time) AS INT) AS year, lat, lon, sum(fam_density) AS v FROM grid_month GROUP BY 1, 2, 3), ax AS (SELECT lat, row_number() OVER (ORDER BY lat) AS i FROM (SELECT DISTINCT lat FROM m)), ay AS (SELECT lon, row_number() OVER (ORDER BY lon) AS j FROM (SELECT DISTINCT lon FROM m)),
c AS (SELECT year, quantile_cont(v, 0.6) AS cut FROM m GROUP BY 1), k AS (SELECT year, lat, lon, i, j, 6378.137 * 6378.137 * radians(10) * ({_Y.replace('{v}', '(lat + 5)')} - {_Y.replace('{v}', '(lat - 5)')}) AS a FROM m JOIN c USING (year) JOIN ax USING (lat) JOIN ay USING (lon) WHERE v > cut),
r AS (SELECT year, i, j, i AS ri, j AS rj FROM k UNION SELECT k.year, k.i, k.j, r.ri, r.rj FROM r JOIN k ON k.year = r.year AND abs(k.i - r.i) + abs(k.j - r.j) = 1),
l AS (SELECT year, i, j, min((ri, rj)) AS top FROM r GROUP BY 1, 2, 3)
SELECT year, top[1] || ':' || top[2] AS label, count(*) AS cells, sum(a) AS area_km2, count(*) * 100.0::DOUBLE AS degrees, true AS valid, min(lon) - 5.0::DOUBLE AS xmin, max(lat) + 5.0::DOUBLE AS ymax FROM l JOIN k USING (year, i, j) GROUP BY year, top""", ("area_km2", "degrees", "xmin", "ymax"), ("grid_month",), 2)
def areas_outlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.grid_month(spark, sf_dir).groupBy(F.year("time").alias("year"), "lat", "lon").agg(F.sum("fam_density").alias("v"))
    found = grid.areas_above(m, "v", quantile=0.6, operation="gt", min_area_km2=0.0, by=("year",), outline=True)
    rings = found.select("year", "label", "cells", "area_km2", "outline", wkt_rings("outline").alias("g"))
    shoelace = lambda r: F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda s, k: s + F.element_at(r, k)["x"] * F.element_at(r, k + 1)["y"] - F.element_at(r, k + 1)["x"] * F.element_at(r, k)["y"])
    e = envelope(F.col("g"))
    return rings.select("year", "label", "cells", "area_km2", (F.aggregate(F.transform("g", shoelace), F.lit(0.0), lambda s, x: s + x) / 2).alias("degrees"), G.valid(G.parts_of_wkt("outline")).alias("valid"), e["xmin"].alias("xmin"), e["ymax"].alias("ymax"))


# Trends


# The normal distribution's two-sided tail by the series of the error function, whose terms are all positive.
_TAIL = "CASE WHEN {z} = 0 THEN 1 ELSE greatest(0, 1 - 2 / sqrt(pi()) * exp(-{z} * {z} / 2) * list_sum(list_transform(range(200), lambda n: exp((2 * n + 1) * ln(abs({z}) / sqrt(2)) + n * ln(4) + lgamma(n + 1) - lgamma(2 * n + 2))))) END"
_MK = f"""
p AS (SELECT lat, lon, (year(time) * 12 + month(time)) AS t, clu_values AS y FROM grid_month),
d AS (SELECT lat, lon, cast(sum(sign(b.y - a.y)) AS double) AS s, count(*) AS pairs, median((b.y - a.y) / (b.t - a.t)) AS slope FROM p a JOIN p b USING (lat, lon) WHERE b.t > a.t GROUP BY 1, 2),
e AS (SELECT lat, lon, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT lat, lon, y, cast(count(*) AS double) AS c FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2),
z AS (SELECT *, (n * (n - 1) * (2 * n + 5) - ties) / 18 AS var_s, CASE WHEN var_s > 0 THEN (s - sign(s)) / sqrt(var_s) ELSE 0 END AS z FROM d JOIN e USING (lat, lon)),
q AS (SELECT *, {_TAIL.replace('{z}', 'z')} AS p FROM z)
"""


@query("mk_tau_sen", "SELECT lat, lon, s / pairs AS tau, slope, p, CASE WHEN p < 0.05 THEN slope END AS trend, CASE WHEN p < 0.05 THEN p END AS p_value FROM q", ("tau", "slope", "p", "trend", "p_value"))
def mk_tau_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.trend_field(A.grid_month(spark, sf_dir), "clu_values").select("lat", "lon", "tau", "slope", "p", "trend", "p_value")


ORACLE_SQL["mk_tau_sen"] = _with("grid_month").rstrip() + "," + _MK + ORACLE_SQL["mk_tau_sen"]


@query("trend_tests")
def trend_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trend.test_field(A.grid_month(spark, sf_dir), "clu_values", narrow=False)
    return t.select("lat", "lon", *[F.round(F.col(c), n).alias(c) for c, n in (("s", 0), ("tau", 4), ("z", 3), ("p", 4))], F.col("trend_code").cast("int").alias("trend_code"))


ORACLE_SQL["trend_tests"] = _with("grid_month").rstrip() + "," + _MK + "SELECT lat, lon, round(s, 0) + 0.0 AS s, round(s / pairs, 4) + 0.0 AS tau, round(z, 3) + 0.0 AS z, round(p, 4) + 0.0 AS p, CASE WHEN p < 0.05 THEN cast(sign(z) AS int) ELSE 0 END AS trend_code FROM q"


#: Series by position, their original test, and the autocorrelations of what the Theil-Sen line leaves (of ranks, for one test), up to three steps.
_BY_PLACE = """
p AS (SELECT lat, lon, time, clu_values AS y, cast(row_number() OVER (PARTITION BY lat, lon ORDER BY time) - 1 AS double) AS k FROM grid_month),
d AS (SELECT lat, lon, cast(sum(sign(b.y - a.y)) AS double) AS s, count(*) AS pairs, median((b.y - a.y) / (b.k - a.k)) AS slope FROM p a JOIN p b USING (lat, lon) WHERE b.k > a.k GROUP BY 1, 2),
e AS (SELECT lat, lon, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT lat, lon, y, cast(count(*) AS double) AS c FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2),
o AS (SELECT *, (n * (n - 1) * (2 * n + 5) - ties) / 18 AS var_0 FROM d JOIN e USING (lat, lon)),
i AS (SELECT lat, lon, median(y) AS my, median(k) AS mk FROM p GROUP BY 1, 2),
r0 AS (SELECT p.lat, p.lon, k, y - slope * k AS x FROM p JOIN d ON p.lat = d.lat AND p.lon = d.lon),
r1 AS (SELECT lat, lon, k, {x} AS x FROM r0),
r2 AS (SELECT lat, lon, k, x - avg(x) OVER (PARTITION BY lat, lon) AS x FROM r1),
r AS (SELECT a.lat, a.lon, b.k - a.k AS lag, sum(a.x * b.x) / any_value(v.v) AS rho FROM r2 a JOIN r2 b ON a.lat = b.lat AND a.lon = b.lon AND b.k - a.k BETWEEN 1 AND 3
      JOIN (SELECT lat, lon, sum(x * x) AS v FROM r2 GROUP BY 1, 2) v ON v.lat = a.lat AND v.lon = a.lon GROUP BY 1, 2, 3),
f AS (SELECT o.lat, o.lon, {f} AS f FROM o JOIN r ON o.lat = r.lat AND o.lon = r.lon GROUP BY o.lat, o.lon, o.n),
w AS (SELECT o.*, var_0 * f AS var_s, CASE WHEN var_0 * f > 0 THEN (s - sign(s)) / sqrt(var_0 * f) ELSE 0 END AS z FROM o JOIN f ON o.lat = f.lat AND o.lon = f.lon),
q AS (SELECT w.*, my - slope * mk AS intercept, """ + _TAIL.replace("{z}", "z") + """ AS p FROM w JOIN i ON i.lat = w.lat AND i.lon = w.lon)
"""
#: Twelve interleaved series, each in years.
_SEASONAL = """
p AS (SELECT lat, lon, clu_values AS y, row_number() OVER (PARTITION BY lat, lon ORDER BY time) - 1 AS k FROM grid_month),
d AS (SELECT a.lat, a.lon, a.k % 12 AS g, sign(b.y - a.y) AS s, (b.y - a.y) / (b.k // 12 - a.k // 12) AS slope FROM p a JOIN p b ON a.lat = b.lat AND a.lon = b.lon AND a.k % 12 = b.k % 12 AND b.k > a.k),
e AS (SELECT lat, lon, g, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT lat, lon, k % 12 AS g, y, cast(count(*) AS double) AS c FROM p GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
v AS (SELECT lat, lon, sum((n * (n - 1) * (2 * n + 5) - ties) / 18) AS var_s FROM e WHERE n > 1 GROUP BY 1, 2),
t AS (SELECT lat, lon, cast(sum(s) AS double) AS s, count(*) AS pairs, median(slope) AS slope FROM d GROUP BY 1, 2),
i AS (SELECT lat, lon, median(y) AS my, median(k) AS mk FROM p GROUP BY 1, 2),
w AS (SELECT t.*, var_s, my - slope * mk / 12 AS intercept, CASE WHEN var_s > 0 THEN (s - sign(s)) / sqrt(var_s) ELSE 0 END AS z FROM t JOIN v USING (lat, lon) JOIN i USING (lat, lon)),
q AS (SELECT *, """ + _TAIL.replace("{z}", "z") + """ AS p FROM w)
"""
_TESTED = "SELECT lat, lon, round(p, 4) + 0.0 AS p, round(z, 4) + 0.0 AS z, round(s / pairs, 4) + 0.0 AS tau, round(s, 4) + 0.0 AS s, round(var_s, 4) + 0.0 AS var_s, round(slope, 4) + 0.0 AS slope, round(intercept, 4) + 0.0 AS intercept, CASE WHEN p < 0.05 THEN 1 ELSE 0 END AS h, CASE WHEN p < 0.05 THEN cast(sign(z) AS int) ELSE 0 END AS trend_code FROM q"
_DETRENDED, _RANKS = "x", "rank() OVER (PARTITION BY lat, lon ORDER BY x) + (count(*) OVER (PARTITION BY lat, lon, x) - 1) / 2.0"
_BATTERY = {
    "seasonal": (_SEASONAL, {"period": 12}),
    "hamed_rao": (_BY_PLACE.replace("{x}", _RANKS).replace("{f}", "1 + 2 / (n * (n - 1) * (n - 2)) * sum((n - lag) * (n - lag - 1) * (n - lag - 2) * CASE WHEN abs(rho) > 1.959963984540054 / sqrt(n) THEN rho ELSE 0 END)"), {"lag": 3}),
    "yue_wang": (_BY_PLACE.replace("{x}", _DETRENDED).replace("{f}", "1 + 2 * sum((1 - lag / n) * rho)"), {"lag": 3}),
    "sen": (_BY_PLACE.replace("{x}", _DETRENDED).replace("{f}", "1.0"), {}),
}


def _tested(name: str, options: dict[str, int]) -> None:
    @query(f"trend_{name}", None, (), (), 4)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = trend.test_field(A.grid_month(spark, sf_dir), "clu_values", name, narrow=False, **options)
        return t.withColumn("h", F.col("h").cast("int")).withColumn("trend_code", F.col("trend_code").cast("int"))


for _name, (_sql, _options) in _BATTERY.items():
    _tested(_name, _options)
    ORACLE_SQL[f"trend_{_name}"] = _with("grid_month").rstrip() + "," + _sql + _TESTED


@query("trend_compat", "SELECT lat, lon, slope / ((SELECT max(t) - min(t) FROM p) / 12.0) AS slope FROM q", ("slope",), (), 5)
def trend_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.trend_field(A.grid_month(spark, sf_dir), "clu_values", compat=True).select("lat", "lon", "slope")


ORACLE_SQL["trend_compat"] = _with("grid_month").rstrip() + "," + _MK + ORACLE_SQL["trend_compat"]


@query("trend_weighted", "SELECT lat, lon, s / pairs AS tau, slope, p FROM q", ("tau", "slope", "p"))
def trend_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Equal times are averaged; rows whose weight isn't positive don't count.
    g = A.grid_month(spark, sf_dir).withColumn("time", F.date_trunc("quarter", "time")).withColumn("w", F.col("fam_density") - 1)
    return trend.trend_field(g, "clu_values", weight="w").filter("p IS NOT NULL").select("lat", "lon", "tau", "slope", "p")


ORACLE_SQL["trend_weighted"] = _with("grid_month").rstrip() + "," + _MK.replace("(year(time) * 12 + month(time)) AS t, clu_values AS y FROM grid_month", "year(time) * 12 + quarter(time) * 3 AS t, avg(clu_values) AS y FROM grid_month WHERE fam_density > 1 GROUP BY 1, 2, 3") + ORACLE_SQL["trend_weighted"]


@query("series_trend", _MONTHLY.replace("WHERE km <= 15000 ", "") + """, y AS (SELECT (year(month) - y0) * 12 + month(month) - m0 AS t, mean AS y FROM f, (SELECT year(min(month)) AS y0, month(min(month)) AS m0 FROM f) WHERE mean IS NOT NULL),
s AS (SELECT median((b.y - a.y) / (b.t - a.t)) AS slope, cast(sum(sign(b.y - a.y)) AS double) AS s FROM y a JOIN y b ON b.t > a.t), c AS (SELECT median(t) AS mt, median(y) AS my, cast(count(*) AS double) AS n FROM y),
k AS (SELECT *, (s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18) AS z FROM s, c)
SELECT slope * 120 AS slope_decade, my - slope * mt AS intercept, """ + _TAIL.replace("{z}", "z") + " AS p FROM k", ("slope_decade", "intercept", "p"), ("track_ship", "ends"), 4)
def series_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = motion.monthly_distance(motion.start_end(A.track_ship(spark, sf_dir)))
    return trend.series_trend(m)


@query("samples_per_year", """
WITH t AS (SELECT DISTINCT epoch(date_trunc('day', timestamp)) / 86400 AS d FROM track_obs), g AS (SELECT d, d - lag(d) OVER (ORDER BY d) AS gap FROM t), s AS (SELECT count(*) AS n, median(gap) AS gap, max(d) - min(d) AS span FROM g)
SELECT CASE WHEN n < 2 THEN 1 WHEN gap BETWEEN 25 AND 35 THEN 12 ELSE (n - 1) / (span / 365.2425) END AS samples_per_year FROM s""", ("samples_per_year",), ("track_obs",))
def samples_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.samples_per_year(A.track_obs(spark, sf_dir).select(F.date_trunc("day", "timestamp").alias("time")))




# Frames


@query("cumulative_new", """
WITH b AS (SELECT uid, min(timestamp) AS timestamp FROM track_obs WHERE status = 'NEW' GROUP BY uid), s AS (SELECT DISTINCT timestamp FROM track_obs), n AS (SELECT s.timestamp, count(b.uid) AS n_new FROM s LEFT JOIN b ON b.timestamp = s.timestamp GROUP BY 1)
SELECT timestamp, n_new, cast(sum(n_new) OVER (ORDER BY timestamp) AS bigint) AS cumulative FROM n""", (), ("track_obs",))
def cumulative_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.cumulative_new(A.track_obs(spark, sf_dir))


@query("cumulative_counts", "SELECT timestamp, count(DISTINCT uid) AS n, cast(sum(count(DISTINCT uid)) OVER (ORDER BY timestamp) AS bigint) AS cumulative FROM track_obs GROUP BY timestamp", (), ("track_obs",))
def cumulative_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.cumulative_counts(A.track_obs(spark, sf_dir))


@query("pixel_occupancy", """
WITH p AS (SELECT DISTINCT uid, timestamp, unnest([cast(floor(lat / 5) AS int), cast(floor(lat / 5) AS int), cast(floor(lat / 5) AS int) + 1]) AS y, unnest([cast(floor(lon / 5) AS int), cast(floor(lon / 5) AS int), cast(floor(lon / 5) AS int)]) AS x FROM track_obs)
SELECT y, x, count(*) AS n FROM p GROUP BY 1, 2""", (), ("track_obs",))
def pixel_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = F.floor(F.col("lat") / 5).cast("int"), F.floor(F.col("lon") / 5).cast("int")
    return frames.pixel_occupancy(A.track_obs(spark, sf_dir).withColumn("array_y", F.array(y, y, y + 1)).withColumn("array_x", F.array(x, x, x)))


@query("match_frames", """
WITH f AS (SELECT DISTINCT strftime(timestamp, '%Y%m%d_%H00') AS path, date_trunc('hour', timestamp) AS timestamp FROM track_obs), c AS (SELECT * FROM f WHERE hour(timestamp) % 2 = 0),
a AS (SELECT path, row_number() OVER (ORDER BY timestamp, path, k) AS rn FROM c, (SELECT unnest([1, 2]) AS k)), b AS (SELECT path, timestamp, row_number() OVER (ORDER BY timestamp, path) AS rn FROM f)
SELECT cast(rn AS int) AS rn, b.timestamp, a.path AS coarse, b.path AS fine FROM a JOIN b USING (rn)""", (), ("track_obs",))
def match_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_trunc("hour", "timestamp").cast("timestamp_ntz")
    fine = A.track_obs(spark, sf_dir).select(F.date_format("timestamp", "yyyyMMdd_HH00").alias("path"), at.alias("timestamp")).distinct()
    return frames.match_frames(fine.filter(F.hour("timestamp") % 2 == 0), fine)


@query("match_frames_time", """
WITH f AS (SELECT DISTINCT strftime(timestamp, '%Y%m%d_%H%M') AS path, timestamp FROM track_obs WHERE size > 20), c AS (SELECT uid || strftime(timestamp, '%Y%m%d_%H00') AS path, date_trunc('hour', timestamp) AS timestamp FROM track_obs WHERE hour(timestamp) % 5 = 0)
SELECT f.timestamp, c.path AS coarse, f.path AS fine FROM f ASOF JOIN (SELECT timestamp, max(path) AS path FROM c GROUP BY timestamp) c ON f.timestamp >= c.timestamp""", (), ("track_obs",))
def match_frames_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.track_obs(spark, sf_dir)
    fine = t.filter("size > 20").select(F.date_format("timestamp", "yyyyMMdd_HHmm").alias("path"), "timestamp").distinct()
    coarse = t.filter(F.hour("timestamp") % 5 == 0).select(F.concat("uid", F.date_format("timestamp", "yyyyMMdd_HH00")).alias("path"), F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("timestamp"))
    return frames.match_frames(coarse, fine, mode="time")


@query("rolling_months", _MONTHLY + """, c AS (SELECT *, mean - avg(mean) OVER (PARTITION BY month(month)) AS anom FROM f), w AS (SELECT month, avg(mean) OVER r AS m, avg(anom) OVER r AS a, count(mean) OVER r AS n FROM c WINDOW r AS (ORDER BY month ROWS 4 PRECEDING))
SELECT month, CASE WHEN n >= 3 THEN m END AS mean_roll12, CASE WHEN n >= 3 THEN a END AS anom_roll12 FROM w""", ("mean_roll12", "anom_roll12"), ("track_ship", "ends"))
def rolling_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = motion.monthly_distance(motion.start_end(A.track_ship(spark, sf_dir)), filter_max_km=15000)
    return motion.with_anomalies(m, rolling=5, least=3).select("month", "mean_roll12", "anom_roll12")


@query("percentiles", """
SELECT method, status, quantile_cont(size, 0) AS p0, quantile_cont(size, 0.001) AS p001, quantile_cont(size, 0.5) AS p50, quantile_cont(size, 0.999) AS p999, quantile_cont(size, 1) AS p100 FROM track_obs GROUP BY 1, 2""", ("p0", "p001", "p50", "p999", "p100"), ("track_obs",))
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantiles.exact_percentiles(A.track_obs(spark, sf_dir), "size", (0.0, 0.001, 0.5, 0.999, 1.0), ("method", "status"))
    return found.select("method", "status", *[F.col("q")[k].alias(n) for k, n in enumerate(("p0", "p001", "p50", "p999", "p100"))])


@query("scalar_functions", """
SELECT event_id, cast((event_id * 7.5) % 720 AS double) AS lon, cast(((event_id * 7.5) % 720 + 180) % 360 - 180 AS double) AS wrapped, CASE WHEN value >= 0.1 THEN value END AS rain, least(1, greatest(0, (value - 10) / 40)) AS unit,
  strftime(ts, '%Y%m%d_%H%M') AS frame, strftime(ts, '%Y-%m-%d %H:%M UTC') AS label FROM events""", ("lon", "wrapped", "rain", "unit"))
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    lon = (F.col("event_id") * F.lit(7.5)) % 720
    return e.select("event_id", lon.alias("lon"), X.wrap_longitude(lon).alias("wrapped"), F.when(F.col("value") >= 0.1, F.col("value")).alias("rain"), X.clamp_unit("value", 10.0, 50.0).alias("unit"), X.frame_key("ts").alias("frame"), X.frame_label("ts").alias("label"))


@query("labels_and_times", """
SELECT event_id, CASE WHEN v >= 1e6 THEN printf('%.1fM', v / 1e6) WHEN v >= 1e3 THEN printf('%.1fk', v / 1e3) ELSE printf('%.0f', v) END AS human, date_trunc('minute', ts) AS named, date_trunc('minute', ts) AS sliced, date_trunc('minute', ts) AS dotted, sqrt(x * x + y * y) < 20 AS calm, least(sqrt(x * x + y * y), 20) AS speed, x / nullif(sqrt(x * x + y * y), 0) AS ux, y / nullif(sqrt(x * x + y * y), 0) AS uy,
  -10 - 55 / 111.0 AS south, 40 + 44 / (111.0 * cos(radians(-10))) AS east, value IS NOT NULL AS finite, CASE WHEN m <= 1 THEN 1 WHEN m <= 2 THEN 2 WHEN m <= 2.5 THEN 2.5 WHEN m <= 5 THEN 5 ELSE 10 END * pow(10, e) AS scale
FROM (SELECT *, event_id * 137 + 0.25 AS v, event_id % 50 - 25 AS x, event_id % 31 - 15 AS y, floor(log10(event_id * 137 + 0.25)) AS e, (event_id * 137 + 0.25) / pow(10, floor(log10(event_id * 137 + 0.25))) AS m FROM events)""", ("speed", "ux", "uy", "south", "east", "scale"))
def labels_and_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.col("event_id") * 137 + F.lit(0.25)
    d = X.speed_and_direction((F.col("event_id") % 50 - 25).cast("double"), (F.col("event_id") % 31 - 15).cast("double"), 20.0)
    box = X.point_rectangle(F.lit(-10.0), F.lit(40.0), 44.0, 55.0)
    name = lambda pattern: F.concat(F.lit("/frames/x/"), F.date_format("ts", pattern))
    times = [X.file_time(name("yyyyMMdd_HHmm'.png'")).alias("named"), X.file_time_at(name("'f-'yyyyMMddHHmm'.nc'"), 2, 14, "yyyyMMddHHmm").alias("sliced"), X.file_time_parts(name("'f.'yyyyMMdd'.'HHmm'.nc'"), (1, 2), "yyyyMMddHHmm").alias("dotted")]
    # Bounds of a calm are no round numbers, so engines agree.
    return e.select("event_id", X.human_number(v).alias("human"), *times, (d["speed"] < 20).alias("calm"), d["speed"].alias("speed"), d["ux"].alias("ux"), d["uy"].alias("uy"), box["south"].alias("south"), box["east"].alias("east"), X.finite("value").alias("finite"), X.round_up_nicely(v).alias("scale"))


@query("trajectories", """
SELECT uid, lon1, lat1, lon2, lat2, 'POINT (' || cast(lon1 AS double) || ' ' || cast(lat1 AS double) || ')' AS start_geometry,
  6378.137 * (sqrt(pow(radians(lon2 - lon1), 2) + pow(ln(tan(pi() / 4 + radians(lat2) / 2)) - ln(tan(pi() / 4 + radians(lat1) / 2)), 2))) AS trajectory_length_km, true AS valid FROM ends""", ("lon1", "lat1", "lon2", "lat2", "trajectory_length_km"), ("track_obs", "ends"))
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The last row's trajectory goes from the first position to the last.
    t = A.track_obs(spark, sf_dir)
    ends = motion.start_end(t).select("uid", "lon1", "lat1", "lon2", "lat2")
    line = F.concat(F.lit("LINESTRING ("), F.concat_ws(" ", "lon1", "lat1"), F.lit(", "), F.concat_ws(" ", "lon2", "lat2"), F.lit(")"))
    out = motion.start_end(t.join(ends.select("uid", line.alias("trajectory")), "uid"))
    ring = A.with_rectangles(out.select("uid", F.col("lon1").alias("lon"), F.col("lat1").alias("lat"))).select("uid", is_valid_polygon(wkt_rings("geometry")).alias("valid"))
    return out.join(ring, "uid").select("uid", "lon1", "lat1", "lon2", "lat2", "start_geometry", "trajectory_length_km", "valid")


@query("quadrant_arrows", f"""
WITH q AS (SELECT {_QUAD.replace('{x}', 'lon1').replace('{y}', 'lat1')} AS qs, {_QUAD.replace('{x}', 'lon2').replace('{y}', 'lat2')} AS qe FROM ends),
od AS (SELECT qs, qe, count(*) AS n FROM q WHERE qs IS NOT NULL AND qe IS NOT NULL GROUP BY 1, 2), g AS (SELECT cast(range AS int) AS quad_id, -175 + (range % 36) * 10 AS x, 55 - (range // 36) * 10 AS y FROM range(432)),
c AS (SELECT quad_id, x, y, (SELECT coalesce(sum(n), 0) FROM od WHERE qs = quad_id) AS s, (SELECT coalesce(sum(n), 0) FROM od WHERE qe = quad_id) AS e, (SELECT arg_max(qe, (n, -qe)) FROM od WHERE qs = quad_id) AS d FROM g),
v AS (SELECT c.quad_id, s, e, ((h.x - c.x + 540) % 360 - 180) * cos(radians(c.y)) AS dx, h.y - c.y AS dy FROM c LEFT JOIN g h ON h.quad_id = d)
SELECT quad_id, dx / nullif(sqrt(dx * dx + dy * dy), 0) AS ux, dy / nullif(sqrt(dx * dx + dy * dy), 0) AS uy, CASE WHEN s > e THEN 'start' WHEN e > s THEN 'end' ELSE 'tie' END AS balance FROM v""", ("ux", "uy"), ("track_ship", "ends"))
def quadrant_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.quadrant_arrows(motion.quadrant_summary(motion.start_end(A.track_ship(spark, sf_dir)))).select("quad_id", "ux", "uy", "balance")


@query("sized_dominance", """
WITH g AS (SELECT quantile_cont(km, 0.25) / 111.0 AS st FROM ends), p AS (SELECT lon1 AS x, lat1 AS y, 1 AS s, 0 AS e FROM ends UNION ALL SELECT lon2, lat2, 0, 1 FROM ends),
c AS (SELECT floor((x + 180) / st) AS i, floor((y + 60) / st) AS j, cast(sum(s) AS bigint) AS starts, cast(sum(e) AS bigint) AS ends FROM p, g GROUP BY 1, 2)
SELECT cast(i AS bigint) AS i, cast(j AS bigint) AS j, starts, ends, (starts - ends) / (starts + ends + 1.0) AS dominance FROM c""", ("dominance",), ("track_ship", "ends"))
def sized_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = motion.start_end(A.track_ship(spark, sf_dir))
    step = motion.grid_step(ends)
    at = lambda c, low: F.round((F.col(c) - low) / F.col("step") - 0.5).cast("long")
    return motion.sized_dominance(ends, kind="asymmetry").crossJoin(step).select(at("cx", -180.0).alias("i"), at("cy", -60.0).alias("j"), "starts", "ends", "dominance")


@query("summaries", """
WITH p AS (SELECT lon1 AS x, lat1 AS y, 1 AS s, 0 AS e FROM ends UNION ALL SELECT lon2, lat2, 0, 1 FROM ends), c AS (SELECT floor((x + 180) / 10) AS i, floor((y + 60) / 10) AS j, log10((sum(s) + 1.0) / (sum(e) + 1.0)) AS d FROM p GROUP BY 1, 2), q AS (SELECT quantile_cont(abs(d), 0.98) AS v FROM c),
m AS (SELECT lat, lon, sum(clu_values) AS v FROM grid_month GROUP BY 1, 2)
SELECT (SELECT CASE WHEN v / pow(10, floor(log10(v))) <= 1 THEN 1 WHEN v / pow(10, floor(log10(v))) <= 2 THEN 2 WHEN v / pow(10, floor(log10(v))) <= 2.5 THEN 2.5 WHEN v / pow(10, floor(log10(v))) <= 5 THEN 5 ELSE 10 END * pow(10, floor(log10(v))) FROM q) AS scale,
  (SELECT pow(10, floor(log10(min(v)))) FROM m) AS low, (SELECT pow(10, ceil(log10(max(v)))) FROM m) AS high, (SELECT quantile_cont(v, 0.05) FROM m) AS p05, (SELECT quantile_cont(v, 0.95) FROM m) AS p95,
  (SELECT min(lon) - 0.2 FROM track_ship) AS xmin, (SELECT max(lat) + 0.1 FROM track_ship) AS ymax, (SELECT count(*) FROM track_ship WHERE timestamp BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31') AS n_range""", ("scale", "low", "high", "p05", "p95", "xmin", "ymax"), ("grid_month", "track_ship", "ends"))
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.track_ship(spark, sf_dir)
    m = grid.total_over_time(A.grid_month(spark, sf_dir), "clu_values")
    scale = motion.robust_scale(motion.dominance(motion.start_end(t)))
    bounds = frames.total_bounds(A.with_rectangles(t), envelope(wkt_rings("geometry"))).select("xmin", "ymax")
    n = frames.index_range(t, "1995-01-01", "1995-12-31").agg(F.count(F.lit(1)).alias("n_range"))
    return scale.crossJoin(grid.log_limits(m, "clu_values")).crossJoin(grid.value_range(m, "clu_values").toDF("p05", "p95")).crossJoin(bounds).crossJoin(n)


@query("maps_compared", """
WITH s AS (SELECT lat, lon, sum(clu_values) FILTER (month(time) <= 6) AS a, sum(clu_values) FILTER (month(time) > 6) AS b FROM grid_month GROUP BY 1, 2), l AS (SELECT lat FROM s WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY lat)
SELECT lat, lon, a - b AS difference, a / nullif(b, 0) AS ratio FROM s JOIN l USING (lat) WHERE a IS NOT NULL AND b IS NOT NULL AND (lat + 55) % 20 = 0 AND (lon + 175) % 20 = 0""", ("difference", "ratio"), ("grid_month",))
def maps_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.grid_month(spark, sf_dir)
    a, b = (grid.total_over_time(g.filter(c), "clu_values") for c in (F.month("time") <= 6, F.month("time") > 6))
    both = grid.map_arithmetic(a, b, "clu_values").join(grid.common_latitudes(a, b), "lat", "left_semi")
    return both.filter(((F.col("lat") + 55) % 20 == 0) & ((F.col("lon") + 175) % 20 == 0))


@query("strided", "SELECT lat, lon, v FROM (SELECT lat, lon, sum(clu_values) AS v, dense_rank() OVER (ORDER BY lat) - 1 AS i, dense_rank() OVER (ORDER BY lon) - 1 AS j FROM grid_month GROUP BY 1, 2) WHERE i % 3 = 0 AND j % 3 = 0", ("v",), ("grid_month",))
def strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.stride(grid.total_over_time(A.grid_month(spark, sf_dir), "clu_values"), 3).withColumnRenamed("clu_values", "v")


@query("resample_others", "SELECT lat, lon, date_trunc('quarter', time) AS time, max(clu_values) AS most, min(clu_values) AS least, median(clu_values) AS middle, sum(fam_density) * 6371000.0 * 6371000.0 * radians(10) * radians(10) * cos(radians(lat)) AS area_m2 FROM grid_month GROUP BY 1, 2, 3", ("most", "least", "middle", "area_m2"), ("grid_month",), 1)
def resample_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.grid_month(spark, sf_dir).withColumn("time", F.date_trunc("quarter", "time"))
    out = None
    for stat, name in (("max", "most"), ("min", "least"), ("median", "middle")):
        r = grid.resample_monthly(g, "clu_values", stat).withColumnRenamed("clu_values", name)
        out = r if out is None else out.join(r, ["lat", "lon", "time"])
    n = grid.resample_monthly(g, "fam_density", "sum")
    cells = g.select("lat", "lon").distinct()
    unit = grid.pixel_area(cells.withColumn("one", F.lit(1.0)), "one", "m2")
    return out.join(n, ["lat", "lon", "time"]).join(unit, ["lat", "lon"]).select("lat", "lon", "time", "most", "least", "middle", (F.col("fam_density") * F.col("area")).alias("area_m2"))


@query("density", """
WITH s AS (SELECT min(size) AS lo, max(size) AS hi, count(*) AS n, stddev_samp(size) * pow(count(*), -0.2) AS h FROM track_ship), b AS (SELECT cast(range AS int) AS bin, lo + (range + 0.5) * (hi - lo) / 20 AS centre, n, h FROM range(20), s)
SELECT bin, centre, sum(exp(-0.5 * pow((centre - size) / h, 2)) / (h * sqrt(2 * pi()))) / any_value(n) AS density FROM b, track_ship GROUP BY 1, 2""", ("centre", "density"), ("track_ship",))
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.density(A.track_ship(spark, sf_dir), "size", 20)


@query("unions", f"""
WITH a AS ({_CENSUS.replace('{where}', '')}), b AS ({_CENSUS.replace('{where}', ' WHERE size > 10')}), d AS (SELECT a.count - b.count AS x FROM a JOIN b USING (year, month, season))
SELECT kind, year, cast(sum(count) AS bigint) AS n, (SELECT avg(x) FROM d) AS mean_difference, (SELECT stddev_samp(x) FROM d) AS std_difference
FROM (SELECT 'all' AS kind, * FROM a UNION ALL SELECT 'large' AS kind, * FROM b) GROUP BY 1, 2""", ("mean_difference", "std_difference"), ("track_ship",))
def unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.track_ship(spark, sf_dir)
    a, b = tracks.census(t), tracks.census(t.filter("size > 10"))
    d = tracks.difference_stats(tracks.census_compare(a, b)).drop("n_months")
    return tracks.labelled_union({"all": a, "large": b}, "kind").groupBy("kind", "year").agg(F.sum("count").alias("n")).crossJoin(d)


@query("steps_of_all", """
WITH s AS (SELECT DISTINCT timestamp FROM track_obs WHERE status = 'NEW' UNION SELECT DISTINCT timestamp FROM track_obs WHERE size > 50)
SELECT s.timestamp, count(DISTINCT uid) AS n FROM s LEFT JOIN (SELECT * FROM track_obs WHERE status = 'NEW') t ON t.timestamp = s.timestamp GROUP BY 1""", (), ("track_obs",))
def steps_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.track_obs(spark, sf_dir)
    new = t.filter("status = 'NEW'")
    return frames.on_steps(frames.cumulative_counts(new).drop("cumulative"), frames.all_steps(new, t.filter("size > 50")))


@query("methods_of_each", "SELECT uid, array_to_string(list_sort(list(DISTINCT method)), ',') AS methods FROM track_obs GROUP BY uid", (), ("track_obs",))
def methods_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.distinct_list(A.track_obs(spark, sf_dir), "uid", "method").select("uid", F.array_join("method", ",").alias("methods"))


@query("hovmoller_table", """
WITH e AS (SELECT uid, min(timestamp) AS t, floor((arg_min(lat, cindex) + arg_max(lat, cindex)) / 2) AS lat_bin FROM track_ship GROUP BY uid)
SELECT lat_bin, """ + ", ".join(f'count(*) FILTER (month(t) = {m}) AS "{m}"' for m in range(1, 13)) + " FROM e WHERE lat_bin BETWEEN -60 AND 60 GROUP BY 1", ("lat_bin",), ("track_ship",))
def hovmoller_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.hovmoller_table(A.track_ship(spark, sf_dir))


@query("extreme_months", _MONTHLY + """, c AS (SELECT *, mean - avg(mean) OVER (PARTITION BY month(month)) AS anom FROM f) SELECT arg_max(month, anom) AS warmest, arg_min(month, anom) AS coldest FROM c""", (), ("track_ship", "ends"))
def extreme_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = motion.monthly_distance(motion.start_end(A.track_ship(spark, sf_dir)), filter_max_km=15000)
    return motion.extreme_months(motion.with_anomalies(m))


#: Two parts that overlap: points in both are inside.
PARTS = [[[(-60.0, -40.0), (20.0, -40.0), (20.0, 10.0), (-60.0, 10.0), (-60.0, -40.0)]], [[(0.0, -10.0), (70.0, -10.0), (70.0, 40.0), (0.0, 40.0), (0.0, -10.0)]]]


@query("region_parts", "SELECT uid, cindex, lon, lat FROM track_ship WHERE lon BETWEEN -60 AND 20 AND lat BETWEEN -40 AND 10 OR lon BETWEEN 0 AND 70 AND lat BETWEEN -10 AND 40", ("lon", "lat"), ("track_ship",))
def region_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.clip(A.track_ship(spark, sf_dir), PARTS).select("uid", "cindex", "lon", "lat")


def star_of(k: Column) -> Column:
    """Parts of a region of a thousand corners for each supplier's key."""
    cx, cy, size = (k * 37 % 3400) / 10.0 - 169.9629, (k * 53 % 1000) / 10.0 - 49.9871, 3.0 + k % 7  # no point is on a boundary
    turn = lambda m: 2 * F.lit(math.pi) * (m % 1000) / 1000.0
    corner = lambda m: F.struct((cx + size * (1 + 0.3 * F.cos(5 * turn(m))) * F.cos(turn(m))).alias("x"), (cy + size * (1 + 0.3 * F.cos(5 * turn(m))) * F.sin(turn(m))).alias("y"))
    return F.array(F.array(F.transform(F.sequence(F.lit(0), F.lit(1000)), corner)))


@query("points_in_regions", """
WITH r AS (SELECT s_suppkey AS region, (s_suppkey * 37 % 3400) / 10.0 - 169.9629 AS cx, (s_suppkey * 53 % 1000) / 10.0 - 49.9871 AS cy, 3.0 + s_suppkey % 7 AS size FROM supplier),
p AS (SELECT region, uid, size::DOUBLE AS size, (lon - cx)::DOUBLE AS dx, (lat - cy)::DOUBLE AS dy FROM r JOIN (SELECT uid, lon, lat FROM track_ship) t ON abs(lon - cx) <= 1.3 * size AND abs(lat - cy) <= 1.3 * size),
m AS (SELECT *, floor((atan2(dy, dx) + CASE WHEN dy < 0 THEN 2 * pi() ELSE 0 END) / (2 * pi()) * 1000) AS m FROM p),
v AS (SELECT *, 2 * pi() * m / 1000 AS t0, 2 * pi() * (m + 1) / 1000 AS t1 FROM m),
e AS (SELECT *, size * (1 + 0.3 * cos(5 * t0)) * cos(t0) AS ax, size * (1 + 0.3 * cos(5 * t0)) * sin(t0) AS ay, size * (1 + 0.3 * cos(5 * t1)) * cos(t1) AS bx, size * (1 + 0.3 * cos(5 * t1)) * sin(t1) AS by_ FROM v)
SELECT region, count(*) AS n, count(DISTINCT uid) AS n_uids FROM e WHERE (bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax) >= 0 GROUP BY 1""", (), ("track_ship",))
def points_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Numbers are dealt before there are corners: a small file would be read in one task.
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("region")).repartition(4 * spark.sparkContext.defaultParallelism)
    found = tally.counts_by_region(A.track_ship(spark, sf_dir).select("uid", "lon", "lat"), keys, star_of(F.col("region")))
    return found.withColumnRenamed("n_keys", "n_uids")


#: Shapes by cindex: a rectangle, one with its corners crossed, with a hole, with a hole outside, an open ring, blank, nothing, two parts,
#: two that overlap.
def with_shapes(tracks: DataFrame) -> DataFrame:
    def box(dx: float, dy: float, w: float, order: str = "abcda") -> Column:
        x, y = F.col("lon") + dx, F.col("lat") + dy
        corners = {"a": (x - w, y - w), "b": (x + w, y - w), "c": (x + w, y + w), "d": (x - w, y + w)}
        return F.concat(F.lit("("), F.concat_ws(", ", *[F.concat_ws(" ", *[c.cast("string") for c in corners[k]]) for k in order]), F.lit(")"))

    polygon = lambda *rings: F.concat(F.lit("POLYGON ("), F.concat_ws(", ", *rings), F.lit(")"))
    two = lambda p, q: F.concat(F.lit("MULTIPOLYGON (("), p, F.lit("), ("), q, F.lit("))"))
    shapes = [polygon(box(0, 0, 0.5)), polygon(box(0, 0, 0.5, "acbda")), polygon(box(0, 0, 0.5), box(0, 0, 0.25)), polygon(box(0, 0, 0.5), box(2, 2, 0.25)), polygon(box(0, 0, 0.5, "abcd")), F.lit("  "), F.lit(None).cast("string"), two(box(0, 0, 0.5), box(3, 0, 0.5)), two(box(0, 0, 0.5), box(0.25, 0, 0.5))]
    shape = F.lit(None).cast("string")
    for k, s in enumerate(shapes):
        shape = F.when(F.col("cindex") % len(shapes) == k, s).otherwise(shape)
    return tracks.withColumn("geometry", shape)


@query("geometry_validity", "SELECT uid, cindex, cindex % 9 IN (0, 2, 7) AS valid, CASE cindex % 9 WHEN 5 THEN 0 WHEN 6 THEN 0 WHEN 7 THEN 2 WHEN 8 THEN 2 ELSE 1 END AS n_parts FROM track_obs", (), ("track_obs",))
def geometry_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = with_shapes(A.track_obs(spark, sf_dir)).select("uid", "cindex", G.parts_of_wkt("geometry").alias("parts"))
    return parts.select("uid", "cindex", G.valid(F.col("parts")).alias("valid"), F.coalesce(F.size("parts"), F.lit(0)).alias("n_parts"))


@query("geometry_formats", """
SELECT uid, cindex, CASE WHEN cindex % 9 IN (5, 6) THEN NULL WHEN cindex % 9 IN (7, 8) THEN 9 + 2 * 93 WHEN cindex % 9 IN (2, 3) THEN 177 WHEN cindex % 9 = 4 THEN 77 - 4 ELSE 93 END AS wkb_bytes,
  CASE WHEN cindex % 9 IN (5, 6) THEN NULL WHEN cindex % 9 IN (7, 8) THEN 'MultiPolygon' WHEN cindex % 9 = 4 THEN 'LineString' ELSE 'Polygon' END AS kind, cindex % 9 NOT IN (5, 6) AS same, CASE WHEN cindex % 9 NOT IN (5, 6) THEN lon - 0.5 END AS x0 FROM track_obs""", ("x0",), ("track_obs",))
def geometry_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_shapes(A.track_obs(spark, sf_dir)).select("uid", "cindex", G.parts_of_wkt("geometry").alias("p"))
    rows = rows.select("*", G.wkb_of("p").alias("wkb"), G.geojson_of("p").alias("json"), G.wkt_of("p").alias("wkt"))
    back = [G.parts_of_wkb("wkb").alias("a"), G.parts_of_geojson("json").alias("b"), G.parts_of_wkt("wkt").alias("c")]
    rows = rows.select("*", *back)
    same = F.coalesce((F.col("p") == F.col("a")) & (F.col("p") == F.col("b")) & (F.col("p") == F.col("c")), F.lit(False))
    return rows.select("uid", "cindex", F.octet_length("wkb").alias("wkb_bytes"), F.get_json_object("json", "$.type").alias("kind"), same.alias("same"), F.try_element_at(F.try_element_at(F.try_element_at("p", F.lit(1)), F.lit(1)), F.lit(1))["x"].alias("x0"))


#: Boxes of nations, their sides between the places that systems have.
_BOXES = "SELECT n_nationkey AS region, (n_nationkey * 131 % 300) - 150 AS cx, (n_nationkey * 29 % 80) - 40 AS cy FROM nation"


@query("region_table_tracks", f"""
WITH r AS ({_BOXES}), v AS (SELECT *, CASE cindex % 9 WHEN 7 THEN lon + 1.5 ELSE lon END AS px FROM track_obs WHERE cindex % 9 IN (0, 2, 7)),
x AS (SELECT DISTINCT r.region, uid FROM v JOIN r ON abs(px - cx) <= 12.03 AND abs(lat - cy) <= 9.03),
e AS (SELECT uid, arg_min(px, cindex) AS lon1, arg_min(lat, cindex) AS lat1, arg_max(px, cindex) AS lon2, arg_max(lat, cindex) AS lat2 FROM v GROUP BY uid)
SELECT region, uid, lon1, lat1, lon2, lat2 FROM x JOIN e USING (uid)""", ("lon1", "lat1", "lon2", "lat2"), ("track_obs",), 4)
def region_table_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    cx, cy = (k * 131 % 300) - 150, (k * 29 % 80) - 40
    corner = lambda sx, sy: F.struct((cx + sx * 12.03).alias("x"), (cy + sy * 9.03).alias("y"))
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    table = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("region"), F.array(F.array(ring)).alias("parts"))
    return regions.tracks_of_regions(with_shapes(A.track_obs(spark, sf_dir)), table, geometry="geometry").select("region", "uid", "lon1", "lat1", "lon2", "lat2")


@query("new_systems_windows", """
SELECT time_bucket(INTERVAL 30 MINUTE, t) AS start, time_bucket(INTERVAL 30 MINUTE, t) + INTERVAL 30 MINUTE AS "end", count(*) AS n_new
FROM (SELECT uid, min(timestamp) AS t FROM track_obs WHERE status = 'NEW' GROUP BY uid) GROUP BY ALL""", (), ("track_obs",))
def new_systems_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = new_systems(A.track_obs(spark, sf_dir))
    return n.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n_new")


def flagship(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return QUERIES["duration_stats"](spark, sf_dir)


