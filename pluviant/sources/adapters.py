"""Views that turn general tables (events, lineitem) into tracking tables and grids; the texts hold in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The adapter views as SQL.
TRACK_OBS = """
WITH o AS (
  SELECT event_id, ts, user_id, event_type, value, user_id*100 + day(ts) AS uid_num,
         row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) AS rn,
         count(*)     OVER (PARTITION BY user_id, day(ts)) AS n
  FROM events)
SELECT cast(uid_num AS string) AS uid,
  cast(CASE WHEN event_id % 10 = 0 THEN 0.5 ELSE 0.1 END AS double) AS threshold,
  ts AS timestamp, cast(rn AS bigint) AS cindex,
  cast(60*(n-1) AS bigint) AS duration, cast(60*(rn-1) AS bigint) AS lifetime, value AS size,
  CASE WHEN rn=1 THEN 'NEW' WHEN event_type='error' THEN 'SPL' WHEN event_type='purchase' THEN 'MRG' ELSE 'CON' END AS status,
  cast((event_id*37) % 3600 AS double)/10 - 180 AS lon, cast((event_id*91) % 1200 AS double)/10 - 60 AS lat,
  CASE WHEN abs(cast((event_id*91) % 1200 AS double)/10 - 60) <= 23.5 THEN 'Tropical' ELSE 'Extratropical' END AS latitude,
  CASE event_type WHEN 'click' THEN 'South Atlantic OCEAN' WHEN 'view' THEN 'Coral Sea'
    WHEN 'purchase' THEN 'Mediterranean Region' WHEN 'signup' THEN 'Amazon' END AS region,
  CASE event_id % 6 WHEN 0 THEN 'noc' WHEN 1 THEN 'opt' WHEN 2 THEN 'inc' WHEN 3 THEN 'spl' WHEN 4 THEN 'mrg' ELSE 'elp' END AS method,
  cast((event_id*3) % 11 AS double)/10 AS far,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE cast((event_id*3) % 11 AS double)/10 END AS far_,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE cast((event_id*5) % 11 AS double)/10 END AS far_opt,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE cast((event_id*7) % 11 AS double)/10 END AS far_inc,
  cast((event_id*2) % 11 AS double)/10 AS far_spl,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE cast((event_id*9) % 11 AS double)/10 END AS far_mrg,
  cast((event_id*4) % 11 AS double)/10 AS far_elp,
  cast((event_id*13) % 17 AS double)/4 - 2 AS u_, cast((event_id*7) % 19 AS double)/4 - 2 AS v_,
  cast((event_id*5) % 97 AS double) AS max, cast((event_id*5) % 97 AS double)/3 AS mean, cast(event_id % 4 AS int) AS inside_clusters
FROM o"""
TRACK_SHIP = """
SELECT cast(l_orderkey AS string) AS uid, l_shipdate AS timestamp,
  cast(row_number() OVER (PARTITION BY l_orderkey
       ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS bigint) AS cindex,
  l_quantity AS size, cast(l_partkey % 3600 AS double)/10 - 180 AS lon,
  cast((l_suppkey*37 + l_partkey*11) % 1200 AS double)/10 - 60 AS lat
FROM lineitem"""
GRID_MONTH = """
SELECT cast(date_trunc('month', l_shipdate) AS timestamp) AS time,
  cast(l_partkey % 36 AS double)*10 - 175 AS lon, cast(l_suppkey % 12 AS double)*10 - 55 AS lat,
  cast(count(*) AS double) AS fam_density, sum(l_quantity) AS clu_values,
  sum(l_extendedprice) AS fam_size, cast(sum(l_linenumber) AS double) AS fam_duration
FROM lineitem GROUP BY 1, 2, 3"""


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql.replace(f"FROM {table}", "FROM {rows}"), rows=rows)


def track_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", TRACK_OBS)


def track_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _view(spark, sf_dir, "lineitem", TRACK_SHIP)
    return t.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def grid_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregate over narrow columns; sums keep their row order out of the result only to rounding."""
    t = _view(spark, sf_dir, "lineitem", GRID_MONTH.replace("AS timestamp) AS time", "AS timestamp_ntz) AS time"))
    return t


def with_rectangles(tracks: DataFrame, width: float = 0.4, height: float = 0.2) -> DataFrame:
    """A WKT rectangle around (lon, lat) as geometry."""
    x0, x1 = F.col("lon") - width / 2, F.col("lon") + width / 2
    y0, y1 = F.col("lat") - height / 2, F.col("lat") + height / 2
    corner = lambda x, y: F.concat(x.cast("string"), F.lit(" "), y.cast("string"))
    ring = F.concat_ws(", ", corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1), corner(x0, y0))
    return tracks.withColumn("geometry", F.concat(F.lit("POLYGON (("), ring, F.lit("))")))
