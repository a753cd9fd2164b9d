"""Reductions of long-form cubes (time, lat, lon, values). A missing cell is null or has no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import cell_area_km2, month_start, season
from .ordered import _same, neighbours
from .quantiles import exact_percentiles
from .tiles import connected, convolved, outlines

CELL = ["lat", "lon"]
STATS = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "median": F.median}


def dense(grid: DataFrame) -> DataFrame:
    """All combinations of the cube's times and cells; values are null where there was no row."""
    times, cells = grid.select("time").distinct(), grid.select(*CELL).distinct()
    return cells.crossJoin(times).join(grid, ["time", *CELL], "left")


def resample_monthly(grid: DataFrame, value: str, stat: str = "mean", weight: str | None = None) -> DataFrame:
    """Per cell and month: a statistic, or the mean with weights (a missing value has none; no weight gives null)."""
    if stat not in STATS:
        raise ValueError(f"stat must be one of {', '.join(STATS)}")
    if weight and stat != "mean":
        raise ValueError("weights need stat='mean'")
    v = F.col(value)
    w = F.when(v.isNotNull(), F.col(weight)) if weight else None
    out = F.try_divide(F.sum(v * w), F.sum(w)) if weight else STATS[stat](v)
    return grid.groupBy(*CELL, month_start("time").alias("time")).agg(out.alias(value))


def fill_months(series: DataFrame, value: str, empty: float | None = None) -> DataFrame:
    """A row for each month between a cell's first and last; `empty` is the value of months without data."""
    span = series.groupBy(*CELL).agg(F.min("time").alias("a"), F.max("time").alias("b"))
    months = span.select(*CELL, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("time"))
    out = months.join(series, [*CELL, "time"], "left")
    return out if empty is None else out.withColumn(value, F.coalesce(value, F.lit(float(empty))))


def climatology(monthly: DataFrame, value: str, stat: str = "mean") -> DataFrame:
    """Per cell and calendar month, the same statistic of the monthly series."""
    return monthly.groupBy(*CELL, F.month("time").alias("month")).agg(STATS[stat](value).alias(value))


def mean_per_event(grid: DataFrame, value: str, events: str, mode: str = "ratio_of_sums", min_events: float = 1, time_weights: bool = False) -> DataFrame:
    """Per cell, value for each event: the sums' ratio over steps with events, or the mean of the steps' ratios over
    steps with max(1, min_events) events at least; optionally weighted by the time to the next step (the last repeats)."""
    if mode not in ("ratio_of_sums", "mean_of_ratios"):
        raise ValueError("mode must be ratio_of_sums or mean_of_ratios")
    v, d = F.col(value), F.col(events)
    rows, w = grid, F.lit(1.0)
    if time_weights:
        seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
        times = neighbours(grid.select("time").distinct(), "time", "before", "after")
        times = times.select("time", F.coalesce(seconds("after") - seconds("time"), seconds("time") - seconds("before")).cast("double").alias("w"))
        rows, w = grid.join(times, "time"), F.coalesce("w", F.lit(1.0))
    if mode == "ratio_of_sums":
        on = (d > 0) & v.isNotNull()
        out = F.try_divide(F.sum(F.when(on, v * w)), F.sum(F.when(on, d * w)))
    else:
        on = (d >= max(1, min_events)) & v.isNotNull()
        out = F.try_divide(F.sum(F.when(on, v / F.nullif(d, F.lit(0.0)) * w)), F.sum(F.when(on, w)))
    return rows.groupBy(*CELL).agg(out.alias("per_event"))


def coslat_series(grid: DataFrame, value: str, skipna_weights: bool = False) -> DataFrame:
    """Per time, the mean over all cells weighted by cos(lat). Cells without a value count in the weights unless
    skipna_weights."""
    w = F.cos(F.radians("lat"))
    present = F.sum(F.when(F.col(value).isNotNull(), w))
    by = grid.groupBy("time").agg(F.sum(F.col(value) * w).alias("s"), present.alias("w"))
    if skipna_weights:
        return by.select("time", F.try_divide("s", "w").alias("mean"))
    # The weight of all cells is one number, whatever the time.
    every = grid.select(*CELL).distinct().agg(F.sum(w).alias("all"))
    return by.crossJoin(F.broadcast(every)).select("time", F.try_divide("s", "all").alias("mean"))


def total_over_time(grid: DataFrame, *values: str) -> DataFrame:
    """Sums per cell; a cell without any value has 0."""
    return grid.groupBy(*CELL).agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values])


def mean_over_time(grid: DataFrame, *values: str) -> DataFrame:
    return grid.groupBy(*CELL).agg(*[F.avg(v).alias(v) for v in values])


def region_series(grid: DataFrame, inside: Column, value: str, stat: str = "sum") -> DataFrame:
    """Per time, a statistic over the cells whose centre is inside."""
    return grid.filter(inside).groupBy("time").agg(STATS[stat](value).alias(value))


def zonal(map_: DataFrame, value: str) -> DataFrame:
    """Per latitude: the sum over longitudes, and the sum over the number of all longitudes."""
    n = map_.agg(F.count_distinct("lon").alias("n_lon"))
    by = map_.groupBy("lat").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("zonal_sum"))
    return by.crossJoin(F.broadcast(n)).select("lat", "zonal_sum", (F.col("zonal_sum") / F.col("n_lon")).alias("zonal_mean"))


def season_fractions(grid: DataFrame, value: str) -> DataFrame:
    """Per cell: the seasons' sums and shares of the total, in one pass; shares are null without a total."""
    s = season(F.month("time"))
    names = ("DJF", "MAM", "JJA", "SON")
    sums = [F.coalesce(F.sum(F.when(s == n, F.col(value))), F.lit(0.0)).alias(n) for n in names]
    by = grid.groupBy(*CELL).agg(*sums, F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    return by.withColumns({f"{n}_fraction": F.try_divide(n, "total") for n in names})


def dominant_season(fractions: DataFrame) -> DataFrame:
    """0 to 3 for DJF, MAM, JJA, SON: the season with the largest share, the first of equal ones; null without a total."""
    names = ("DJF", "MAM", "JJA", "SON")
    best = F.greatest(*names)
    code = F.when(F.col("total") == 0, None)
    for k, n in enumerate(names):
        code = code.when(F.col(n) == best, k)
    return fractions.select(*CELL, code.cast("int").alias("dominant"))


def family_means(grid: DataFrame, size: str, duration: str, density: str) -> DataFrame:
    """Per cell: mean size (in cells of 0.01) and duration (hours from minutes) for each event."""
    by = grid.groupBy(*CELL).agg(F.sum(size).alias("s"), F.sum(duration).alias("d"), F.sum(density).alias("n"))
    return by.select(*CELL, (F.try_divide("s", "n") / 0.01).alias("mean_size"), (F.try_divide("d", "n") / 60.0).alias("mean_duration"))


def balance(grid: DataFrame, plus: str, minus: str) -> DataFrame:
    by = total_over_time(grid, plus, minus)
    return by.select(*CELL, (F.col(plus) - F.col(minus)).alias("balance"))


def map_arithmetic(a: DataFrame, b: DataFrame, value: str, digits: int = 4) -> DataFrame:
    """Two maps on the cells that both have: difference and ratio. Cells meet by their rounded coordinates."""
    key = lambda df, name: df.select(*[F.round(c, digits).alias(c) for c in CELL], F.col(value).alias(name))
    both = key(a, "a").join(key(b, "b"), CELL)
    return both.select(*CELL, (F.col("a") - F.col("b")).alias("difference"), F.try_divide("a", "b").alias("ratio"))


def common_latitudes(*maps: DataFrame) -> DataFrame:
    """Latitudes that all maps have."""
    out = maps[0].select("lat").distinct()
    for m in maps[1:]:
        out = out.intersect(m.select("lat"))
    return out


def stride(map_: DataFrame, step: int) -> DataFrame:
    """Every `step`-th latitude and longitude, from the least."""
    for c in CELL:
        kept = map_.select(c).distinct().withColumn("nth", F.row_number().over(W.orderBy(c)) - 1).filter(F.col("nth") % step == 0)
        map_ = map_.join(kept.select(c), c, "left_semi")
    return map_


def log_limits(df: DataFrame, value: str) -> DataFrame:
    """One row: the powers of ten below the least positive and above the greatest value; null without a positive one."""
    v = F.when(F.col(value) > 0, F.col(value))
    return df.agg(F.pow(F.lit(10.0), F.floor(F.log10(F.min(v)))).alias("low"), F.pow(F.lit(10.0), F.ceil(F.log10(F.max(v)))).alias("high"))


def value_range(df: DataFrame, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One row: two percentiles of the values, for a colour scale."""
    return exact_percentiles(df, value, (low, high)).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def pixel_area(map_: DataFrame, value: str, units: str = "km2") -> DataFrame:
    """Values times the cells' areas; spacings are the means of the distances of neighbouring coordinates."""
    if units not in ("km2", "m2"):
        raise ValueError("units must be km2 or m2")
    gap = lambda c: map_.select(c).distinct().agg(((F.max(c) - F.min(c)) / F.nullif(F.count(c) - 1, F.lit(0))).alias(f"d_{c}"))
    rows = map_.crossJoin(F.broadcast(gap("lat"))).crossJoin(F.broadcast(gap("lon")))
    unit = cell_area_km2("lat", 1.0, 1.0) * F.col("d_lat") * F.col("d_lon") * (1.0 if units == "km2" else 1e6)
    return rows.select(*CELL, (F.col(value) * unit).alias("area"))


def _kernel(sigma: float) -> list[float]:
    radius = max(1, int(-(-3 * sigma // 1)))
    raw = [2.718281828459045 ** (-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def _index(map_: DataFrame, c: str) -> DataFrame:
    """Each distinct coordinate of an axis and its index, from 0."""
    return map_.select(c).filter(F.col(c).isNotNull()).distinct().select(c, (F.row_number().over(W.orderBy(c)) - 1).cast("long").alias("i" if c == "lat" else "j"))


def gaussian_smooth(map_: DataFrame, value: str, sigma: float = 2.0) -> DataFrame:
    """Separable smoothing over cell indices: three sigmas to either side, weights that add to 1, nothing beyond the edge.
    A missing value counts as 0. Cells are dealt to tiles once."""
    lats, lons = _index(map_, "lat"), _index(map_, "lon")
    cells = map_.join(lats, "lat").join(lons, "lon").select("i", "j", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    out = convolved(cells, _kernel(sigma))
    return out.join(lats, "i").join(lons, "j").select("lat", "lon", F.col("v").alias(value))


def cell_edges(df: DataFrame, centre: str) -> DataFrame:
    """Each distinct centre with its cell's bounds: midpoints to the neighbours, half a step at the ends."""
    w = W.orderBy(centre)
    c, before, after = F.col(centre), F.lag(centre).over(w), F.lead(centre).over(w)
    low = F.coalesce((before + c) / 2, c - (after - c) / 2)
    high = F.coalesce((c + after) / 2, c + (c - before) / 2)
    return df.select(centre).distinct().select(centre, low.alias(f"{centre}_low"), high.alias(f"{centre}_high"))


def hotspots(map_: DataFrame, value: str, area_weight: bool = False, sigma: float = 2.0, normalize: bool = True, quantile: float = 0.99) -> DataFrame:
    """Raw, normalised and smoothed values, whether a cell reaches the quantile of the positive smoothed ones, and bounds."""
    raw = F.col(value) / F.greatest(F.lit(0.1), F.cos(F.radians("lat"))) if area_weight else F.col(value)
    rows = map_.select(*CELL, raw.cast("double").alias("value_raw"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("value_raw").alias("top"))))
    norm = F.when(F.col("top") > 0, F.col("value_raw") / F.col("top")).otherwise(F.col("value_raw")) if normalize else F.col("value_raw")
    rows = rows.withColumn("value_norm", norm).drop("top")
    smooth = gaussian_smooth(rows, "value_norm", sigma).withColumnRenamed("value_norm", "value_smooth")
    cut = exact_percentiles(smooth.filter("value_smooth > 0"), "value_smooth", (quantile,)).select(F.col("q")[0].alias("cut"))
    out = rows.join(smooth, CELL, "left").crossJoin(F.broadcast(cut)).withColumn("hotspots_mask", F.coalesce(F.col("value_smooth") >= F.col("cut"), F.lit(False))).drop("cut")
    return out.join(cell_edges(map_, "lat"), "lat").join(cell_edges(map_, "lon"), "lon")


def areas_above(map_: DataFrame, value: str, threshold: float | None = None, quantile: float | None = None, operation: str = "ge", min_area_km2: float = 100_000.0, by: tuple[str, ...] = (), outline: bool = False) -> DataFrame:
    """Connected areas (sharing an edge) of cells that pass the comparison: label (the first cell's row and
    column, from 1), cells, area in the Mercator plane of the WGS 84 ellipsoid, km2; with `outline`, a polygon as WKT.

    `by` names columns that tell many maps on the same axes apart; a quantile is each map's own. Maps are labelled by tiles, and parts of
    neighbouring tiles are joined by star contraction, so no task has a whole map.
    """
    compare = {"ge": lambda a, b: a >= b, "gt": lambda a, b: a > b, "le": lambda a, b: a <= b, "lt": lambda a, b: a < b}
    if operation not in compare or (threshold is None) == (quantile is None):
        raise ValueError("one of threshold and quantile, and operation ge, gt, le or lt, are needed")
    rows = map_
    if threshold is None:
        cut = exact_percentiles(map_, value, (quantile,), by).select(*by, F.col("q")[0].alias("__cut"))
        rows = _same(map_, cut, list(by)) if by else map_.crossJoin(F.broadcast(cut))  # one row
    kept = rows.filter(compare[operation](F.col(value), F.lit(float(threshold)) if threshold is not None else F.col("__cut")))
    bounds = {"i": _index(map_, "lat").join(cell_edges(map_, "lat"), "lat").drop("lat"), "j": _index(map_, "lon").join(cell_edges(map_, "lon"), "lon").drop("lon")}
    cells = kept.select(*by, *CELL).join(_index(map_, "lat"), "lat").join(_index(map_, "lon"), "lon").select(*by, "i", "j")
    labelled, roots = connected(cells, by)
    e = 0.0818191908426215  # eccentricity
    bend = lambda c: F.pow((1 - e * F.sin(F.radians(c))) / (1 + e * F.sin(F.radians(c))), F.lit(e / 2))
    y = lambda c: F.log(F.tan(F.lit(0.7853981633974483) + F.radians(c) / 2) * bend(c))
    area = F.lit(6378.137**2) * F.radians(F.col("lon_high") - F.col("lon_low")) * (y("lat_high") - y("lat_low"))
    sized = labelled.join(bounds["i"], "i").join(bounds["j"], "j")
    parts = sized.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("cells"), F.sum(area).alias("area_km2"))
    whole = _same(parts, roots, [*by, "part"]).groupBy(*by, "root").agg(F.sum("cells").alias("cells"), F.sum("area_km2").alias("area_km2"))
    out = whole.filter(F.col("area_km2") >= min_area_km2)
    if outline:
        border = _same(sized.filter("open > 0"), roots, [*by, "part"])
        lines = outlines(_same(border, out.select(*by, "root"), [*by, "root"]), by)
        out = _same(out, lines, [*by, "root"])
    first = F.shiftright("root", 32) + 1, F.col("root").bitwiseAND(F.lit((1 << 32) - 1)) + 1
    label = F.concat_ws(":", *[f.cast("string") for f in first]).alias("label")
    return out.select(*by, label, "cells", "area_km2", *(["outline"] if outline else []))
