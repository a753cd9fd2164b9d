"""Trend tests of time series: Mann-Kendall with ties, its modifications for autocorrelation and seasons, and Theil-Sen slopes."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .ordered import neighbours
from .quantiles import exact_percentiles

TESTS = ("original", "seasonal", "hamed_rao", "yue_wang", "sen")
BATTERY = "p double, z double, tau double, s double, var_s double, slope double, intercept double, h tinyint, trend_code tinyint"


def _before(rank: np.ndarray, limit: np.ndarray) -> int:
    """Pairs i < j with rank[i] < limit[j], ranks being 0 .. n - 1: halves of blocks are compared, level by level, n log n each."""
    n, total, half = len(rank), 0, 1
    at = np.arange(n)
    while half < n:
        block = at // (2 * half)
        left = (at // half) % 2 == 0
        key = np.sort(block[left] * (n + 1) + rank[left])
        first, bound = block[~left] * (n + 1), block[~left] * (n + 1) + limit[~left]
        total += int((np.searchsorted(key, bound) - np.searchsorted(key, first)).sum())
        half *= 2
    return total


def _edge(o: np.ndarray, y: np.ndarray, guess: np.ndarray, holds) -> np.ndarray:
    """How many of the sorted values o hold with each y, if those that do come first; guess is off by rounding at most."""
    at = guess
    while True:
        up = (at < len(o)) & holds(o[np.minimum(at, len(o) - 1)], y)
        down = (at > 0) & ~holds(o[np.maximum(at, 1) - 1], y)
        if not (up | down).any():
            return at
        at = at + up - down


def s_and_ties(y: np.ndarray, eps: float = 0.0) -> tuple[float, float]:
    """Sum of the signs of all later-minus-earlier differences, and its variance with ties (chains of sorted neighbours).

    Signs are counted by ranks in halves, so time grows by n log^2 n and memory with n.
    """
    n = len(y)
    order = np.argsort(y, kind="stable")
    o = y[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    below = _edge(o, y, np.searchsorted(o, y - eps, "left"), lambda v, w: w - v > eps)
    upto = _edge(o, y, np.searchsorted(o, y + eps, "right"), lambda v, w: ~(w - v < -eps))
    s = _before(rank, below) - (n * (n - 1) // 2 - _before(rank, upto))
    runs = np.diff(np.flatnonzero(np.concatenate([[True], np.diff(o) > eps, [True]]))).astype(float) if n else np.zeros(0)
    var = (n * (n - 1) * (2 * n + 5) - float((runs * (runs - 1) * (2 * runs + 5)).sum())) / 18
    return float(s), var


def p_of(s: float, var: float) -> tuple[float, float]:
    if var <= 0:
        return 0.0, 1.0
    z = (s - np.sign(s)) / math.sqrt(var)
    return float(z), math.erfc(abs(z) / math.sqrt(2))


#: Points up to which all pairs' slopes are made at once.
ALL_PAIRS = 1500


def _order(z: np.ndarray, t: np.ndarray, down: bool) -> np.ndarray:
    """Points by z; among equal z later ones first if down, else earlier ones."""
    return np.lexsort((-t if down else t, z))


def _not_above(y: np.ndarray, t: np.ndarray, slope: float) -> int:
    """Pairs at different times (t in order) whose slope isn't greater."""
    order = _order(y - slope * t, t, True)
    rank = np.empty(len(y), np.int64)
    rank[order] = np.arange(len(y))
    # Pairs i < j with rank[i] < rank[j] are above; points of one time go down, so they aren't counted, and stand by y.
    n = len(y)
    same = np.unique(t, return_counts=True)[1]
    pairs = n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())
    above = _before(rank, rank) - _within(rank, t)
    return pairs - above


def _within(rank: np.ndarray, t: np.ndarray) -> int:
    """Pairs i < j of one time with rank[i] < rank[j]."""
    by = np.lexsort((rank, t))  # as the points are by time, each time's ones are sorted among themselves
    own = np.empty(len(t), np.int64)
    own[by] = np.arange(len(t))
    first = np.searchsorted(t, t, "left")
    return _before(own, np.maximum(own, 0)) - int(first.sum())


def _between(y: np.ndarray, t: np.ndarray, low: float, high: float) -> np.ndarray:
    """Slopes of the pairs that are above low and not above high, in order.

    These pairs stand one way by y - low * t and the other way by y - high * t, so they are inversions between two orders."""
    a, b = _order(y - low * t, t, True), _order(y - high * t, t, True)
    n, place = len(y), np.empty(len(y), np.int64)
    place[b] = np.arange(n)
    rank, found, half, at = place[a], [], 1, np.arange(n)
    while half < n:
        block, left = at // (2 * half), (at // half) % 2 == 0
        key = block[left] * (n + 1) + rank[left]
        by = np.argsort(key)
        key, who = key[by], at[left][by]
        start, stop = np.searchsorted(key, block[~left] * (n + 1) + rank[~left]), np.searchsorted(key, (block[~left] + 1) * (n + 1))
        size = stop - start
        if size.any():
            later = np.repeat(at[~left], size)
            nth = np.arange(len(later)) - np.repeat(np.cumsum(size) - size, size)
            found.append((who[np.repeat(start, size) + nth], later))
        half *= 2
    if not found:
        return np.zeros(0)
    i, j = a[np.concatenate([f[0] for f in found])], a[np.concatenate([f[1] for f in found])]
    dt = t[j] - t[i]
    return np.sort((y[j] - y[i])[dt != 0] / dt[dt != 0])


def _kth_slope(y: np.ndarray, t: np.ndarray, rank: int, pairs: int) -> float:
    """The slope with `rank` smaller ones before it, by selection: random pairs give bounds around it, pairs below them are counted, and
    bounds are narrowed until those between them can be listed. Bounds lie half-way between different slopes, where rounding of
    y - slope * t can't turn a pair round, or close around a slope that many pairs share."""
    n, rng = len(y), np.random.default_rng(0)
    spread = float(np.ptp(y)) / float(np.min(np.diff(np.unique(t)))) + 1.0
    low, high, below, upto = -2 * spread, 2 * spread, 0, pairs
    while upto - below > 8 * n:
        i, j = rng.integers(0, n, (2, 16 * n))
        dt = t[j] - t[i]
        some = np.sort((y[j] - y[i])[dt != 0] / dt[dt != 0])
        some = some[(some > low) & (some <= high)]
        if len(some) < 16:
            break
        share, margin = (rank - below) / (upto - below) * len(some), 3 * math.sqrt(len(some))
        first, last = (float(some[int(min(max(share + m, 0), len(some) - 1))]) for m in (-margin, margin))
        tight = 1e-11 * max(abs(first), abs(last), spread * 1e-3)

        def cut(pick: float, side: int) -> float:
            k = int(np.searchsorted(some, pick, "left" if side < 0 else "right")) - (side < 0)  # noqa: B023
            beyond = some[k] if 0 <= k < len(some) else pick  # noqa: B023
            return pick + side * tight if abs(beyond - pick) < 2 * tight else float(pick + beyond) / 2  # noqa: B023

        before = low, high
        for c in (cut(first, -1), cut(last, 1), None):
            if c is None:
                if (low, high) != before:
                    break
                c = (first + last) / 2  # two slopes that many pairs share: which side is it on?
            count = _not_above(y, t, c)
            if count <= rank:
                low, below = max((low, below), (c, count))
            else:
                high, upto = min((high, upto), (c, count))
        if first == last and high - low <= 4 * tight:
            return first
        if (low, high) == before:
            break
    return float(_between(y, t, low, high)[rank - below])


def _median_slope(y: np.ndarray, t: np.ndarray) -> float:
    """Median of the slopes of all pairs at different times; t in order."""
    n = len(y)
    same = np.unique(t, return_counts=True)[1]
    pairs = n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not pairs:
        return math.nan
    ranks = {(pairs - 1) // 2, pairs // 2}
    return sum(_kth_slope(y, t, r, pairs) for r in ranks) / len(ranks)


def sen(y: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Median of the slopes of all pairs with different times, and the intercept through the medians. Long series take n log^2 n
    time and memory that grows with n."""
    y, t = np.asarray(y, float), np.asarray(t, float)
    if len(y) > ALL_PAIRS:
        order = np.argsort(t, kind="stable")
        slope = _median_slope(y[order], t[order])
    else:
        i, j = np.triu_indices(len(y), 1)
        dt = t[j] - t[i]
        ok = dt != 0
        slope = float(np.median((y[j] - y[i])[ok] / dt[ok])) if ok.any() else math.nan
    if math.isnan(slope):
        return math.nan, math.nan
    slope += 0.0  # no negative zero
    return slope, float(np.median(y) - slope * np.median(t))


def mann_kendall(y: np.ndarray, eps: float = 0.0) -> tuple[float, float]:
    """tau and p; (0, 1) where all values tie."""
    n = len(y)
    s, var = s_and_ties(y, eps)
    if var <= 0:
        return 0.0, 1.0
    return s / (n * (n - 1) / 2), p_of(s, var)[1]


def _correlations(x: np.ndarray, lags: int) -> np.ndarray:
    d = x - x.mean()
    total = float(d @ d)
    return np.array([float(d[: len(d) - k] @ d[k:]) / total if total else 0.0 for k in range(1, lags + 1)])


def battery(y: np.ndarray, test: str = "original", alpha: float = 0.05, period: int | None = None, lag: int | None = None) -> tuple:
    """p, z, tau, s, var_s, slope, intercept, h, trend_code (-1, 0, 1) of one series in its order.

    Fewer than three values: no trend and no slope; values all equal: slope 0. Missing values are left out, but keep
    their place in the seasonal test.
    """
    if test not in TESTS:
        raise ValueError(f"test must be one of {', '.join(TESTS)}")
    if test == "seasonal" and not period:
        raise ValueError("the seasonal test needs a period")
    every = np.asarray(y, float)
    y = every[np.isfinite(every)]
    n = len(y)
    if n < 3:
        return (1.0, 0.0, 0.0, 0.0, 0.0, math.nan, math.nan, 0, 0)
    if np.ptp(y) == 0:
        return (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, math.nan, 0, 0)
    slope, intercept = sen(y, np.arange(n, dtype=float))
    pairs = n * (n - 1) / 2
    if test == "seasonal":
        s = var = pairs = 0.0
        slopes = []
        for k in range(period):
            own = every[k::period]
            at = np.flatnonzero(np.isfinite(own))
            if len(at) > 1:
                a, b = s_and_ties(own[at])
                s, var, pairs = s + a, var + b, pairs + len(at) * (len(at) - 1) / 2
                i, j = np.triu_indices(len(at), 1)
                slopes.append((own[at][j] - own[at][i]) / (at[j] - at[i]))
        slope = float(np.median(np.concatenate(slopes))) if slopes else math.nan
        intercept = float(np.median(y) - slope * np.median(np.arange(n)) / period)
    else:
        s, var = s_and_ties(y)
    if test in ("hamed_rao", "yue_wang"):
        lags = min(lag or n - 1, n - 1)
        detrended = y - slope * np.arange(n)
        k = np.arange(1, lags + 1)
        if test == "hamed_rao":  # ranks, and of those only correlations that are sure at alpha
            rho = _correlations(pd.Series(detrended).rank().to_numpy(), lags)
            rho = np.where(np.abs(rho) > NormalDist().inv_cdf(1 - alpha / 2) / math.sqrt(n), rho, 0)
            var *= 1 + 2 / (n * (n - 1) * (n - 2)) * float(((n - k) * (n - k - 1) * (n - k - 2) * rho).sum())
        else:
            var *= 1 + 2 * float(((1 - k / n) * _correlations(detrended, lags)).sum())
    z, p = p_of(s, var)
    h = p < alpha
    return (p, z, s / pairs if pairs else 0.0, s, var, slope, intercept, int(h), int(np.sign(z)) if h else 0)


def _series(df: DataFrame, value: str, time: str, weight: str | None, keys: list[str]) -> DataFrame:
    """keys, t (months since the first), y, w: each cell's values in the order of time, as arrays."""
    first = df.agg(F.min(time).alias("t0"))
    months = lambda c: F.year(c) * 12 + F.month(c)
    rows = df.crossJoin(F.broadcast(first)).select(*keys, (months(F.col(time)) - months(F.col("t0"))).cast("double").alias("t"), F.col(time).alias("at"), F.col(value).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    points = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "t", "y", "w"))).alias("p"))
    return points.select(*keys, *[F.col(f"p.{k}").alias(k) for k in "tyw"])


def _means(y: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    times, at = np.unique(t, return_inverse=True)
    return np.bincount(at, y) / np.bincount(at), times


def trend_field(df: DataFrame, value: str, time: str = "time", weight: str | None = None, keys: tuple[str, ...] = ("lat", "lon"), alpha: float = 0.05, eps: float = 0.0, aggregate_duplicates: bool = True, per_year: bool = False, compat: bool = False) -> DataFrame:
    """Per cell: p, tau, the Theil-Sen slope for each month (or year), and slope and p where p < alpha.

    `compat` gives the slope for each month over the cube's span in years instead, as older results have it.
    Values that are missing, or have a weight that isn't positive, are left out; equal times are averaged first. Fewer than
    two values give nulls. A cell's series is gathered once; tests run on Arrow batches.
    """

    @F.pandas_udf("p double, tau double, slope double")
    def test(ts: pd.Series, ys: pd.Series, ws: pd.Series) -> pd.DataFrame:
        out = []
        for t, y, w in zip(ts, ys, ws, strict=True):
            t, y, w = (np.asarray([math.nan if v is None else v for v in a], float) for a in (t, y, w))
            ok = np.isfinite(y) & np.isfinite(w) & (w > 0)
            t, y = t[ok], y[ok]
            if aggregate_duplicates and len(t):
                y, t = _means(y, t)
            if len(y) < 2:
                out.append((None, None, None))
                continue
            tau, p = mann_kendall(y, eps)
            out.append((p, tau, sen(y, t)[0] * (12 if per_year else 1)))
        return pd.DataFrame(out, columns=["p", "tau", "slope"], dtype=float)

    rows = _series(df, value, time, weight, list(keys)).withColumn("r", test("t", "y", "w"))
    clear = F.when(F.isnan("r.slope"), None).otherwise(F.col("r.slope"))
    if compat:
        months = lambda c: F.year(c) * 12 + F.month(c)
        rows = rows.crossJoin(F.broadcast(df.agg(((months(F.max(time)) - months(F.min(time))) / 12.0).alias("__years"))))  # one row
        clear = F.try_divide(clear, F.col("__years"))
    sure = F.col("r.p") < alpha
    return rows.select(*keys, "r.p", "r.tau", clear.alias("slope"), F.when(sure, clear).alias("trend"), F.when(sure, F.col("r.p")).alias("p_value"))


def test_field(df: DataFrame, value: str, test: str = "original", time: str = "time", keys: tuple[str, ...] = ("lat", "lon"), alpha: float = 0.05, period: int | None = None, lag: int | None = None, samples_per_year: float | None = None, narrow: bool = True) -> DataFrame:
    """Per cell, the nine results of `battery`; slopes for each year with samples_per_year. Unless narrow is False, doubles become
    floats at the end, as fields are stored."""
    battery(np.arange(4.0), test, alpha, period, lag)  # bad arguments fail here

    @F.pandas_udf(BATTERY)
    def run(ys: pd.Series) -> pd.DataFrame:
        rows = [battery([math.nan if v is None else v for v in y], test, alpha, period, lag) for y in ys]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in BATTERY.split(", ")])
        if samples_per_year:
            out["slope"] *= samples_per_year
        return out.astype({"h": "int8", "trend_code": "int8"})

    out = _series(df, value, time, None, list(keys)).select(*keys, run("y").alias("r")).select(*keys, "r.*")
    return out.withColumns({c: F.col(c).cast("float") for c in ("p", "z", "tau", "s", "var_s", "slope", "intercept")}) if narrow else out


def series_trend(df: DataFrame, value: str = "mean", time: str = "month") -> DataFrame:
    """One row: Theil-Sen slope for each decade, intercept and p of a monthly series; nulls below eight values."""

    @F.pandas_udf("slope_decade double, intercept double, p double")
    def run(ts: pd.Series, ys: pd.Series) -> pd.DataFrame:
        out = []
        for t, y in zip(ts, ys, strict=True):
            t, y = (np.asarray([math.nan if v is None else v for v in a], float) for a in (t, y))
            ok = np.isfinite(y)
            slope, intercept = sen(y[ok], t[ok]) if ok.sum() >= 8 else (math.nan, math.nan)
            out.append((slope * 120, intercept, mann_kendall(y[ok])[1] if ok.sum() >= 8 else math.nan))
        return pd.DataFrame(out, columns=["slope_decade", "intercept", "p"])

    rows = _series(df.withColumn("__one", F.lit(1)), value, time, None, ["__one"])
    return rows.select(run("t", "y").alias("r")).select("r.*")


def samples_per_year(df: DataFrame, time: str = "time") -> DataFrame:
    """One row: 12 where the median step is 25 to 35 days, else steps over the span in years, 1 below two times."""
    days = F.unix_seconds(F.col(time).cast("timestamp")) / 86400.0
    t = neighbours(durable(df.select(days.alias("d")).filter("d IS NOT NULL").distinct()), "d", "before", "after").select("d", (F.col("d") - F.col("before")).alias("gap"))
    span = t.agg(F.count(F.lit(1)).alias("n"), ((F.max("d") - F.min("d")) / 365.2425).alias("years"))
    both = span.crossJoin(exact_percentiles(t, "gap", (0.5,)).select(F.col("q")[0].alias("gap")))  # one row each
    steps = F.try_divide(F.col("n") - 1, F.nullif(F.col("years"), F.lit(0.0)))
    return both.select(F.when(F.col("n") < 2, 1.0).when(F.col("gap").between(25, 35), 12.0).otherwise(steps).alias("samples_per_year"))


__all__ = ["battery", "mann_kendall", "samples_per_year", "sen", "series_trend", "test_field", "trend_field"]
