"""Trend kernels against all pairs."""

import math
import time

import numpy as np
import pytest

from pluviant.operators import trend


def all_pairs_s(y, eps):
    return float(sum((y[k + 1 :] - y[k] > eps).sum() - (y[k + 1 :] - y[k] < -eps).sum() for k in range(len(y))))


def all_pairs_slope(y, t):
    i, j = np.triu_indices(len(y), 1)
    dt = t[j] - t[i]
    return float(np.median((y[j] - y[i])[dt != 0] / dt[dt != 0])) if (dt != 0).any() else math.nan


def series(rng, kind, n):
    return [rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.integers(0, 50, n) / 7 + np.arange(n) * 0.1, np.cumsum(rng.normal(size=n)), np.full(n, 3.0)][kind]


@pytest.mark.parametrize("kind", range(5))
def test_s_counts_all_pairs(kind):
    rng = np.random.default_rng(kind)
    for n in (0, 1, 2, 3, 17, 64, 90):
        y = series(rng, kind, n)
        for eps in (0.0, 0.1, 1 / 3, 0.5, 2.0):
            s, var = trend.s_and_ties(y, eps)
            assert s == all_pairs_s(y, eps) and var <= n * (n - 1) * (2 * n + 5) / 18


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("gaps", [False, True])
def test_slope_by_selection_is_that_of_all_pairs(monkeypatch, kind, gaps):
    monkeypatch.setattr(trend, "ALL_PAIRS", 0)
    rng = np.random.default_rng(kind)
    for n in (1, 2, 5, 40, 150, 290):
        y = series(rng, kind, n)
        t = np.sort(rng.integers(0, max(2, n // 2), n)).astype(float) if gaps else np.arange(n, dtype=float)
        want = all_pairs_slope(y, t)
        got = trend.sen(y, t)[0]
        assert math.isnan(got) and math.isnan(want) or got == pytest.approx(want, rel=1e-9, abs=1e-12), (n, got, want)


def test_slope_between_two_that_many_pairs_share():
    y = np.concatenate([np.zeros(1500), np.arange(1500.0)])
    assert trend.sen(y, np.arange(3000.0))[0] == pytest.approx(all_pairs_slope(y, np.arange(3000.0)), rel=1e-12)


def test_long_series_take_seconds():
    rng = np.random.default_rng(0)
    y, began = rng.normal(size=100_000) + np.arange(100_000) * 1e-4, time.monotonic()
    tau, p = trend.mann_kendall(y)
    slope, _ = trend.sen(y, np.arange(100_000.0))
    assert tau > 0.9 and p < 1e-9 and slope == pytest.approx(1e-4, rel=0.01) and time.monotonic() - began < 60
