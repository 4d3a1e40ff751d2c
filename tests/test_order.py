"""Order statistics by wavelet matrix against sorting every window."""

import numpy as np
import pytest

from barloom.functions.order import WaveletMatrix
from barloom.functions.rolling import order_statistic


def data(kind, n=400):
    rng = np.random.default_rng(5)
    x = {"spread": rng.normal(size=n), "ties": rng.choice([1.0, 2.0, 2.5, 7.0], n), "same": np.full(n, 3.0), "huge": np.exp(rng.normal(0, 200, n))}[kind]
    x[[17, 200, 201]] = np.nan
    return x


@pytest.mark.parametrize("kind", ["spread", "ties", "same", "huge"])
@pytest.mark.parametrize("w", [1, 2, 3, 50, 151])
def test_windows_against_sorting(kind, w):
    x, k = data(kind), np.arange(400)
    windows = [x[i - w + 1 : i + 1] if i >= w - 1 else np.full(w, np.nan) for i in range(400)]
    broken = np.array([np.isnan(v).any() for v in windows])
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        assert np.array_equal(order_statistic(x, k, "quantile", w, 1, q), [np.nan if b else np.quantile(v, q) for v, b in zip(windows, broken)], equal_nan=True)
    assert np.array_equal(order_statistic(x, k, "mad", w, 1), [np.nan if b else np.median(np.abs(v - np.median(v))) for v, b in zip(windows, broken)], equal_nan=True)
    assert np.array_equal(order_statistic(x, k, "rank", w, 3), [np.nan if b or i % 3 else (v <= v[-1]).sum() / w for i, (v, b) in enumerate(zip(windows, broken))], equal_nan=True)


def test_counts_of_any_value_in_any_window():
    x, rng = data("ties"), np.random.default_rng(1)
    lo = rng.integers(0, 400, 300)
    hi = np.minimum(lo + rng.integers(0, 400, 300), 400)
    asked = rng.choice([0.0, 1.0, 2.2, 7.0, 9.0, np.nan, np.inf, -np.inf], 300)
    assert WaveletMatrix(x).count_at_most(lo, hi, asked).tolist() == [int((x[a:b] <= v).sum()) for a, b, v in zip(lo, hi, asked)]
    for n in (0, 1):
        assert WaveletMatrix(np.zeros(n)).count_at_most(np.zeros(n), np.full(n, n), np.zeros(n)).tolist() == [1] * n


def test_production_window_equals_sorting():
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=24_000))
    got = [order_statistic(x, np.arange(24_000), *a) for a in (("quantile", 20_160, 1, 0.9), ("mad", 20_160, 1), ("rank", 20_160, 1))]
    for i in (20_159, 21_000, 23_999):
        v = x[i - 20_159 : i + 1]
        assert got[0][i] == np.quantile(v, 0.9) and got[1][i] == np.median(np.abs(v - np.median(v))) and got[2][i] == (v <= v[-1]).mean()
    assert all(np.isfinite(g[20_159:]).all() and np.isnan(g[:20_159]).all() for g in got)
