"""First passages, labels and exits far ahead, and the interval join, against loops."""

import math

import numpy as np
import pandas as pd
import pytest

from barloom.functions.rolling import Rows
from barloom.operators import labels, passage, strategy
from barloom.plans import intervals
from barloom.plans.blocks import in_blocks


def nan_to_none(rows):
    return [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]


@pytest.mark.parametrize("horizon", [1, 2, 3, 7, 64, 1000])
def test_ahead_against_a_loop(horizon):
    rng = np.random.default_rng(horizon)
    x = rng.choice([1.0, 2.0, 3.0, 9.0, np.nan, np.inf], 300, p=[0.4, 0.3, 0.2, 0.04, 0.05, 0.01])
    levels = rng.choice([0.5, 2.0, 3.0, 9.0, np.nan], 300)
    ahead = passage.Ahead(x)
    best, first = ahead.greatest(horizon), ahead.first(np.arange(300), lambda v: v >= levels, horizon)
    present = passage.count_ahead(~np.isnan(x), horizon)
    for i in range(300):
        window = x[i + 1 : i + 1 + horizon]
        seen = window[~np.isnan(window)]
        assert best[i] == (seen.max() if len(seen) else -np.inf) and present[i] == len(seen)
        assert first[i] == next((n for n, v in enumerate(window, 1) if v >= levels[i]), 0)
    assert len(ahead.best) <= max(1, horizon.bit_length())
    assert passage.Ahead(np.zeros(0)).first(np.zeros(0, int), lambda v: v >= 1, 5).tolist() == []


def walk(n, seed, symbol="x"):
    rng = np.random.default_rng(seed)
    close = np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    return pd.DataFrame({"symbol": symbol, "k": np.arange(n), "close": close, "high": close * 1.004, "low": close * 0.996, "p": rng.random(n)})


def test_labels_of_a_long_horizon_in_blocks(spark):
    bars = walk(3000, 1)
    bars.loc[[500, 1200], "high"] = np.nan
    df = spark.createDataFrame(nan_to_none(bars.itertuples(index=False)), "symbol string, k long, close double, high double, low double, p double")
    got = in_blocks(df, lambda d, rows: labels.barrier_labels(d, 700, 0.05, rows=rows), 0, 250, ahead=700).toPandas().sort_values("k")
    whole = labels.barrier_labels(df, 700, 0.05, rows=Rows()).toPandas().sort_values("k")
    for frame in (got, whole):
        for k, y, m, tau in zip(frame["k"], frame["y"], frame["m_k"], frame["tau_k"]):
            window = bars["high"].to_numpy()[k + 1 : k + 701]
            if len(window) < 700:
                assert math.isnan(y) and math.isnan(m)
            elif np.isnan(window).any():
                assert y == 0 and math.isnan(m) and math.isnan(tau)
            else:
                gains = np.log(window / bars["close"][k])
                assert math.isclose(m, gains.max()) and y == (gains.max() >= 0.05)
                assert math.isnan(tau) if not y else tau == 1 + np.argmax(gains >= 0.05)


def test_exits_and_takes_far_ahead(spark):
    bars = pd.concat([walk(1500, 2), walk(40, 3, "short")])
    df = spark.createDataFrame(bars)
    specs = [strategy.Strategy("far", 0.97, 0.15, 0.12, 900), strategy.Strategy("free", 0.98, 0.3, 0.0, 400, max_open=9)]
    found = strategy.candidates(df, specs, block_rows=128).collect()
    assert len(found) == sum((bars["p"] >= s.threshold).sum() for s in specs)
    for r in found:
        s, path = next(x for x in specs if x.name == r.strategy), bars[bars["symbol"] == r.symbol].reset_index(drop=True)
        want = None, None
        for k in range(r.k_entry + 1, min(r.k_entry + s.horizon, len(path) - 1) + 1):
            if s.stop > 0 and path["low"][k] <= r.entry_price * math.exp(-s.stop):
                want = k, "sl"
            elif path["high"][k] >= r.entry_price * math.exp(s.take):
                want = k, "tp"
            elif k == r.k_entry + s.horizon:
                want = k, "expiry"
            if want[0]:
                break
        assert (r.k_exit, r.exit_reason) == want
    assert {r.exit_reason for r in found} == {None, "sl", "tp", "expiry"}
    ledger = strategy.simulate(df, specs, 128)
    for r in strategy.time_to_take(ledger, df, 0.2, 1000, 100).collect():
        highs = bars[bars["symbol"] == r.symbol]["high"].to_numpy()[r.k_entry + 1 : r.k_entry + 1001]
        hits = np.flatnonzero(highs >= r.entry_price * math.exp(0.2))
        assert r.would_take == (hits[0] + 1 if len(hits) else None) and r.held == r.k_exit - r.k_entry


def test_interval_join_over_lengths_of_all_sizes(spark, monkeypatch):
    monkeypatch.setattr(intervals, "TOUCHES", 5)
    monkeypatch.setattr(intervals, "WIDER", 4)
    rng = np.random.default_rng(1)
    spans = [(int(k), int(s), int(s + n)) for k, s, n in zip(rng.integers(0, 3, 200), rng.integers(-500, 900, 200), rng.choice([-1, 0, 1, 7, 60, 900, 100_000], 200))] + [(None, 0, 10), (1, None, 5)]
    points = [(int(k), int(a)) for k, a in zip(rng.integers(0, 4, 300), rng.integers(-500, 1500, 300))] + [(None, 3), (1, None)]
    made = intervals.interval_join(spark.createDataFrame(points, "key int, at long"), spark.createDataFrame(spans, "key int, a long, b long"), ["key"], "at", "a", "b", 3)
    want = sorted((k, at, a, b) for k, at in points for j, a, b in spans if None not in (k, at, a) and k == j and a <= at <= b)
    assert sorted(map(tuple, made.select("key", "at", "a", "b").collect())) == want and len(want) > 1000
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_long_span_is_copied_to_few_buckets(spark):
    spans = spark.createDataFrame([(1, 0, 10**9), (1, 5, 6)], "key int, a long, b long")
    level = spans.withColumn("level", intervals._level(spans.b - spans.a, 16)).collect()
    assert [r.level for r in level] == [4, 0] and 10**9 / (16 * 32**4) < intervals.TOUCHES


def test_open_book_against_a_loop(spark):
    bars = walk(400, 5)
    bars.loc[100, "close"] = 0.0
    held = [("x", "s", 3, 390, 1.0), ("x", "s", 3, 3, 0.9), ("x", "s", 50, 60, 1.1), ("x", "t", 399, 399, 1.0), ("x", "s", 70, 90, 0.0), ("y", "s", 1, 2, 1.0)]
    ledger = spark.createDataFrame(held, "symbol string, strategy string, k_entry long, k_exit long, entry_price double")
    edges = [-0.1, -0.01, 0.0, 0.05, 0.1]
    got = strategy.open_book(ledger, spark.createDataFrame(bars), edges, width=2).toPandas()
    assert len(got) == 800
    for r in got.itertuples():
        close = bars["close"][r.k]
        mtm = [math.log(close / p) for s, n, a, b, p in held if s == "x" and n == r.strategy and a <= r.k <= b and p > 0 and close > 0]
        bins = np.clip(np.digitize(mtm, edges) - 1, 0, 3) if mtm else []
        assert r.n_open == len(mtm) and math.isclose(r.sum_mtm, sum(mtm), abs_tol=1e-12)
        assert [r.in_bin_0, r.in_bin_1, r.in_bin_2, r.in_bin_3] == [list(bins).count(n) for n in range(4)]
        assert math.isclose(r.worst_mtm, min(mtm)) if mtm else math.isnan(r.worst_mtm)
