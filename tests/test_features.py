"""Window functions and features against pandas, in both physical forms, and their causality."""

from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.rolling import Rows, norm_cdf, with_windows
from barloom.operators import features, labels
from barloom.plans.blocks import in_blocks
from barloom.sources import bars as source


def series(n=200, seed=3):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(size=n)) + 100
    x[[5, 50, 51]] = np.nan
    return pd.DataFrame({"symbol": "a", "k": np.arange(n), "x": x, "y": rng.normal(size=n)})


def frame(spark, pdf):
    clean = [tuple(None if isinstance(v, float) and v != v else v for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(clean, "symbol string, k long, x double, y double")


@pytest.mark.parametrize("direct", [0, 1000])
@pytest.mark.parametrize("w", [1, 3, 20])
def test_rolling_against_pandas(spark, direct, w):
    pdf, rows = series(), Rows(direct=direct)
    made = {n: getattr(rows, n)("x", w) for n in ("sum", "mean", "std", "min", "max")}
    got = with_windows(frame(spark, pdf), rows, made).toPandas().sort_values("k")
    roll = pdf.x.rolling(w, min_periods=w)
    want = {"sum": roll.sum(), "mean": roll.mean(), "std": roll.std(ddof=0), "min": roll.min(), "max": roll.max()}
    for name, values in want.items():
        assert np.allclose(got[name].to_numpy(float), values.to_numpy(), atol=1e-5, equal_nan=True), name


@pytest.mark.parametrize("direct", [4, 64])
def test_order_statistics_lines_and_parabolas_against_pandas(spark, direct):
    pdf, rows, w = series(80), Rows(direct=direct), 9
    slope, (one, two) = rows.line("x", w), rows.parabola("x", w)
    made = {"q": rows.quantile("x", w, 0.1), "mad": rows.mad("x", w), "corr": rows.corr("x", "y", w), "rank": rows.rank("x", w), "some": rows.mad("x", w, 5), "slope": slope[1], "rest": slope[2], "one": one, "two": two}
    got = with_windows(frame(spark, pdf), rows, made).toPandas().sort_values("k").reset_index(drop=True)
    u = np.arange(w) - (w - 1) / 2
    fit = lambda degree, k: pdf.x.rolling(w, min_periods=w).apply(lambda v: np.polynomial.polynomial.polyfit(u, v, degree)[k], raw=True).to_numpy()
    for c, want in (("slope", fit(1, 1)), ("one", fit(2, 1)), ("two", fit(2, 2))):
        assert np.allclose(got[c].to_numpy(float), want, atol=1e-6, equal_nan=True), c
    rest = pdf.x.rolling(w, min_periods=w).apply(lambda v: np.std(v - np.polyval(np.polyfit(u, v, 1), u)), raw=True)
    assert np.allclose(got.rest.to_numpy(float), rest.to_numpy(), atol=1e-5, equal_nan=True)
    assert np.allclose(got.some.to_numpy(float), np.where(got.k % 5 == 0, got.mad.to_numpy(float), np.nan), equal_nan=True)
    roll = pdf.x.rolling(w, min_periods=w)
    assert np.allclose(got.q.to_numpy(float), roll.quantile(0.1).to_numpy(), equal_nan=True)
    assert np.allclose(got.mad.to_numpy(float), roll.apply(lambda v: np.median(np.abs(v - np.median(v))), raw=True).to_numpy(), equal_nan=True)
    assert np.allclose(got["rank"].to_numpy(float), roll.apply(lambda v: (v <= v[-1]).mean(), raw=True).to_numpy(), equal_nan=True)
    both = pd.concat([pdf.x, pdf.y.where(pdf.x.notna())], axis=1)
    want = both.iloc[:, 0].rolling(w, min_periods=w).corr(both.iloc[:, 1])
    assert np.allclose(got["corr"].to_numpy(float), want.to_numpy(), atol=1e-6, equal_nan=True)


def test_normal_distribution_function(spark):
    xs = [-9.0, -4.2, -3.6, -3.4, -1.0, -1e-9, 0.0, 0.3, 2.0, 3.5, 6.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(norm_cdf(F.col("x")).alias("p")).collect()]
    assert np.allclose(got, [NormalDist().cdf(x) for x in xs], rtol=1e-9, atol=1e-15)


SF = "/root/testdata/sf0.001"
#: Those that need bars only.
FAMILIES = sorted({f.family for f in features.REGISTRY.values()} - {"derivatives", "vov", "funding", "options", "oi_regime"})


def all_features(base, rows=None):
    df, names = features.add_features(base, FAMILIES, (5, 10), rows)
    keys = ["symbol", "k", "_block"] if "_block" in base.columns else ["symbol", "k"]
    return df.select(*keys, *names)


def test_blocks_with_halos_change_nothing(spark):
    base = source.base_series(source.hourly(spark, SF)).filter("symbol = 'click'").cache()
    whole = all_features(base).toPandas().sort_values("k").reset_index(drop=True)
    cut = in_blocks(base, all_features, features.warmup(features.select(), (5, 10)), 64).toPandas().sort_values("k").reset_index(drop=True)
    assert list(whole.columns) == list(cut.columns) and len(whole) == len(cut)
    for c in whole.columns[2:]:
        assert np.allclose(whole[c].to_numpy(float), cut[c].to_numpy(float), rtol=1e-6, atol=1e-6, equal_nan=True), c


def test_the_future_does_not_change_features(spark):
    base = source.base_series(source.hourly(spark, SF)).filter("symbol = 'view'")
    until = all_features(base.filter("k < 100")).toPandas().sort_values("k").reset_index(drop=True)
    whole = all_features(base).filter("k < 100").toPandas().sort_values("k").reset_index(drop=True)
    pd.testing.assert_frame_equal(until, whole)


def test_register_refuses_a_known_pattern():
    with pytest.raises(ValueError, match="already"):
        features.register("rolling", "ret__mean__f__w{w}", (3,), lambda rows, w: F.col("r"))


def test_barrier_label_against_a_loop(spark):
    pdf = series(60)
    pdf["close"], pdf["high"] = pdf.x.fillna(100).to_numpy(), (pdf.x + 0.5).to_numpy()
    rows = [tuple(None if isinstance(v, float) and v != v else v for v in r) for r in pdf[["symbol", "k", "close", "high"]].itertuples(index=False)]
    got = labels.barrier_labels(spark.createDataFrame(rows, "symbol string, k long, close double, high double"), 4, 0.01).toPandas().sort_values("k")
    for i, r in enumerate(got.itertuples(index=False)):
        ahead = pdf.high[i + 1 : i + 5].to_numpy()
        if len(ahead) < 4:
            assert pd.isna(r.y) and pd.isna(r.m_k)
        elif np.isnan(ahead).any():
            assert r.y == 0 and pd.isna(r.m_k)
        else:
            gains = np.log(ahead / pdf.close[i])
            assert np.isclose(r.m_k, gains.max()) and r.y == int(gains.max() >= 0.01)
            assert (pd.isna(r.tau_k) and r.y == 0) or r.tau_k == 1 + np.argmax(gains >= 0.01)


def test_impute_flags_only_columns_with_gaps(spark):
    df = labels.impute(frame(spark, series(60)), {"x": 0.0, "y": 1.0})
    assert "undef__x" in df.columns and "undef__y" not in df.columns
    assert df.filter("undef__x = 1").count() == 3 and df.filter("x is null").count() == 0


def test_impute_flags_named_columns_whatever_the_rows_are(spark):
    df = labels.impute(frame(spark, series(60)), {"x": 0.0, "y": 1.0}, ["y"])
    assert [c for c in df.columns if c.startswith("undef__")] == ["undef__y"]
    assert df.filter("undef__y <> 0").count() == 0 and df.filter("x is null").count() == 0
