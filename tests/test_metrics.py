"""Mergeable metrics against numpy, and adaptive windowing against a plain implementation that keeps every value."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import adwin, metrics, scores
from barloom.operators.resampling import CDF, resampled


def auc(y, p, w):
    pairs = [(w[i] * w[j], (p[i] > p[j]) + (p[i] == p[j]) / 2) for i in range(len(y)) for j in range(len(y)) if y[i] and not y[j]]
    return sum(a * b for a, b in pairs) / sum(a for a, _ in pairs)


def plain(rows):
    y, p, w = (np.array([r[i] for r in rows], float) for i in range(3))
    bins = np.minimum(np.floor(p * 10), 9)
    order = np.unique(p)[::-1]
    tp = [w[(p >= t) & (y == 1)].sum() for t in order]
    taken = [w[p >= t].sum() for t in order]
    ap = sum((a - b) * a / n for a, b, n in zip(tp, [0, *tp], taken)) / w[y == 1].sum()
    return {"brier": (w * (p - y) ** 2).sum() / w.sum(), "ece": sum(abs((w * (p - y))[bins == b].sum()) for b in range(10)) / w.sum(), "auc": auc(y, p, w), "ap": ap, "hits": (w * y * (p > 0.5)).sum() / w.sum()}


def table(n=120, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.random() < 0.4), round(float(rng.random()), 2), float(rng.integers(1, 4)), [None, "a", "b"][i % 3]) for i in range(n)]


@pytest.fixture
def hits():
    metrics.register_metric("hits", lambda: {"right": F.when(F.col("p") > 0.5, F.col("y")).otherwise(0)}, lambda get: get("right") / get("n"))
    yield "hits"
    del metrics.METRICS["hits"]


def test_whole_groups_and_weights_against_numpy(spark, hits):
    rows, names = table(), ["brier", "ece", "auc", "ap", hits]
    df = spark.createDataFrame(rows, "i int, y int, p double, w double, g string").repartition(3)
    for by, weight in (((), None), ((), "w"), (("g",), None), (("g",), "w")):
        got = metrics.evaluate(df, names, by, weight).collect()
        assert len(got) == (3 if by else 1)
        for r in got:
            own = [x for x in rows if not by or x[4] == r.g]
            want = plain([(x[1], x[2], x[3] if weight else 1.0) for x in own])
            assert r.n == len(own)
            for m in names:
                assert math.isclose(r[m], want[m], rel_tol=1e-9), m


def test_groups_of_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0.4, "a"), (1, 0.6, "a"), (0, 0.2, "b"), (1, 0.2, "b")], "y int, p double, g string")
    got = {r.g: r for r in metrics.evaluate(df, ["brier", "auc"], ("g",)).collect()}
    assert got["a"].brier is None and got["a"].auc is None and got["b"].auc == 0.5 and got["b"].n_pos == 1
    assert metrics.evaluate(df, ["brier"], ("g",), both_classes=False).filter("g = 'a'").first().brier == pytest.approx((0.36 + 0.16) / 2)
    assert metrics.evaluate(df.limit(0), ["brier", "auc"]).first().brier is None and metrics.evaluate(df.limit(0), ["auc"], ("g",)).count() == 0
    with pytest.raises(ValueError, match="already"):
        metrics.register_metric("auc", dict, lambda get: get("n"))
    with pytest.raises(ValueError, match="no metric"):
        metrics.evaluate(df, ["none"])


def test_bands_are_those_of_the_drawn_replicates(spark):
    rows = table(90, 2)
    df = spark.createDataFrame(rows, "i int, y int, p double, w double, g string")
    got = {r.g: r for r in metrics.with_bands(df, ["auc", "brier"], "i", 30, by=("g",), min_rows=5).collect()}
    drawn = resampled(df, "i", 30).toPandas()
    for g, r in got.items():
        values = []
        for _, part in drawn[drawn["g"].isna() if g is None else drawn["g"] == g].groupby("replicate"):
            if 0 < part["y"].sum() < len(part):
                values.append(plain(list(zip(part["y"], part["p"], part["w"])))["auc"])
        assert r.n_effective == len(values)
        assert math.isclose(r.auc_low, np.quantile(values, 0.025)) and math.isclose(r.auc_high, np.quantile(values, 0.975))
        assert r.auc_low <= r.auc <= r.auc_high
    assert set(got) == {None, "a", "b"} and len(CDF) > 5


def test_small_groups_are_left_out(spark):
    df = spark.createDataFrame(table(60), "i int, y int, p double, w double, g string")
    assert metrics.with_bands(df, ["brier"], "i", 5, by=("g",), min_rows=21).count() == 0
    assert metrics.with_bands(df, ["brier"], "i", 5, min_pos=1).count() == 1


# ---- adaptive windowing ----------------------------------------------------------------------------------------------------------


def plain_adwin(batches, delta):
    """Alarm and width after each batch (a list of values); buckets are lists of all their values, oldest first, with their size in batches."""
    window, out = [], []
    for batch in batches:
        window.append((1, list(batch)))
        size = 1
        while sum(s == size for s, _ in window) > adwin.ROOM:
            a, b = [i for i, (s, _) in enumerate(window) if s == size][:2]
            window[a : b + 1] = [(2 * size, window[a][1] + window[b][1])]
            size *= 2
        alarm = False
        while True:
            every = [v for _, values in window for v in values]
            n, cut = len(every), False
            for i in range(1, len(window)):
                left = [v for _, values in window[:i] for v in values]
                right = every[len(left) :]
                if n < adwin.GRACE or min(len(left), len(right)) < adwin.LEAST:
                    continue
                chance, m = math.log(2 * math.log(n) / delta), 1 / len(left) + 1 / len(right)
                bound = math.sqrt(2 * m * np.var(every) * chance) + 2 / 3 * m * chance
                cut |= abs(np.mean(left) - np.mean(right)) > bound
            if not cut:
                break
            window.pop(0)
            alarm = True
        out.append((alarm, sum(len(v) for _, v in window)))
    return out


@pytest.mark.parametrize(("clock", "delta"), [(1, 0.002), (4, 0.05), (16, 0.002)])
def test_alarms_equal_a_plain_window(spark, clock, delta):
    rng = np.random.default_rng(clock)
    n = 60 * clock if clock > 1 else 220
    x = np.concatenate([rng.normal(0, 0.1, n), rng.normal(1.2, 0.2, n), rng.normal(0.1, 0.1, n)])
    x[rng.choice(len(x), 20, replace=False)] = np.nan
    rows = [(key, k, None if math.isnan(v) else float(v if key == "a" else -v)) for key in ("a", "b") for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "key string, k long, v double").repartition(5)
    got = adwin.adwin(df, "key", "k", "v", delta, clock).toPandas()
    values = [[v for v in x[i : i + clock] if not math.isnan(v)] for i in range(0, len(x), clock)]
    want = plain_adwin([b for b in values if b], delta)
    for key in ("a", "b"):
        own = got[got["key"] == key].sort_values("batch")
        assert list(zip(own["alarm"].tolist(), own["width"].tolist())) == want
    assert sum(a for a, _ in want) >= 2


def test_labelled_documents(spark):
    df = scores.from_documents(spark, "/root/testdata/sf0.01").withColumn("late", F.when(F.col("doc_id") > 500, 0.9).otherwise(0.1) + F.col("p") / 100)
    got = adwin.adwin(df, "lang", "doc_id", "late", clock=32).toPandas()
    pdf = df.toPandas()
    for lang, own in got.groupby("lang"):
        mine = pdf[pdf["lang"] == lang].sort_values("doc_id")
        batches = [b["late"].tolist() for _, b in mine.groupby(mine["doc_id"] // 32)]
        own = own.sort_values("batch")
        assert list(zip(own["alarm"].tolist(), own["width"].tolist())) == plain_adwin(batches, 0.002)
    assert got["alarm"].any()


def test_merging_batches_keeps_moments():
    rng = np.random.default_rng(0)
    x = rng.normal(5, 2, 700)
    window = adwin.Window(1e-9)
    for part in np.array_split(x, 90):
        assert not window.add((float(len(part)), part.mean(), part.var() * len(part)))
    n, mean, squares = window.total()
    assert n == 700 and math.isclose(mean, x.mean()) and math.isclose(squares / n, x.var())
    assert all(len(s) <= adwin.ROOM for s in window.sizes)
