"""Feature health against plain loops: runs over blocks of all sizes, odd numbers, constants and drift."""

import math
from itertools import groupby

import numpy as np
import pytest

from barloom.operators import health


def plain(values):
    """n_valid, n_null, n_nan, n_inf, n_leading, n_trailing, n_runs, longest, pattern."""
    missing = [v is None or math.isnan(v) for v in values]
    n, there = len(values), [i for i, m in enumerate(missing) if not m]
    counts = (len(there), sum(v is None for v in values), sum(v is not None and math.isnan(v) for v in values), sum(v is not None and math.isinf(v) for v in values))
    if not there:
        return (*counts, n, n, 0, 0, "all_missing")
    lead, trail = there[0], n - 1 - there[-1]
    inner = [len(list(g)) for m, g in groupby(missing[lead : n - trail]) if m]
    pattern = "clean" if not any(missing) else "scattered" if inner else "edge" if lead and trail else "leading" if lead else "trailing"
    return (*counts, lead, trail, len(inner), max(inner, default=0), pattern)


def columns(n=120):
    rng = np.random.default_rng(6)
    some = lambda share: [None if rng.random() < share else float(rng.normal()) for _ in range(n)]
    holes = some(0.0)
    holes[20:75] = [None] * 55
    edges = [None] * 31 + some(0.0)[31:90] + [float("nan")] * (n - 90)
    return {"a__half": some(0.5), "a__few": some(0.05), "a__clean": some(0.0), "b__hole": holes, "b__edge": edges, "b__none": [None] * n, "b__nan": [float("nan")] * n, "c__inf": [float("inf"), None, 1.0, *some(0.1)[3:]], "c__late": [None] * 60 + some(0.0)[60:], "c__early": some(0.0)[:10] + [None] * (n - 10)}


@pytest.mark.parametrize("block_rows", [1, 7, 40, 1000])
def test_patterns_over_blocks_against_a_loop(spark, block_rows):
    data = columns()
    rows = [(key, k, *[v[k] for v in data.values()]) for key, n in (("x", 120), ("y", 33), (None, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol string, k long, " + ", ".join(f"`{c}` double" for c in data)).repartition(4)
    got = {(r.symbol, r["name"]): r for r in health.missing_patterns(df, list(data), block_rows=block_rows).collect()}
    assert len(got) == 3 * len(data)
    for (key, name), r in got.items():
        n = {"x": 120, "y": 33, None: 1}[key]
        want = plain(data[name][:n])
        assert r.n == n and (r.n_valid, r.n_null, r.n_nan, r.n_inf, r.n_leading, r.n_trailing, r.n_runs, r.longest_run, r.pattern) == want, (key, name)


def test_health_flags_and_families(spark):
    n = 90
    data = {"ret__fine": [math.sin(k) for k in range(n)], "ret__spike": [math.sin(k) + 2 for k in range(n - 1)] + [1e6], "cost__c": [0.5] * n, "cost__filled": [0.0] * n, "vol__moves": [math.sin(k) + (k // 30) * 5 for k in range(n)], "vol__nan": [float("nan")] + [math.sin(k) for k in range(n - 1)], "vol__inf": [float("inf")] + [math.cos(k) for k in range(n - 1)], "ret__undef": [math.sin(3 * k) for k in range(n)]}
    flags = {"undef__cost__filled": [1] * 60 + [0] * 30, "undef__ret__undef": [1] * 50 + [0] * 40}
    rows = [("x", k, *[v[k] for v in (*data.values(), *flags.values())]) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol string, k long, " + ", ".join(f"`{c}` double" for c in data) + ", " + ", ".join(f"`{c}` int" for c in flags))
    made = health.feature_health(df, list(data), block_rows=25).cache()
    rows = {r["name"]: r for r in made.collect()}
    assert rows["cost__filled"].is_imputed_constant and rows["cost__c"].is_constant and not rows["cost__c"].is_imputed_constant
    x = np.array(data["vol__moves"])
    means = [x[i : i + 30].mean() for i in (0, 30, 60)]
    assert math.isclose(rows["vol__moves"].mean_drift, (max(means) - min(means)) / x.std()) and rows["vol__moves"].is_non_stationary
    assert math.isclose(rows["ret__fine"].skew, ((np.array(data["ret__fine"]) - np.mean(data["ret__fine"])) ** 3).mean() / np.std(data["ret__fine"]) ** 3)
    assert math.isclose(rows["ret__spike"].outlier_ratio, 1e6 / np.median(np.abs(data["ret__spike"])))
    issues = {r["name"]: r.issue for r in health.flag_issues(made).collect()}
    assert issues == {"ret__spike": "extreme_outlier", "cost__c": "organic_constant", "cost__filled": "imputed_constant", "vol__moves": "non_stationary", "vol__nan": "residual_nan", "vol__inf": "inf", "ret__undef": "high_undef"}
    families = {r.family: r for r in health.summarize_by_family(made).collect()}
    assert families["cost"].n_features == 2 and families["cost"].n_imputed_constant == families["cost"].n_organic_constant == 1
    assert families["vol"].n_with_inf == 1 and families["ret"].n_extreme_outlier == 1 and math.isclose(families["ret"].max_undef_rate, 50 / 90)
    assert health.feature_health(df.limit(0), list(data)).count() == 0
