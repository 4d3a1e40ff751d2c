"""Permutation importance: values are dealt within their blocks, or across all, and nothing else moves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import permutation


def table(spark, n=103):
    rng = np.random.default_rng(4)
    rows = [(int(7 * i), int(rng.random() < 0.5), float(i), float(rng.normal()), "x") for i in range(n)]
    return spark.createDataFrame(rows, "t long, y int, a double, b double, mode_of string").repartition(3)


def test_values_stay_in_their_blocks(spark):
    df = table(spark)
    got = permutation.permuted(df, ["a", "b"], "t", 8, 2, rows_in_bucket=50).toPandas()
    own = df.toPandas().sort_values("t").reset_index(drop=True)
    block = np.arange(103) * 8 // 103
    assert len(got) == 103 * 2 * 2 * 2
    moved = 0
    for (feature, mode, _), part in got.groupby(["feature", "mode", "replicate"]):
        part = part.sort_values("t").reset_index(drop=True)
        other = "b" if feature == "a" else "a"
        assert (part[[other, "y", "t"]] == own[[other, "y", "t"]]).all(axis=None)
        assert sorted(part[feature]) == sorted(own[feature])
        same = all(sorted(part[feature][block == b]) == sorted(own[feature][block == b]) for b in range(8))
        assert same == (mode == "within")
        moved += (part[feature] != own[feature]).sum()
    assert moved > 700
    again = permutation.permuted(df.repartition(7), ["a", "b"], "t", 8, 2).toPandas()
    assert sorted(map(tuple, again.itertuples(index=False))) == sorted(map(tuple, got.itertuples(index=False)))


def test_a_feature_that_tells_the_time_loses_across_only(spark):
    df = spark.createDataFrame([(i, int(i // 50 % 2), float(i // 50 % 2), float(i % 7)) for i in range(400)], "t long, y int, a double, b double")
    got = {r.feature: r for r in permutation.block_importance(df, ["a", "b"], 0.6 * F.col("a") + F.col("b") / 100, "t", "auc", 8, 2).collect()}
    assert got["a"].drop_within_mean == pytest.approx(0) and got["a"].drop_across_mean > 0.3 and got["a"].ratio is None
    assert abs(got["b"].drop_across_mean) < 0.05


def test_too_few_rows_and_none(spark):
    df = table(spark, 5)
    with pytest.raises(ValueError, match="fewer rows"):
        permutation.permuted(df, ["a"], "t", 6, 1)
    with pytest.raises(ValueError, match="blocks"):
        permutation.permuted(df, ["a"], "t", 0, 1)
    assert permutation.permuted(df.limit(0), ["a"], "t", 3, 1).count() == 0


def test_values_are_dealt_by_a_shuffle(spark):
    plan = permutation.permuted(table(spark), ["a", "b"], "t", 8, 2)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line and "_taken#" in line]
    # neither side fits the driver when the table grows
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]


def test_equal_draws_take_turns_in_time(spark, monkeypatch):
    monkeypatch.setattr(permutation, "uniform", lambda *parts: F.lit(0.5))
    rows = [(i, float(i)) for i in range(200)]
    for order in (rows, rows[::-1]):
        got = permutation.permuted(spark.createDataFrame(order, "t long, a double").repartition(5), ["a"], "t", 4, 1).collect()
        assert len(got) == 400 and all(r.a == r.t for r in got)
