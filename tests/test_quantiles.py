"""Exact quantiles by narrowing brackets against numpy."""

import duckdb
import numpy as np
import pytest

from barloom.plans.quantiles import quantile_values, quantiles

QS = [0.0, 0.1, 0.5, 0.77, 1.0]


def samples():
    rng = np.random.default_rng(3)
    return {
        "even": rng.random(700),
        "huge": np.concatenate([np.exp(rng.normal(0, 150, 400)), -np.exp(rng.normal(0, 150, 300)), [1.7e308, -1.7e308, 5e-324, 0.0, -0.0]]),
        "ties": rng.choice([1.0, 1.0 + 2**-52, 3.0], 500),
        "same": np.full(300, 2.5),
        "one": np.array([7.0]),
        "far": np.concatenate([rng.random(300), [1e300]]),
        None: rng.normal(size=90),
    }


@pytest.mark.parametrize(("buckets", "at_most"), [(4, 3), (64, 10), (4096, 10_000)])
def test_groups_against_numpy(spark, buckets, at_most):
    data = samples()
    rows = [(k, float(v)) for k, x in data.items() for v in x] + [("even", None), ("even", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, n double").repartition(4)
    got = {r[0]: (r[1], r[2]) for r in quantiles(df, "n", QS, ("g",), buckets, at_most).collect()}
    assert set(got) == {*data, "empty"} and got["empty"] == (0, None)
    for k, x in data.items():
        n, q = got[k]
        assert n == len(x)
        ordered = np.sort(x)
        for a, v in zip(QS, q):
            at = a * (n - 1)
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            want = low if at == int(at) else (np.ceil(at) - at) * low + (at - np.floor(at)) * high
            assert v == want, (k, a)


def test_whole_column_and_no_rows(spark):
    df = spark.range(1001).selectExpr("cast(id as double) x")
    assert quantile_values(df, "x", [0.25, 0.999]) == [250.0, 999.0]
    assert quantile_values(df.filter("x < 0"), "x", [0.5]) == []
    assert quantiles(df.filter("x < 0"), "x", [0.5]).collect()[0].q is None


def test_cuts_among_ties_and_neighbouring_doubles_equal_sql(spark):
    # p (1 - p) of 0.001 and 0.999 differ in the last bit only: what is between them must fall as in SQL
    sets = {f"{a} {b}": [0.001 * (1 - 0.001)] * a + [0.999 * (1 - 0.999)] * b for a in range(1, 4) for b in range(1, 6)} | {f"{n}": [0.007] * n for n in (3, 5, 6)}
    rows, qs = [(g, x) for g, xs in sets.items() for x in xs], [1 / 3, 2 / 3, 0.1, 0.2, 0.3, 0.7, 0.8, 0.9]
    got = {r.g: r.q for r in quantiles(spark.createDataFrame(rows, "g string, x double"), "x", qs, ("g",)).collect()}
    for g, xs in sets.items():
        want = duckdb.execute(f"SELECT quantile_cont(x, {qs}::DOUBLE[]) FROM (SELECT unnest({xs}::DOUBLE[]) AS x)").fetchone()[0]
        assert got[g] == want, g
