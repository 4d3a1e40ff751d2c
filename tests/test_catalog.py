"""Every registered query of the series engine against its SQL in DuckDB; those that read prices also where some are zero."""

import os

import duckdb
import pandas as pd
import pytest

from barloom import catalog, catalog_contracts, catalog_health, catalog_kernels, catalog_metrics, catalog_strategy, catalog_stream  # noqa: F401

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
#: Queries that divide by prices or take their logarithms; events of the larger table have prices of zero.
PRICES = ("block_boundary", "feat_candle", "feat_equilibrium", "feat_extreme", "feat_volatility", "feat_volatility_long", "flagship", "label_barrier", "sim_baseline")


def connect(path):
    c = duckdb.connect()
    for f in os.listdir(path):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}/{f}')")
    return c


@pytest.fixture(scope="module")
def tables():
    return {path: connect(path) for path in (SMALL, LARGE)}


def cells(frame):
    # pandas holds integers with nulls as floats in one frame and as nullable integers in the other
    frame = frame[sorted(frame.columns)].convert_dtypes()
    cell = lambda v: None if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(str, map(cell, row))) for row in frame.itertuples(index=False))


@pytest.mark.parametrize(("name", "path"), [(n, SMALL) for n in sorted(catalog.QUERIES)] + [(n, LARGE) for n in PRICES])
def test_query_equals_its_sql(spark, tables, name, path):
    got = catalog.QUERIES[name](spark, path).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    want = tables[path].execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_every_query_has_sql():
    # an exponential histogram is no SQL; tests/test_metrics.py has a plain one
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"drift_adwin"}
