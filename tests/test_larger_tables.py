"""Queries whose rows at sf0.1 show what those at sf0.001 don't: no gaps to impute, cuts at quantiles among ties."""

import pytest

from barloom import catalog, catalog_strategy  # noqa: F401
from tests.test_catalog import LARGE, cells, connect


@pytest.mark.parametrize("name", ["impute_flags", "sim_regimes"])
def test_query_equals_its_sql_at_the_larger_size(spark, name):
    got, want = catalog.QUERIES[name](spark, LARGE).toPandas(), connect(LARGE).execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)
