"""Every query with an oracle against the same SQL in DuckDB, on the smallest tables."""

import pytest
from check import compare, connect
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries

# Too few rows at this size to hold a third page or a model with enough samples.
EMPTY_AT_SMALL = {"paginate", "retrain_due"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def names():
    """The library's own queries; those of the corpus subpackage have tests of their own."""
    return [n for n, fn in queries().items() if fn.__module__.startswith("sessionlens.plans")]


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    status, _ = compare(spark, con, name, queries()[name], oracle_sql().get(name), SMALL)
    assert status.startswith(("ok", "rows=")) or (status == "EMPTY" and name in EMPTY_AT_SMALL), status


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
