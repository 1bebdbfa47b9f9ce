"""Every registered query against its SQL on DuckDB."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, folder, name):
    difference = compare(spark, con, QUERIES[name], ORACLES[name], folder)
    assert difference is None, difference


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 8
