"""Every registered query against its DuckDB counterpart on the smallest data."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from tallyloom.catalog import QUERIES
from tallyloom.oracle import ORACLE
from tests.compare import connect, duckdb_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert spark_rows(entry_points.queries()[name](spark, FOLDER)) == duckdb_rows(duck, entry_points.oracle_sql()[name])


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
