"""Queries of the package against DuckDB, where SQL can express them."""

from __future__ import annotations

import pytest

from tallyloom.llm.queries import QUERIES
from tallyloom.llm.sql import ORACLE
from tests.compare import connect, duckdb_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, duck, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == duckdb_rows(duck, ORACLE[name])


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
