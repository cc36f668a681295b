from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[*]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """A small DataFrame from a schema and rows."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples."""
    return lambda frame, *columns: sorted(
        (tuple(r) for r in (frame.select(*columns) if columns else frame).collect()),
        key=lambda r: [(v is not None, str(v)) for v in r])
