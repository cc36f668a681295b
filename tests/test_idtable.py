"""The bucketed id table: exact, bounded in the files it opens, unharmed by retries and by a settling that died."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.sources.idtable import IdTable, new_by_table

ROWS = "id string, at int"


@pytest.fixture
def ids(spark, tmp_path):
    return IdTable(spark, str(tmp_path / "ids"), buckets=8, settle_every=4)


def files(frame):
    return {r[0] for r in frame.select(F.input_file_name()).distinct().collect()}


def test_new_rows_over_many_batches_equal_a_set(table, ids):
    dice, seen = random.Random(2), set()
    for batch_id in range(7):
        values = [dice.choice([None, *(f"m{n}" for n in range(40))]) for _ in range(12)]
        arrived = table(ROWS, *[(v, n) for n, v in enumerate(values)])
        fresh = new_by_table(arrived, "id", ["at"], ids, batch_id).collect()
        first = {v: n for n, v in reversed(list(enumerate(values))) if v is not None and v not in seen}
        assert sorted((r.id, r.at) for r in fresh if r.id) == sorted(first.items())
        assert sum(r.id is None for r in fresh) == values.count(None)
        for _ in range(2):  # a retried batch stores the same ids again and sees earlier batches only
            ids.add(table(ROWS, *[(v, 0) for v in first]).select("id"), batch_id)
        assert {r.id for r in ids.known(table(ROWS, *[(f"m{n}", 0) for n in range(40)]).select("id"), batch_id).collect()} == seen
        seen |= set(first)


def test_files_read_do_not_grow_with_the_batches(spark, ids):
    most = []
    asked = spark.createDataFrame([("b3-7",), ("absent",)], "id string")
    for batch_id in range(12):
        ids.add(spark.range(60).selectExpr(f"concat('b{batch_id}-', id) as id"), batch_id)
        found = ids.candidates(asked, batch_id + 1)
        most.append(len(files(found)) if found.limit(1).count() else 0)
        if batch_id >= 3:  # also when its batch is settled
            assert [r.id for r in ids.known(asked, batch_id + 1).collect()] == ["b3-7"]
    # Two buckets, each with one settled file and at most four recent ones.
    assert max(most) <= 2 * (1 + 4)


def test_a_settling_that_died_is_not_read(spark, ids):
    for batch_id in range(2):
        ids.add(spark.range(10).selectExpr(f"concat('b{batch_id}-', id) as id"), batch_id)
    spark.createDataFrame([("half", 1)], "id string, id_bucket int").write.partitionBy("id_bucket").parquet(f"{ids.root}/settled/until=1")
    asked = spark.createDataFrame([("b0-1",), ("b1-2",), ("half",)], "id string")
    assert {r.id for r in ids.known(asked, 2).collect()} == {"b0-1", "b1-2"}
    ids.settle(1)
    assert ids.settled_until() == 1 and {r.id for r in ids.known(asked, 2).collect()} == {"b0-1", "b1-2"}


def test_no_ids(spark, ids):
    none = spark.createDataFrame([(None,)], "id string")
    ids.add(none, 0)
    assert ids.known(none, 1).collect() == [] and ids.known(none.limit(0), 1).collect() == []
