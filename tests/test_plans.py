"""What the physical plans must and must not hold."""

from __future__ import annotations

import re
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tallyloom.catalog import BANDS, QUERIES, Tables, _plain
from tallyloom.functions.periods import Periods
from tallyloom.operators.keyed import first_per_key
from tallyloom.plans import messages as feed
from tallyloom.plans import performance, quality
from tallyloom.sources.sinks import replace_snapshot, write_sales
from tallyloom.sources.tables import read_sales
from tests.compare import spark_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def whole_plan_texts(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def final_plan_of(frame) -> str:
    frame.collect()
    return plan_of(frame)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_no_cross_join_no_single_task_window(spark, name):
    plan = plan_of(entry_points.queries()[name](spark, FOLDER))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroups", "MapInPandas", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert node not in plan, node
    for exchange in re.findall(r"Exchange SinglePartition.*\n.*", plan):
        assert "partial_" in exchange, exchange


def test_sales_scan_is_bounded_and_read_once(spark):
    plan = plan_of(entry_points.queries()["performance_snapshot"](spark, FOLDER))
    scans = [line for line in plan.split("\n") if "FileScan" in line and "lineitem" in line]
    assert len(scans) == 1
    assert "GreaterThanOrEqual(l_shipdate,2000-05-29" in scans[0] and "LessThan(l_shipdate,2000-07-01" in scans[0]
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in scans[0]


def test_notes_filters_reach_the_scan(spark):
    t = Tables(spark, FOLDER)
    plan = plan_of(quality.latest_notes(t.base("events").selectExpr(
        "event_id as id", "user_id as employee_id", "event_type as customer_name", "props as message_text",
        "ts as message_at", "event_type as label", "event_type as phrase"), t.employees, employee_id=7, label="view",
        date_from=date(2024, 1, 10), date_to=date(2024, 1, 20)))
    assert "TakeOrderedAndProject" in plan
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema: struct<event_id", plan)[1]
    for part in ("EqualTo(user_id,7)", "EqualTo(event_type,view)", "GreaterThanOrEqual(ts,2024-01-10", "LessThan(ts,2024-01-21"):
        assert part in pushed


def test_a_few_rules_are_scanned_without_join_or_shuffle(spark):
    t = Tables(spark, FOLDER)
    plan = plan_of(quality.notes_per_message(t.messages, t.keywords, in_place=True))
    assert "Join" not in plan and "Exchange" not in plan


def test_a_delivery_is_parsed_once(spark, table):
    payloads = table("payload_id string, payload string, received_at timestamp", ("1", "{}", None))
    plan = plan_of(feed.flatten_payloads(feed.parse_payloads(payloads)))
    assert plan.count("from_json") == 2  # the delivery and each message


def test_history_is_scanned_once_for_its_ids(spark):
    t = Tables(spark, FOLDER)
    arrived = t.deliveries
    stored = t.base("documents").select(F.col("lang").alias("channel_message_id"))
    plan = plan_of(feed.new_messages(arrived, stored, feed.ARRIVAL))
    scans = [line for line in plan.split("\n") if "documents.parquet" in line]
    assert len(scans) == 1 and "ReadSchema: struct<lang:string>" in scans[0]


def test_texts_are_cleaned_once(spark):
    plan = plan_of(entry_points.queries()["match_employee_many"](spark, FOLDER))
    texts = [line for line in plan.split("\n") if "doc_id" in line and "<[^>]+>" in line]
    assert len(texts) == 1


def test_rows_of_a_hot_key_are_reduced_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("id % 3 as k", "id as o", "cast(id as string) as body")
    plan = plan_of(first_per_key(rows, ["k"], ["o"]))
    assert re.search(r"Exchange hashpartitioning.*\n.*partial_min", plan)


def test_stored_sales_are_read_from_two_month_folders(spark, tmp_path, table):
    sales = table("id bigint, employee_id bigint, invoice_ref string, amount decimal(14,2), sale_date date",
                  *[(n, 1, f"i{n}", Decimal(1), date(2024, 1 + n % 12, 5)) for n in range(24)])
    path = str(tmp_path / "sales")
    write_sales(sales, path)
    periods = Periods(date(2024, 6, 1))
    stored = read_sales(spark, path, periods.scan_from, periods.scan_until)
    frame = performance.sales_by_employee_period(stored, periods)
    assert re.search(r"PartitionFilters: \[[^\]]*sale_month", plan_of(frame))
    folders = {re.search(r"sale_month=([\d-]+)", r[0])[1] for r in stored.select("_metadata.file_path").collect()}
    assert folders == {"2024-06-01"}
    assert [r.amount for r in frame.collect() if r.period_type == "monthly"] == [2]


def test_current_periods_are_read_from_their_folders(spark, tmp_path):
    t, path = Tables(spark, FOLDER), str(tmp_path / "performance")
    for day in (date(2000, 5, 31), date(2000, 6, 1)):
        fresh = performance.performance_snapshot(t.sales_lines, t.employees, t.team_leaders, t.targets, Periods(day), BANDS,
                                                 datetime(2000, 6, 1))
        replace_snapshot(spark, fresh, path, Periods(day))
    stored = spark.read.parquet(path)
    board = performance.live_display(stored, t.employees, t.team_leaders, Periods(date(2000, 6, 1)))
    assert re.search(r"PartitionFilters: \[[^\]]*period_date", plan_of(board))
    assert spark_rows(_plain(board)) == spark_rows(entry_points.queries()["live_display"](spark, FOLDER))


def test_skewed_lookups_are_split_at_run_time(spark):
    """Half of the rows point at one parent; the shuffled join splits that partition."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        from tallyloom.operators.integrity import null_children_of
        children = spark.range(0, 400_000, 1, 8).selectExpr("id", "if(id % 2 = 0, 7, id % 1000) as parent_id", "uuid() as pad")
        parents = spark.range(0, 1000).filter("id % 2 = 1")
        frame = null_children_of(children, parents, "parent_id")
        assert frame.filter("parent_id is null").count() == 400_000
        assert "skew=true" in final_plan_of(frame.select("id", "parent_id", "pad"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
