from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.bands import (
    Band,
    bands_from_json,
    default_bands,
    load_bands,
    percentage_of_target,
    status_label,
    status_of_ratio,
)
from tallyloom.functions.periods import Periods, period_columns
from tallyloom.plans import performance
from tallyloom.sources.samples import BANDS_JSON
from tallyloom.sources.sinks import replace_snapshot

BANDS = bands_from_json(BANDS_JSON)
PERIODS = Periods(date(2024, 2, 29))
SALES = "employee_id bigint, amount decimal(14,2), sale_date date"
EMPLOYEES = "id bigint, full_name string, team_leader_id bigint, show_in_display boolean, is_active boolean"
LEADERS = "id bigint, full_name string, is_active boolean"
TARGETS = ("id bigint, scope string, employee_id bigint, team_leader_id bigint, period_type string, "
           "target_amount decimal(14,2)")


@pytest.fixture
def people(table):
    employees = table(EMPLOYEES, (1, "A", 10, True, True), (2, "B", 10, True, False), (3, "C", None, False, True))
    leaders = table(LEADERS, (10, "L", True), (11, "M", False))
    return employees, leaders


@pytest.fixture
def sales(table):
    return table(
        SALES, (1, D("29998.80"), date(2024, 2, 29)), (1, D(5), date(2024, 2, 1)), (1, D(7), date(2024, 3, 1)),
        (1, D(11), date(2024, 2, 26)), (2, D(1000), date(2024, 2, 29)), (None, D(500), date(2024, 2, 29)))


def _by_period(frame, owner, key):
    return {r.period_type: r for r in frame.filter(F.col(owner) == key).collect()}


def test_periods_across_month_ends():
    assert [(p.kind, p.start, p.end) for p in PERIODS.all] == [
        ("daily", date(2024, 2, 29), date(2024, 3, 1)), ("weekly", date(2024, 2, 26), date(2024, 3, 4)),
        ("monthly", date(2024, 2, 1), date(2024, 3, 1))]
    first = Periods(date(2000, 6, 1))
    assert (first.scan_from, first.scan_until) == (date(2000, 5, 29), date(2000, 7, 1))
    assert Periods(date(2023, 12, 31)).all[2].end == date(2024, 1, 1)


@pytest.mark.parametrize("day", [date(2000, 2, 29), date(2000, 12, 31), date(2024, 1, 1), date(2024, 3, 3)])
def test_column_and_literal_periods_agree(table, day):
    row = table("d date", (day,)).select(*period_columns(F.col("d"))).first()
    assert [v for p in Periods(day).all for v in (p.start, p.end)] == list(row)


def test_band_is_taken_from_the_unrounded_percentage(sales, people, table):
    employees, _ = people
    targets = table(TARGETS, (1, "employee", 1, None, "daily", D(30000)), (2, "employee", 1, None, "weekly", D(0)))
    found = _by_period(performance.employee_performance(sales, employees, targets, PERIODS, BANDS), "employee_id", 1)
    assert (found["daily"].percentage, found["daily"].status) == (D("100.00"), "very good")
    assert (found["weekly"].percentage, found["weekly"].status) == (D("0.00"), "weak")
    assert (found["weekly"].achieved_amount, found["weekly"].target_amount) == (D("30016.80"), D(0))
    assert (found["monthly"].achieved_amount, found["monthly"].percentage) == (D("30014.80"), D("0.00"))


def test_inactive_employees_count_for_their_leader_only(sales, people, table):
    employees, leaders = people
    snapshot = performance.performance_snapshot(sales, employees, leaders, table(TARGETS), PERIODS, BANDS)
    assert {(r.scope, r.employee_id, r.team_leader_id) for r in snapshot.collect()} == {
        ("employee", 1, None), ("employee", 3, None), ("team_leader", None, 10)}
    assert _by_period(snapshot, "team_leader_id", 10)["daily"].achieved_amount == D("30998.80")


def test_single_scopes_equal_the_snapshot(sales, people, table, rows):
    employees, leaders = people
    targets = table(TARGETS, (1, "employee", 1, None, "daily", D(10)), (2, "team_leader", None, 10, "monthly", D(20)))
    both = performance.employee_performance(sales, employees, targets, PERIODS, BANDS).unionByName(
        performance.leader_performance(sales, employees, leaders, targets, PERIODS, BANDS))
    assert rows(both) == rows(performance.performance_snapshot(sales, employees, leaders, targets, PERIODS, BANDS))


def test_of_two_targets_the_last_set_counts(sales, people, table):
    employees, _ = people
    targets = table(TARGETS, (5, "employee", 1, 10, "daily", D(50)), (9, "employee", 1, None, "daily", D(70)),
                    (7, "employee", 1, 11, "daily", D(60)))
    found = performance.employee_performance(sales, employees, targets, PERIODS, BANDS)
    assert found.count() == 6
    assert _by_period(found, "employee_id", 1)["daily"].target_amount == D(70)


def test_upsert_keeps_one_row_per_key(sales, people, table, rows):
    employees, leaders = people
    snapshot = performance.performance_snapshot(sales, employees, leaders, table(TARGETS), PERIODS, BANDS)
    again = performance.upsert_snapshot(performance.upsert_snapshot(snapshot, snapshot), snapshot)
    assert rows(again) == rows(snapshot)


def test_stored_snapshot_is_replaced_and_other_periods_stay(spark, sales, people, table, tmp_path):
    employees, leaders = people
    path = str(tmp_path / "performance")
    for day, at in ((date(2024, 2, 28), 1), (date(2024, 2, 29), 2), (date(2024, 2, 29), 3)):
        periods = Periods(day)
        fresh = performance.performance_snapshot(sales, employees, leaders, table(TARGETS), periods, BANDS,
                                                 datetime(2024, 2, 29, at))
        replace_snapshot(spark, fresh, path, periods)
    stored = spark.read.parquet(path)
    counts = {(r.period_type, str(r.period_date)): r["count"]
              for r in stored.groupBy("period_type", "period_date").count().collect()}
    assert counts == {("daily", "2024-02-28"): 3, ("daily", "2024-02-29"): 3, ("weekly", "2024-02-26"): 3,
                      ("monthly", "2024-02-01"): 3}
    assert stored.filter("period_type = 'weekly'").select(F.min("computed_at")).first()[0] == datetime(2024, 2, 29, 3)


def test_live_display_shows_current_periods_of_visible_people(people, table):
    employees, leaders = people
    log = table("scope string, employee_id bigint, team_leader_id bigint, period_type string, period_date date, "
                "percentage decimal(21,2), status string",
                ("employee", 1, None, "daily", date(2024, 2, 29), D(10), "x"),
                ("employee", 1, None, "daily", date(2024, 2, 28), D(99), "x"),
                ("employee", 1, None, "monthly", date(2024, 2, 1), D(30), "good"),
                ("team_leader", None, 1, "weekly", date(2024, 2, 26), D(77), "x"))
    board = performance.live_display(log, employees, leaders, PERIODS).collect()
    assert [tuple(r) for r in board] == [(1, "A", "L", D(10), None, D(30), "good")]


@pytest.mark.parametrize("percentage, label", [
    (D(100), "excellent"), (D("99.99"), "very good"), (D(85), "very good"), (D(0), "weak"), (D(-1), "—"), (None, "—")])
def test_status_label(table, percentage, label):
    assert table("p decimal(9,2)", (percentage,)).select(status_label(F.col("p"), BANDS)).first()[0] == label


def test_bands_of_settings(table):
    settings = table("key string, value string", ("system", '{"status_thresholds":' + BANDS_JSON + "}"), ("other", "{}"))
    assert load_bands(settings) == BANDS
    assert load_bands(settings, "other") == [] == load_bands(settings, "missing")
    assert table("p int", (50,)).select(status_label(F.col("p"), [])).first()[0] == "—"
    assert [b.min_pct for b in default_bands()] == [100, 85, 70, 50, 0]


@pytest.mark.parametrize("achieved, target, expected", [
    ("1", "3", "33.33"), ("2", "3", "66.67"), ("0.01", "9999999999.99", "0.00"), ("-1", "3", "-33.33"),
    ("-0.5", "100", "-0.50"), ("10000049.99", "99999999.99", "10.00"), ("5", "0", "0.00"), ("12345678901.23", "0.01", "123456789012300.00"),
    ("1.005", "100", "1.01")])
def test_percentage_is_exact(table, achieved, target, expected):
    frame = table("a decimal(24,2), t decimal(14,2)", (D(achieved).quantize(D("0.01"), rounding="ROUND_HALF_UP"), D(target)))
    assert frame.select(percentage_of_target(F.col("a"), F.col("t"))).first()[0] == D(expected)


def test_ratio_band_has_no_rounding(table):
    bands = [Band("top", D(100)), Band("rest", D(0))]
    frame = table("a decimal(24,2), t decimal(14,2)", (D("999999999999.98"), D("999999999999.99")))
    assert frame.select(status_of_ratio(F.col("a"), F.col("t"), bands)).first()[0] == "rest"


def test_percentages_never_wrap(table):
    money = "achieved decimal(24,2), target decimal(14,2)"
    cases = [(D("10000000000000.00"), D("0.01")), (D("9" * 22 + ".99"), D("0.01")), (D("-10000000000000.00"), D("0.01")),
             (D("0.01"), D("999999999999.99")), (D("29998.80"), D("30000.00")), (D("-0.005"), D("1.00"))]
    got = [r.p for r in table("n int, " + money, *((n, a, t) for n, (a, t) in enumerate(cases))).orderBy("n").select(
        percentage_of_target(F.col("achieved"), F.col("target")).alias("p")).collect()]
    assert got[0] == D("100000000000000000.00") and got[2] == -got[0]
    assert got[1] is None and got[3] == D("0.00") and got[4] == D("100.00")
