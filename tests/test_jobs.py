from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.functions.bands import bands_from_json, status_label
from tallyloom.functions.register import register_functions
from tallyloom.functions.text import normalize_text
from tallyloom.jobs import Warehouse, assign_sales, live_board, load_sales, move_sales, recompute_performance, store_dimension
from tallyloom.plans import maintenance, review
from tallyloom.sources.samples import BANDS_JSON
from tallyloom.sources.sinks import write_sales
from tests.test_text import GOLDEN

DAY = date(2024, 2, 29)
AT = datetime(2024, 2, 29, 9)


@pytest.fixture
def store(spark, tmp_path):
    def save(name, *rows):
        spark.createDataFrame(list(rows), getattr(schemas, name.upper())).write.parquet(f"{tmp_path}/{name}")

    save("employees", (1, "A", None, None, 10, True, True, None), (2, "B", None, None, 10, True, True, None))
    save("team_leaders", (10, "L", None, True))
    save("targets", (1, "employee", 1, None, "monthly", D(100), None))
    save("settings", ("system", '{"status_thresholds":' + BANDS_JSON + "}", None, None))
    write_sales(spark.createDataFrame(
        [(1, 1, "i1", D(90), DAY, None, None), (2, None, "i2", D(20), DAY, None, None),
         (3, 1, "i3", D(7), date(2024, 1, 31), None, None)], schemas.SALES), f"{tmp_path}/sales")
    return Warehouse(spark, str(tmp_path))


def test_recompute_then_assign(spark, store, table, rows):
    assert recompute_performance(store, DAY, "r1") == 9
    assert rows(live_board(store, DAY).filter("employee_id = 1"), "monthly_pct", "status") == [(D("90.00"), "very good")]
    assigned = table("sale_id bigint, employee_id bigint, assigned_at timestamp", (2, 2, AT), (2, 1, datetime(2024, 2, 29, 10)))
    assert recompute_performance(store, DAY, "r2", assignments=assigned, triggered_by="manual") == 9
    assert rows(live_board(store, DAY).filter("employee_id = 1"), "monthly_pct", "status") == [(D("110.00"), "excellent")]
    assert store.read("performance").count() == 9
    assert rows(spark.read.parquet(store.path("run_log")), "run_id", "status", "records_synced", "triggered_by") == [
        ("r1", "success", 9, "auto"), ("r2", "success", 9, "manual")]


def test_a_failed_run_is_logged(spark, store, rows):
    broken = Warehouse(spark, store.root + "/nowhere")
    with pytest.raises(Exception):
        recompute_performance(broken, DAY, "bad")
    log = spark.read.parquet(broken.path("run_log")).first()
    assert (log.run_id, log.status, log.records_synced) == ("bad", "error", 0) and "PATH_NOT_FOUND" in log.message


def test_employee_changes(table, rows):
    base = table("id bigint, full_name string, employee_code string, external_ref string, team_leader_id bigint, "
                 "show_in_display boolean, is_active boolean, updated_at timestamp",
                 (1, "a", "c1", "r1", 5, True, True, None))
    changes = table("id bigint, full_name string, employee_code string, external_ref string, team_leader_id bigint, "
                    "is_active boolean, seq int",
                    (1, "A ", "", " ", None, None, 1), (None, "new", None, "", 5, False, 2), (3, "lost", None, None, None, None, 3),
                    (1, "  ", None, None, None, None, 4))
    after, rejected = maintenance.upsert_employees(base, changes, order="seq", new_id=F.lit(50), changed_at=AT)
    assert rows(after) == [(1, "A ", None, " ", None, True, True, AT), (50, "new", None, None, 5, True, False, AT)]
    assert rows(rejected, "id", "reason") == [(1, "missing name"), (3, "unknown id")]


def test_leader_changes(table, rows):
    base = table("id bigint, full_name string, user_id bigint, is_active boolean", (1, "a", 7, True))
    changes = table("id bigint, full_name string, user_id bigint, seq int", (1, "b", None, 1), (None, None, 1, 2))
    after, rejected = maintenance.upsert_team_leaders(base, changes, order="seq", new_id=F.lit(50))
    assert rows(after) == [(1, "b", None, True)]
    assert rows(rejected, "reason") == [("missing name",)]


def test_keyword_changes(table, rows):
    base = table("id bigint, phrase string, label string, is_active boolean", (1, "a", "l", True))
    changes = table("id bigint, phrase string, label string, is_active boolean, seq int",
                    (1, " b ", " ", False, 1), (None, "c", "m", None, 2), (None, " ", "m", True, 3))
    after, rejected = maintenance.upsert_keywords(base, changes, order="seq", new_id=F.lit(50))
    assert rows(after) == [(1, "b", "ملاحظة جودة", False), (50, "c", "m", True)]
    assert rows(rejected, "seq", "reason") == [(3, "missing phrase")]


def test_target_changes(table, rows):
    schema = ("id bigint, scope string, employee_id bigint, team_leader_id bigint, period_type string, "
              "target_amount decimal(14,2)")
    stored = table(schema, (1, "employee", 1, None, "daily", D(5)), (2, "employee", 1, None, "daily", D(6)))
    changes = table(schema, (8, "employee", 1, None, "daily", D(7)), (9, "employee", 2, None, "hourly", D(7)))
    after, rejected = maintenance.set_targets(stored, changes)
    assert rows(after, "id") == [(8,)]
    assert rows(rejected, "id", "reason") == [(9, "bad period")]


def test_sql_functions_equal_the_columns(spark, table, rows):
    bands = bands_from_json(BANDS_JSON)
    register_functions(spark, bands)
    texts = table("text string", *[(text,) for text, _ in GOLDEN])
    assert rows(texts.selectExpr("normalize_text(text)")) == rows(texts.select(normalize_text(F.col("text"))))
    numbers = table("p decimal(21,2)", *[(D(n),) for n in (-1, 0, 50, 84, 85, 100)], (None,))
    assert rows(numbers.selectExpr("status_label(p)")) == rows(numbers.select(status_label(F.col("p"), bands)))
    register_functions(spark, [])
    assert rows(numbers.selectExpr("status_label(p)").distinct()) == [("—",)]


def test_loading_sales_twice_adds_nothing(spark, store, rows):
    arrived = spark.createDataFrame(
        [(8, 1, "i1", D(1), DAY, None, None), (9, 2, "i9", D(2), DAY, None, None)], schemas.SALES)
    assert [load_sales(store, arrived, ["id"], run) for run in ("l1", "l2")] == [1, 0]
    assert rows(store.read("sales"), "invoice_ref") == [("i1",), ("i2",), ("i3",), ("i9",)]


def test_an_assignment_outlives_recomputes_and_is_audited(spark, table, tmp_path):
    store = Warehouse(spark, str(tmp_path))
    assign_sales(store, table("sale_id bigint, employee_id bigint", (1, 5), (2, None)), user_id=9, user_name="u", role="admin")
    assign_sales(store, table("sale_id bigint, employee_id bigint", (1, 6)), user_id=9, user_name="u", role="admin")
    sales = table("id bigint, employee_id bigint", (1, None), (2, 3), (3, 4))
    kept = review.with_assignments(sales, store.read("assignments"), "assigned_at")
    assert sorted((r.id, r.employee_id) for r in kept.collect()) == [(1, 6), (2, None), (3, 4)]
    audit = store.read("audit_log").collect()
    assert sorted((a.entity_id, a.details) for a in audit) == [(1, '{"employee_id":5}'), (1, '{"employee_id":6}'), (2, '{"employee_id":null}')]


def test_dimensions_are_stored_with_an_audit_row(spark, table, tmp_path):
    store = Warehouse(spark, str(tmp_path))
    rule = "id bigint, phrase string, label string, is_active boolean"
    for rows in ([(1, "a", "l", True)], [(1, "b", "l", True), (2, "c", "l", False)]):
        store_dimension(store, "keywords", table(rule, *rows), user_id=1, user_name="u", role="admin", action="upsert")
    changed = store.read("keywords").filter("id = 2")
    store_dimension(store, "keywords", changed, user_id=1, user_name="u", role="admin", action="delete")
    assert [r.id for r in store.read("keywords").collect()] == [2]
    assert [a.entity_type for a in store.read("audit_log").collect()] == ["keywords"] * 3


def test_a_load_that_died_is_repaired_from_the_sales(spark, store, table, monkeypatch):
    from tallyloom.sources import idtable

    columns = "id bigint, employee_id bigint, invoice_ref string, amount decimal(14,2), sale_date date, raw string, synced_at timestamp"
    arrived = table(columns, (901, 1, "r1", D(5), date(2024, 1, 3), None, None), (902, 1, "r2", D(6), date(2024, 2, 3), None, None))
    with monkeypatch.context() as patched:
        patched.setattr(idtable.IdTable, "add", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            load_sales(store, arrived, ["id"], "first")
    assert load_sales(store, arrived, ["id"], "again") == 0
    more = arrived.unionByName(table(columns, (903, 1, "r3", D(7), date(2024, 2, 3), None, None)))
    assert load_sales(store, more, ["id"], "more") == 1


def test_moved_sales_change_past_periods_as_a_recompute_would(spark, store, table):
    """Sale 3 is of a past month; moving it there and back, and clearing it, equals recomputes of all its days."""
    key = ["scope", "employee_id", "team_leader_id", "period_type", "period_date"]

    def snapshot():
        return {tuple(r[c] for c in key): (r.achieved_amount, r.percentage, r.status) for r in store.read("performance").collect()}

    for day in (date(2024, 1, 31), DAY):
        recompute_performance(store, day, f"first-{day}")
    for number, employee in enumerate((2, None, 1, 1)):
        written = move_sales(store, table("sale_id bigint, employee_id bigint", (3, employee)), f"move-{number}", user_id=1, user_name="u", role="admin")
        assert written == (0, 0, 6, 0)[number] or written > 0
        moved = snapshot()
        recompute_performance(store, date(2024, 1, 31), f"all-{number}")
        assert {k: v for k, v in moved.items() if v[0]} == {k: v for k, v in snapshot().items() if v[0]}
        own = moved[("employee", 2, None, "monthly", date(2024, 1, 1))]
        assert own[0] == (D("7.00") if employee == 2 else 0)
    assert written == 0


def test_deleting_an_employee_takes_sales_targets_and_snapshots_along(spark, store, table):
    from tallyloom.jobs import delete_from

    for day in (date(2024, 1, 31), DAY):
        recompute_performance(store, day, f"r-{day}")
    changed = delete_from(store, "employees", table("id bigint", (1,), (77,)), user_id=1, user_name="u", role="admin")
    assert changed == ["employees", "performance", "sales", "targets"]
    assert [r.id for r in store.read("employees").collect()] == [2]
    assert [r.id for r in store.read("targets").collect()] == []
    assert [r.id for r in store.read("sales").collect()] == [2]  # the unmatched one; the month of sale 3 is empty now
    left = store.read("performance").collect()
    assert left and {(r.employee_id, r.team_leader_id) for r in left} == {(2, None), (None, 10)}
    changed = delete_from(store, "team_leaders", table("id bigint", (10,)), user_id=1, user_name="u", role="admin")
    assert "employees" in changed and [(r.id, r.team_leader_id) for r in store.read("employees").collect()] == [(2, None)]
    assert {(r.employee_id, r.team_leader_id) for r in store.read("performance").collect()} == {(2, None)}


def test_a_change_that_died_is_put_in_place_later(spark, store, table, monkeypatch):
    from tallyloom import jobs

    rule = "id bigint, phrase string, label string, is_active boolean"
    who = {"user_id": 1, "user_name": "u", "role": "admin", "action": "upsert"}
    jobs.store_tables(store, {"keywords": table(rule, (1, "a", "l", True))}, **who)
    people = store.read("employees").filter("id = 1")
    with monkeypatch.context() as patched:
        patched.setattr(jobs, "_put_in_place", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            jobs.store_tables(store, {"keywords": table(rule, (2, "b", "l", True)), "employees": people}, **who)
    assert [r.id for r in store.read("keywords").collect()] == [1]
    jobs.finish_changes(store)
    assert [r.id for r in store.read("keywords").collect()] == [2] and [r.id for r in store.read("employees").collect()] == [1]
    jobs.finish_changes(store)
    assert [r.id for r in store.read("keywords").collect()] == [2]
