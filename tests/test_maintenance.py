from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyloom.operators import access, integrity, keyed
from tallyloom.plans import quality, review, roster
from tallyloom.plans.deletion import delete_rows
from tallyloom.sources.sinks import default_keywords, log_audit, log_run, seed_rows

TARGETS = ("id bigint, scope string, employee_id bigint, team_leader_id bigint, period_type string, "
           "target_amount decimal(14,2)")
EMPLOYEES = "id bigint, full_name string, team_leader_id bigint, is_active boolean"
NOTES = ("id bigint, employee_id bigint, customer_name string, message_text string, message_at timestamp, "
         "label string, phrase string")
DAY = datetime(2024, 1, 20, 12)


def test_targets_are_replaced_on_equal_nulls(table, rows):
    stored = table(TARGETS, (1, "employee", 1, None, "daily", D(5)), (2, "employee", 1, 3, "daily", D(6)),
                   (3, "team_leader", None, 3, "daily", D(7)))
    changes = table(TARGETS, (8, "employee", 1, None, "daily", D(50)), (9, "employee", 1, None, "daily", D(51)),
                    (10, "team_leader", None, 4, "daily", D(8)))
    keys = ["scope", "employee_id", "team_leader_id", "period_type"]
    once = keyed.replace_on_key(stored, keyed.last_per_key(changes, keys, ["id"]), keys)
    assert [r[0] for r in rows(once, "id")] == [10, 2, 3, 9]
    assert rows(keyed.replace_on_key(once, keyed.last_per_key(changes, keys, ["id"]), keys)) == rows(once)


def test_upsert(table, rows):
    base = table("id bigint, full_name string, code string, updated_at timestamp", (1, "a", "x", None), (2, "b", "y", None))
    changes = table("id bigint, full_name string, seq int", (1, "first", 1), (1, None, 2), (7, "lost", 3), (None, "new", 4))
    found, rejected = keyed.upsert_rows(base, changes, order="seq", new_id=F.lit(100), stamp=F.lit(DAY))
    assert rows(found, "id", "full_name", "code", "updated_at") == [
        (1, None, "x", DAY), (100, "new", None, DAY), (2, "b", "y", None)]
    assert rows(rejected) == [(7, "lost", 3, "unknown id")]


def test_seeds_are_added_once(spark, rows):
    seeds = default_keywords(spark)
    stored = seed_rows(seeds.limit(0), seeds, ["phrase", "label"])
    assert stored.count() == 5 == seed_rows(stored, seeds, ["phrase", "label"]).count()


def test_invoices(table, rows):
    sales = table("id bigint, invoice_ref string, at int", (1, "a", 2), (2, "a", 1), (3, None, 1), (4, None, 1))
    assert rows(review.distinct_invoices(sales, ["at"]), "id") == [(2,), (3,), (4,)]


def test_assignments(table, rows):
    sales = table("id bigint, employee_id bigint, amount int", (1, None, 5), (2, 8, 5), (3, 8, 5), (4, None, 5))
    changes = table("sale_id bigint, employee_id bigint, seq int", (1, 7, 1), (2, 7, 1), (2, None, 2), (99, 7, 1), (None, 7, 1))
    assert rows(review.with_assignments(sales, changes, "seq")) == [(1, 7, 5), (2, None, 5), (3, 8, 5), (4, None, 5)]


def test_review_queue(table, rows):
    sales = table("id bigint, employee_id bigint, amount int, sale_date date, raw string",
                  *[(n, None if n % 2 else n, 1, date(2024, 1, 1 + n // 2), '{"notes":"n"}') for n in range(10)])
    found = review.unmatched_sales(sales, limit=3).collect()
    assert [(r.id, r.reference, r.notes) for r in found] == [(9, None, "n"), (7, None, "n"), (5, None, "n")]
    assert review.unmatched_count(sales).first()[0] == 5


def test_cascade_and_set_null(table, rows):
    customers = table("id bigint", (1,), (2,))
    messages = table("id bigint, customer_id bigint", (10, 1), (20, 2), (30, None))
    notes = table("id bigint, message_id bigint", (100, 10), (101, 10), (200, 20), (300, None))
    gone = customers.filter("id = 1")
    gone_messages = integrity.children_of(messages, gone, "customer_id")
    assert rows(integrity.without_children_of(messages, gone, "customer_id"), "id") == [(20,), (30,)]
    kept = integrity.without_children_of(notes, gone_messages, "message_id")
    assert rows(kept, "id") == [(200,), (300,)]
    assert integrity.orphan_keys(kept, messages.filter("id <> 10"), "message_id").count() == 0
    assert rows(integrity.null_children_of(messages, gone, "customer_id")) == [(10, None), (20, 2), (30, None)]
    assert rows(integrity.orphan_keys(notes, messages.filter("id <> 10"), "message_id")) == [(10, 2)]


def test_checks(table, rows):
    checked = integrity.check_targets(table(
        TARGETS, (1, "employee", 1, None, "daily", D(0)), (2, "office", None, None, "yearly", D(-1)),
        (3, "team_leader", 1, None, "daily", None), (4, None, None, None, None, D(1))))
    valid, rejected = integrity.split_by_reasons(checked)
    assert rows(valid, "id") == [(1,)]
    assert {r.id: r.reasons for r in rejected.collect()} == {
        2: ["bad scope", "bad period", "bad amount"], 3: ["bad amount", "missing owner"], 4: ["bad scope", "bad period"]}
    keywords = integrity.check_keywords(table("phrase string", ("  ",), ("<b>",), ("ok",), (None,)))
    assert [r.reasons for r in keywords.collect()] == [["missing phrase"], ["matches nothing"], [], ["missing phrase"]]
    users = integrity.check_users(table("username string, full_name string, role string", ("a", "A", "admin"), ("", None, "boss")))
    assert [r.reasons for r in users.collect()] == [[], ["missing username", "missing name", "bad role"]]
    settings = integrity.check_settings(table("value string", ("{}",), ("[1]",), ("x",), (None,), (' {"a":{"b":1}}',)))
    assert [len(r.reasons) for r in settings.collect()] == [0, 1, 1, 1, 0]
    logs = integrity.check_performance(table("scope string, period_type string, percentage decimal(21,2)",
                                             ("employee", "daily", D("9999.99")), ("employee", "daily", D(-10000))))
    assert [r.reasons for r in logs.collect()] == [[], ["percentage over 9999.99"]]


def test_same_names(table, rows):
    frame = table("n string", ("Ann",), ("aNN ",), ("Bob",), (None,), (None,))
    assert rows(integrity.same_ignoring_case(frame, "n")) == [("ann", 2)]


def test_scopes(table, rows):
    leaders = table("id bigint, user_id bigint", (3, 102), (2, 102), (4, None))
    employees = table(EMPLOYEES, (1, "a", 2, True), (5, "b", 3, True), (6, "c", None, True))
    targets = table(TARGETS, (1, "employee", 1, None, "daily", D(1)), (2, "employee", 5, None, "daily", D(1)),
                    (3, "team_leader", None, 2, "daily", D(1)), (4, "employee", 1, 2, "daily", D(1)))
    own, none = access.leader_of_user(leaders, 102), access.leader_of_user(leaders, 999)
    assert rows(own) == [(2,)] and rows(none) == [(None,)]
    assert rows(access.own_rows(employees, "team_leader", own, "team_leader_id"), "id") == [(1,)]
    assert access.own_rows(employees, "team_leader", none, "team_leader_id").count() == 0
    assert access.own_rows(employees, "manager", none, "team_leader_id").count() == 3
    assert rows(access.own_team_rows(targets, "team_leader", own, employees), "id") == [(1,), (3,), (4,)]
    assert access.own_team_rows(targets, "team_leader", none, employees).count() == 0
    assert access.own_team_rows(targets, "admin", none, employees).count() == 4


def test_sessions_and_directory(table, rows):
    users = table("id bigint, full_name string, role string, is_active boolean, password string",
                  (1, "a", "admin", True, "s"), (2, "b", "admin", False, "s"))
    sessions = table("session_id bigint, user_id bigint, created_at timestamp", (1, 1, DAY), (2, 2, DAY), (3, 9, DAY))
    live = sessions.withColumn("expires_at", access.session_expiry(F.col("created_at")))
    assert rows(access.active_sessions(live, users, datetime(2024, 1, 27, 11)), "session_id") == [(1,)]
    assert access.active_sessions(live, users, datetime(2024, 1, 27, 12)).count() == 0
    assert access.user_directory(users).columns == ["id", "full_name", "role", "is_active"]
    assert rows(access.active_admins(users)) == [(1, True)]


def test_roster_has_one_shape_at_every_size(table):
    leaders = table("id bigint, full_name string", (1, "L"), (2, "M"))
    employees = table(EMPLOYEES, *[(n, f"e{9999 - n}", 1, True) for n in range(6000)], (99999, "free", None, True))
    found = roster.team_rosters(leaders, employees).collect()
    assert [r.employee_id for r in found] == [*sorted(range(6000), key=lambda n: f"e{9999 - n}"), None]
    assert found[0].member == '{"full_name":"e4000","id":5999,"is_active":true}' and found[-1].member is None


def test_note_filters(table, rows):
    notes = table(NOTES, (1, 1, "Ann", "x ABC", DAY, "l", "p"), (2, None, None, "a%c", DAY, None, "p"),
                  (3, 7, "abc", None, None, "l", "p"), (4, 1, "Bob", "zzz", datetime(2024, 1, 20, 23, 59, 59, 999999), "l", "p"))
    employees = table("id bigint, full_name string", (1, "Emp"), (2, "Emp"))

    def ids(**filters):
        return [r[0] for r in rows(quality.filter_notes(notes, **filters), "id")]

    assert ids() == [1, 2, 3, 4]
    assert ids(employee_id=1) == [1, 4] and ids(label="l") == [1, 3, 4] and ids(search="abc") == [1, 3]
    assert ids(search="a_c") == [1, 2, 3]
    assert ids(date_from=date(2024, 1, 20)) == [1, 2, 4] == ids(date_to=date(2024, 1, 20))
    assert ids(date_to=date(2024, 1, 19)) == []
    page = quality.latest_notes(notes, employees, limit=3).collect()
    assert [(r.id, r.employee_name) for r in sorted(page, key=lambda r: r.id)] == [(1, "Emp"), (2, None), (4, "Emp")]
    assert rows(quality.notes_stats(notes, date(2024, 1, 20))) == [(4, 3)]
    assert rows(quality.quality_by_employee(notes, employees)) == [("Emp", 2), ("غير محدد", 2)]
    assert rows(quality.quality_by_label(notes)) == [("-", 1), ("l", 3)]
    assert quality.label_counts_map(notes).first()[0] == '{"-":1,"l":3}'


def test_logs(spark, tmp_path, rows):
    path = str(tmp_path / "runs")
    for n in range(2):
        log_run(spark, path, run_id=f"r{n}", started_at=DAY, finished_at=DAY, status="success", records=n)
    assert rows(spark.read.parquet(path), "run_id", "records_synced") == [("r0", 0), ("r1", 1)]
    path = str(tmp_path / "audit")
    log_audit(spark, path, user_id=1, user_name="a", role="admin", action="assign_sale", logged_at=DAY)
    assert spark.read.parquet(path).first().action == "assign_sale"


def test_delete_with_dependants(table, rows):
    tables = {
        "team_leaders": table("id bigint, user_id bigint", (1, 7), (2, None)),
        "employees": table("id bigint, team_leader_id bigint", (10, 1), (11, 2)),
        "targets": table("id bigint, employee_id bigint, team_leader_id bigint", (1, 10, None), (2, None, 1), (3, 11, None)),
        "sales": table("id bigint, employee_id bigint", (1, 10), (2, 11), (3, None)),
        "customers": table("id bigint", (5,), (6,)),
        "messages": table("message_id bigint, customer_id bigint, employee_id bigint", (1, 5, 10), (2, 6, 10), (3, 6, 11)),
        "notes": table("id bigint, message_id bigint, customer_id bigint, employee_id bigint, label string",
                       (1, 1, 5, 10, "a"), (2, 2, 6, 10, "b"), (3, None, 5, None, "c")),
    }
    left = delete_rows(tables, "employees", tables["employees"].filter("id = 10"))
    assert rows(left["employees"], "id") == [(11,)]
    assert rows(left["targets"], "id") == [(2,), (3,)] and rows(left["sales"], "id") == [(2,), (3,)]
    assert rows(left["messages"]) == [(1, 5, None), (2, 6, None), (3, 6, 11)]
    assert rows(left["notes"], "id", "employee_id", "label") == [(1, None, "a"), (2, None, "b"), (3, None, "c")]

    left = delete_rows(tables, "team_leaders", tables["team_leaders"].filter("id = 1"))
    assert rows(left["employees"]) == [(10, None), (11, 2)] and rows(left["targets"], "id") == [(1,), (3,)]

    left = delete_rows(tables, "customers", tables["customers"].filter("id = 5"))
    assert rows(left["messages"], "message_id") == [(2,), (3,)]
    assert rows(left["notes"]) == [(2, 2, 6, 10, "b"), (3, None, None, None, "c")]


def test_only_new_invoices_pass(table, rows):
    stored = table("invoice_ref string", ("a",), (None,))
    arrived = table("id bigint, invoice_ref string, at int", (1, "a", 1), (2, "b", 2), (3, "b", 1), (4, None, 1), (5, None, 1))
    assert rows(review.new_sales(arrived, stored, ["at"]), "id") == [(3,), (4,), (5,)]
