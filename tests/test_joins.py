"""As-of join, interval join, hourly counts, prefix sums and deltas on random and odd rows, against plain Python."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.bands import bands_from_json
from tallyloom.operators.asof import asof_join
from tallyloom.operators.intervals import alive_per_hour, overlapping_pairs
from tallyloom.plans import calendar, deltas
from tallyloom.sources.samples import BANDS_JSON

START = datetime(2024, 1, 1)
BANDS = bands_from_json(BANDS_JSON)
SALES = "id bigint, employee_id bigint, amount decimal(14,2), sale_date date"
PEOPLE = "id bigint, team_leader_id bigint, is_active boolean"
TARGETS = "id bigint, scope string, employee_id bigint, team_leader_id bigint, period_type string, target_amount decimal(14,2)"


def test_asof_takes_the_nearest_lower_step(table):
    dice = random.Random(4)
    steps = [(dice.choice(["a", "b", "c", None]), dice.choice([None, *range(0, 50, 7)]), f"s{n}") for n in range(40)]
    values = [(n, dice.choice(["a", "a", "b", "x", None]), dice.choice([None, *range(-5, 60)])) for n in range(300)]
    values += [values[0], (None, "a", 7)]
    found = asof_join(table("id bigint, key string, v int", *values), table("key string, at int, label string", *steps), ["key"], "v", "at", ["label"], parts=3)

    def expected(key, v):
        below = [(at, label) for k, at, label in steps if k is not None and k == key and at is not None and v is not None and at <= v]
        top = max((at for at, _ in below), default=None)
        return min((label for at, label in below if at == top), default=None)

    assert Counter(tuple(r) for r in found.collect()) == Counter((n, k, v, expected(k, v)) for n, k, v in values)


def test_a_hot_key_is_dealt_to_several_groups(spark, table):
    values = spark.range(20_000).selectExpr("id", "'team' as key", "cast(id % 100 as int) as v")
    found = asof_join(values, table("key string, at int, label string", ("team", 10, "low"), ("team", 50, "high")), ["key"], "v", "at", ["label"], parts=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "_part" in plan[plan.index("hashpartitioning(key"):][:80]
    assert found.groupBy("label").count().orderBy("label").collect() == [(None, 2000), ("high", 10_000), ("low", 8000)]


def some_intervals(seed):
    dice = random.Random(seed)
    rows = []
    for n in range(120):
        start = START + timedelta(minutes=dice.randrange(0, 60 * 24 * 20))
        length = dice.choice([0, 1, 59, 60, 61, 1440, 1440 * 7, 1440 * 40, -5])
        rows.append((n, dice.choice([1, 1, 2, None]), start, start + timedelta(minutes=length)))
    return rows + [(500, 1, START, None), (501, 1, None, START), (502, 2, START, START + timedelta(days=31)), (503, 2, START + timedelta(hours=24), START + timedelta(hours=48))]


@pytest.mark.parametrize("bucket_seconds", [3600, 86400 * 7, 86400 * 400])
def test_each_overlapping_pair_once(table, bucket_seconds):
    rows = some_intervals(bucket_seconds % 97)
    found = overlapping_pairs(table("id bigint, who bigint, s timestamp, e timestamp", *rows), "id", "who", "s", "e", bucket_seconds)
    real = [r for r in rows if r[1] is not None and r[2] and r[3] and r[2] < r[3]]
    expected = [(a[1], a[0], b[0]) for a in real for b in real if a[0] < b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3]]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_alive_in_each_hour(table):
    rows = some_intervals(8)
    found = {r.hour: r.n_alive for r in alive_per_hour(table("id bigint, who bigint, s timestamp, e timestamp", *rows), "s", "e").collect()}
    real = [r for r in rows if r[2] and r[3] and r[2] < r[3]]
    expected = {}
    hour = START - timedelta(days=1)
    while hour < START + timedelta(days=80):
        alive = sum(s < hour + timedelta(hours=1) and e > hour for _, _, s, e in real)
        if alive:
            expected[hour] = alive
        hour += timedelta(hours=1)
    assert found == expected
    assert alive_per_hour(table("s timestamp, e timestamp"), "s", "e").collect() == []


def some_sales(seed, n=200):
    dice = random.Random(seed)
    return [(k, dice.choice([1, 1, 2, 3, 9, None]), Decimal(dice.randrange(-500, 5000)) / 100, date(2023, 12, 20) + timedelta(days=dice.randrange(80)))
            for k in range(n)]


def ranges(day):
    week = day - timedelta(days=day.weekday())
    month = day.replace(day=1)
    return {"daily": (day, day + timedelta(days=1)), "weekly": (week, week + timedelta(days=7)), "monthly": (month, (month + timedelta(days=31)).replace(day=1))}


def test_calendar_equals_sums_over_ranges(table):
    sales, people = some_sales(1), [(1, 10, True), (2, 10, False), (3, None, True)]
    found = calendar.performance_calendar(table(SALES, *sales), table(PEOPLE, *people), date(2023, 12, 31), date(2024, 2, 10)).collect()
    teams = {e: t for e, t, _ in people}
    owned = [(("employee", e), a, d) for _, e, a, d in sales if e] + [(("team_leader", teams[e]), a, d) for _, e, a, d in sales if teams.get(e)]
    assert len(found) == len({o for o, *_ in owned}) * 42 * 3
    for row in found:
        start, end = ranges(row.as_of)[row.period_type]
        assert row.period_date == start
        assert row.achieved_amount == sum(a for o, a, d in owned if o == (row.scope, row.owner_id) and start <= d < end)


def test_deltas_equal_a_recompute(table):
    people = table(PEOPLE, (1, 10, True), (2, 10, False), (3, 11, True), (9, None, True))
    leaders = table("id bigint, is_active boolean", (10, True), (11, True))
    targets = table(TARGETS, (1, "employee", 1, None, "monthly", Decimal(30)), (2, "team_leader", None, 10, "weekly", Decimal(20)))
    sales = some_sales(2)
    fresh = [(k + 1000, e, a, d) for k, e, a, d in some_sales(3, 12)]
    moves = [(5, 1, 3), (5, 2, 2), (6, 1, None), (7, 1, sales[7][1]), (77, 1, 1), (None, 1, 1), (4242, 1, 1)]
    signed = deltas.added_sales(table(SALES, *fresh)).unionByName(
        deltas.moved_sales(table(SALES, *sales), table("sale_id bigint, no int, employee_id bigint", *moves), "no"))
    dimensions = (people, leaders, targets, BANDS)
    changed = deltas.performance_delta(deltas.performance_history(table(SALES, *sales), *dimensions), signed, *dimensions)
    last = {5: 2, 6: None, 7: sales[7][1], 77: 1}
    after = [(k, last.get(k, e), a, d) for k, e, a, d in sales] + fresh
    key = ["scope", "employee_id", "team_leader_id", "period_type", "period_date"]
    history = {tuple(r[c] for c in key): r for r in deltas.performance_history(table(SALES, *after), *dimensions).collect()}
    rows = changed.collect()
    assert rows and len({tuple(r[c] for c in key) for r in rows}) == len(rows)
    for row in rows:
        whole = history.get(tuple(row[c] for c in key))
        assert (row.achieved_amount, row.percentage, row.status) == ((whole.achieved_amount, whole.percentage, whole.status) if whole else (0, 0, "weak"))
    touched = {tuple(r[c] for c in key) for r in rows}
    before = {tuple(r[c] for c in key): r.achieved_amount for r in deltas.performance_history(table(SALES, *sales), *dimensions).collect()}
    assert {k for k, r in history.items() if before.get(k) != r.achieved_amount} <= touched
    assert changed.filter(F.col("employee_id") == 2).count() == 0
