"""Sales against targets: achieved amounts, percentages and bands per person, team and period.

The fact table is read once per recompute, bounded to the days the three periods cover, and reduced
to one row per employee (three conditional sums) before it meets any dimension.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.defaults import PERIOD_TYPES, SCOPES
from tallyloom.functions.bands import Band, percentage_of_target, status_of_ratio
from tallyloom.functions.periods import Periods
from tallyloom.operators.keyed import replace_on_key
from tallyloom.schemas import MONEY, TOTAL

SNAPSHOT_KEY = ["scope", "employee_id", "team_leader_id", "period_type", "period_date"]


def period_grid(employees: DataFrame, periods: Periods) -> DataFrame:
    """Every active employee with each current period."""
    return employees.filter("is_active").select(F.col("id").alias("employee_id"), F.inline(periods.rows()))


def _sums_per_employee(sales: DataFrame, periods: Periods) -> DataFrame:
    """One row per employee with sales, one sum per period. Sales without an employee count nowhere."""
    day = F.col("sale_date")
    current = sales.filter(periods.covers(day) & F.col("employee_id").isNotNull())
    return current.groupBy("employee_id").agg(
        *[F.sum(F.when(p.contains(day), F.col("amount"))).cast(TOTAL).alias(p.kind) for p in periods.all])


def _sums_per_leader(sales: DataFrame, employees: DataFrame, periods: Periods) -> DataFrame:
    """Team sums by current leader. Inactive employees count for their team."""
    members = (employees.filter(F.col("team_leader_id").isNotNull())
               .select(F.col("id").alias("employee_id"), "team_leader_id"))
    return (_sums_per_employee(sales, periods).join(members, "employee_id").groupBy("team_leader_id")
            .agg(*[F.sum(p.kind).cast(TOTAL).alias(p.kind) for p in periods.all]))


def _rows_per_period(wide: DataFrame, key: str, periods: Periods) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(p.kind).alias("period_type"), F.lit(p.start).alias("period_date"),
                 F.col(p.kind).alias("amount"))
        for p in periods.all])
    return wide.select(key, F.inline(entries)).filter(F.col("amount").isNotNull())


def sales_by_employee_period(sales: DataFrame, periods: Periods) -> DataFrame:
    return _rows_per_period(_sums_per_employee(sales, periods), "employee_id", periods)


def sales_by_leader_period(sales: DataFrame, employees: DataFrame, periods: Periods) -> DataFrame:
    return _rows_per_period(_sums_per_leader(sales, employees, periods), "team_leader_id", periods)


def _owner() -> Column:
    """The id that the scope of a row points at."""
    return F.when(F.col("scope") == "employee", F.col("employee_id")).when(
        F.col("scope") == "team_leader", F.col("team_leader_id"))


def effective_targets(targets: DataFrame) -> DataFrame:
    """One row per scope and owner with a target per period; of several, the one set last (highest id)."""
    owned = targets.withColumn("owner_id", _owner()).filter(F.col("owner_id").isNotNull())
    return owned.groupBy("scope", "owner_id").agg(*[
        F.max_by("target_amount", F.when(F.col("period_type") == kind, F.col("id"))).alias(f"{kind}_target")
        for kind in PERIOD_TYPES])


def _rated(owners: DataFrame, sums: DataFrame, targets: DataFrame, periods: Periods,
           bands: list[Band]) -> DataFrame:
    """Percentage and band per owner and period. All three inputs meet on (scope, owner_id)."""
    key = ["scope", "owner_id"]
    wide = owners.join(sums, key, "left").join(effective_targets(targets), key, "left")
    entries = F.array(*[
        F.struct(F.lit(p.kind).alias("period_type"), F.lit(p.start).alias("period_date"),
                 F.coalesce(p.kind, F.lit(0).cast(TOTAL)).alias("achieved_amount"),
                 F.coalesce(f"{p.kind}_target", F.lit(0).cast(MONEY)).alias("target_amount"))
        for p in periods.all])
    achieved, target = F.col("achieved_amount"), F.col("target_amount")
    return wide.select(*key, F.inline(entries)).select(
        "scope", *[F.when(F.col("scope") == scope, F.col("owner_id")).alias(f"{scope}_id") for scope in SCOPES],
        "period_type", "period_date", achieved, target,
        percentage_of_target(achieved, target).alias("percentage"),
        status_of_ratio(achieved, target, bands).alias("status"))


def _as_owner(rows: DataFrame, scope: str, column: str) -> DataFrame:
    others = [c for c in rows.columns if c != column]
    return rows.select(F.lit(scope).alias("scope"), F.col(column).alias("owner_id"), *others)


def _active(people: DataFrame, scope: str) -> DataFrame:
    return _as_owner(people.filter("is_active").select("id"), scope, "id")


def employee_performance(sales: DataFrame, employees: DataFrame, targets: DataFrame,
                         periods: Periods, bands: list[Band]) -> DataFrame:
    """Active employees only."""
    sums = _as_owner(_sums_per_employee(sales, periods), "employee", "employee_id")
    return _rated(_active(employees, "employee"), sums, targets.filter("scope = 'employee'"), periods, bands)


def leader_performance(sales: DataFrame, employees: DataFrame, team_leaders: DataFrame, targets: DataFrame,
                       periods: Periods, bands: list[Band]) -> DataFrame:
    """Active leaders only; their totals count every employee of the team."""
    sums = _as_owner(_sums_per_leader(sales, employees, periods), "team_leader", "team_leader_id")
    return _rated(_active(team_leaders, "team_leader"), sums, targets.filter("scope = 'team_leader'"),
                  periods, bands)


def performance_snapshot(sales: DataFrame, employees: DataFrame, team_leaders: DataFrame, targets: DataFrame,
                         periods: Periods, bands: list[Band], computed_at: datetime | None = None) -> DataFrame:
    """Both scopes of one recompute from one pass over the sales.

    The sums per employee are credited to the employee and to the team, so the fact table is read
    once and only sums are shuffled the second time.
    """
    members = employees.select(F.col("id").alias("employee_id"), "team_leader_id")
    credits = F.array(
        F.struct(F.lit("employee").alias("scope"), F.col("employee_id").alias("owner_id")),
        F.struct(F.lit("team_leader").alias("scope"), F.col("team_leader_id").alias("owner_id")))
    kinds = [p.kind for p in periods.all]
    sums = (_sums_per_employee(sales, periods).join(members, "employee_id").select(*kinds, F.inline(credits))
            .filter(F.col("owner_id").isNotNull()).groupBy("scope", "owner_id")
            .agg(*[F.sum(kind).cast(TOTAL).alias(kind) for kind in kinds]))
    owners = _active(employees, "employee").unionByName(_active(team_leaders, "team_leader"))
    rows = _rated(owners, sums, targets, periods, bands)
    return rows if computed_at is None else rows.withColumn("computed_at", F.lit(computed_at))


def upsert_snapshot(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows with the fresh ones put in their place; one row per owner and period."""
    return replace_on_key(stored, fresh, SNAPSHOT_KEY)


def replace_current(stored: DataFrame, fresh: DataFrame, employees: DataFrame, team_leaders: DataFrame, periods: Periods) -> DataFrame:
    """The same for a recompute of ``periods``, which has a row for every active owner: what it replaces is known without computing it."""
    owners = _active(employees, "employee").unionByName(_active(team_leaders, "team_leader"))
    current = periods.is_current(F.col("period_type"), F.col("period_date"))
    # An owner is one id beside a NULL; any other row is of no owner and stays.
    only = ((F.col("scope") == "employee") & F.col("team_leader_id").isNull()) | ((F.col("scope") == "team_leader") & F.col("employee_id").isNull())
    owned = stored.withColumn("owner_id", F.when(F.coalesce(current & only, F.lit(False)), _owner()))
    kept = owned.join(owners, ["scope", "owner_id"], "left_anti").select(*stored.columns)
    return kept.unionByName(fresh.select(*stored.columns))


def live_display(performance: DataFrame, employees: DataFrame, team_leaders: DataFrame,
                 periods: Periods) -> DataFrame:
    """The public board: percentages and the monthly status of visible employees, no amounts."""
    current = performance.filter(
        (F.col("scope") == "employee") & periods.is_current(F.col("period_type"), F.col("period_date")))

    def best(column: str, kind: str) -> Column:
        return F.max(F.when(F.col("period_type") == kind, F.col(column)))

    board = current.groupBy("employee_id").agg(
        best("percentage", "daily").alias("daily_pct"), best("percentage", "weekly").alias("weekly_pct"),
        best("percentage", "monthly").alias("monthly_pct"), best("status", "monthly").alias("status"))
    visible = employees.filter("is_active and show_in_display").select(
        F.col("id").alias("employee_id"), F.col("full_name").alias("employee_name"), "team_leader_id")
    leaders = team_leaders.select(F.col("id").alias("team_leader_id"), F.col("full_name").alias("team_leader_name"))
    return (visible.join(leaders, "team_leader_id", "left").join(board, "employee_id", "left")
            .select("employee_id", "employee_name", "team_leader_name",
                    "daily_pct", "weekly_pct", "monthly_pct", "status"))
