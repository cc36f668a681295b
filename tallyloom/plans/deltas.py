"""Performance after changes to single sales: which owners and periods they touch, past ones included, and by how much.

A change is one signed row: a new sale adds its amount, a moved sale takes it from the old employee and adds it to the new one, a
cleared sale only takes it. Changes are summed per employee and day first, then credited to the three periods of the day, to the
employee and to the current team, so what is shuffled does not grow with the sales that did not change.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.defaults import SCOPES
from tallyloom.functions.bands import Band, percentage_of_target, status_of_ratio
from tallyloom.plans.performance import _active, _owner
from tallyloom.schemas import MONEY, TOTAL

PERIOD_KEY = ["scope", "owner_id", "period_type", "period_date"]


def periods_of(day: Column) -> Column:
    """The day, week and month that hold a date, as rows to unfold."""
    starts = (("daily", day), ("weekly", F.to_date(F.trunc(day, "week"))), ("monthly", F.to_date(F.trunc(day, "month"))))
    return F.array(*[F.struct(F.lit(kind).alias("period_type"), start.alias("period_date")) for kind, start in starts])


def added_sales(sales: DataFrame) -> DataFrame:
    """Signed rows (employee_id, sale_date, amount) of sales that are new."""
    return sales.filter(F.col("employee_id").isNotNull()).select("employee_id", "sale_date", F.col("amount").cast(TOTAL).alias("amount"))


def moved_sales(sales: DataFrame, assignments: DataFrame, order: str) -> DataFrame:
    """Signed rows of sales that assignments move or clear; an assignment to the employee a sale has changes nothing."""
    latest = (assignments.filter(F.col("sale_id").isNotNull()).groupBy("sale_id")
              .agg(F.max(F.struct(F.col(order), "employee_id"))["employee_id"].alias("new_id")))
    moved = sales.join(latest, sales["id"] == latest["sale_id"]).filter(~F.col("employee_id").eqNullSafe(F.col("new_id")))
    amount = F.col("amount").cast(TOTAL)
    signed = F.array(F.struct(F.col("employee_id").alias("owner"), (-amount).cast(TOTAL).alias("signed")),
                     F.struct(F.col("new_id").alias("owner"), amount.alias("signed")))
    return (moved.select("sale_date", F.inline(signed)).filter(F.col("owner").isNotNull())
            .select(F.col("owner").alias("employee_id"), "sale_date", F.col("signed").alias("amount")))


def sums_by_period(signed: DataFrame, employees: DataFrame) -> DataFrame:
    """Sums per scope, owner and period; teams as they are now, inactive employees included."""
    per_day = signed.groupBy("employee_id", "sale_date").agg(F.sum("amount").cast(TOTAL).alias("amount"))
    per_period = (per_day.select("employee_id", "amount", F.inline(periods_of(F.col("sale_date"))))
                  .groupBy("employee_id", "period_type", "period_date").agg(F.sum("amount").cast(TOTAL).alias("amount")))
    members = employees.select(F.col("id").alias("employee_id"), "team_leader_id")
    credits = F.array(F.struct(F.lit("employee").alias("scope"), F.col("employee_id").alias("owner_id")),
                      F.struct(F.lit("team_leader").alias("scope"), F.col("team_leader_id").alias("owner_id")))
    return (per_period.join(members, "employee_id").select("period_type", "period_date", "amount", F.inline(credits))
            .filter(F.col("owner_id").isNotNull()).groupBy(*PERIOD_KEY).agg(F.sum("amount").cast(TOTAL).alias("amount")))


def rated_rows(sums: DataFrame, employees: DataFrame, team_leaders: DataFrame, targets: DataFrame, bands: list[Band],
               computed_at: datetime | None = None) -> DataFrame:
    """Snapshot rows of active owners for any periods, from their sums."""
    owners = _active(employees, "employee").unionByName(_active(team_leaders, "team_leader"))
    latest = (targets.withColumn("owner_id", _owner()).filter(F.col("owner_id").isNotNull())
              .groupBy("scope", "owner_id", "period_type").agg(F.max_by("target_amount", "id").alias("target")))
    rows = sums.join(owners, ["scope", "owner_id"], "left_semi").join(latest, ["scope", "owner_id", "period_type"], "left")
    achieved, target = F.col("achieved_amount"), F.col("target_amount")
    wide = rows.select(*PERIOD_KEY, F.col("amount").alias("achieved_amount"), F.coalesce("target", F.lit(0).cast(MONEY)).alias("target_amount"))
    rated = wide.select(
        "scope", *[F.when(F.col("scope") == scope, F.col("owner_id")).alias(f"{scope}_id") for scope in SCOPES],
        "period_type", "period_date", achieved, target, percentage_of_target(achieved, target).alias("percentage"),
        status_of_ratio(achieved, target, bands).alias("status"))
    return rated if computed_at is None else rated.withColumn("computed_at", F.lit(computed_at))


def performance_history(sales: DataFrame, employees: DataFrame, team_leaders: DataFrame, targets: DataFrame,
                        bands: list[Band]) -> DataFrame:
    """Snapshot rows of every period with a sale of the owner."""
    return rated_rows(sums_by_period(added_sales(sales), employees), employees, team_leaders, targets, bands)


def performance_delta(stored: DataFrame, signed: DataFrame, employees: DataFrame, team_leaders: DataFrame, targets: DataFrame,
                      bands: list[Band], computed_at: datetime | None = None) -> DataFrame:
    """The rows of ``stored`` that signed changes touch, as they are afterwards.

    ``stored`` holds every period that had a sale (``performance_history``); a period that is not in it starts from nothing. Targets and
    teams are the current ones. The result replaces its keys in ``stored``.
    """
    before = stored.select("scope", _owner().alias("owner_id"), "period_type", "period_date", F.col("achieved_amount").alias("had"))
    touched = sums_by_period(signed, employees).join(before, PERIOD_KEY, "left")
    after = (F.col("amount") + F.coalesce("had", F.lit(0).cast(TOTAL))).cast(TOTAL)
    return rated_rows(touched.select(*PERIOD_KEY, after.alias("amount")), employees, team_leaders, targets, bands, computed_at)
