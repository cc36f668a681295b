"""Performance for many dates at once, by prefix sums: a period's sum is the difference of two cumulative values.

The fact table is read once and reduced to totals per owner and day. Per owner the totals of all days become one array of
cumulative values, as long as there are days, and any half-open range of days is read from two places of it.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.schemas import TOTAL


def daily_totals(sales: DataFrame, employees: DataFrame, first: date, until: date) -> DataFrame:
    """scope, owner_id, day and amount of all owners, from one pass over the days asked for."""
    day = F.col("sale_date")
    inside = sales.filter((day >= F.lit(first)) & (day < F.lit(until)) & F.col("employee_id").isNotNull())
    per_day = inside.groupBy("employee_id", day.alias("day")).agg(F.sum("amount").cast(TOTAL).alias("amount"))
    members = employees.select(F.col("id").alias("employee_id"), "team_leader_id")
    credits = F.array(F.struct(F.lit("employee").alias("scope"), F.col("employee_id").alias("owner_id")),
                      F.struct(F.lit("team_leader").alias("scope"), F.col("team_leader_id").alias("owner_id")))
    return (per_day.join(members, "employee_id", "left").select("day", "amount", F.inline(credits)).filter(F.col("owner_id").isNotNull())
            .groupBy("scope", "owner_id", "day").agg(F.sum("amount").cast(TOTAL).alias("amount")))


def cumulative(totals: DataFrame, first: date, until: date) -> DataFrame:
    """One row per owner: ``running``, where place ``n`` holds the sum of all days before ``first + n``."""
    owner = ["scope", "owner_id"]
    last = F.lit(until)
    days = totals.select(*owner).distinct().select(*owner, F.explode(F.sequence(F.lit(first), last)).alias("day"))
    every = days.join(totals, [*owner, "day"], "left")
    before = Window.partitionBy(*owner).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    sums = every.select(*owner, "day", F.coalesce(F.sum("amount").over(before).cast(TOTAL), F.lit(0).cast(TOTAL)).alias("sum"))
    ordered = F.array_sort(F.collect_list(F.struct("day", "sum")))
    return sums.groupBy(*owner).agg(F.transform(ordered, lambda d: d["sum"]).alias("running"))


def range_sum(running: Column, first: date, start: Column, end: Column) -> Column:
    """Sum over ``start <= day < end`` from an owner's cumulative values."""
    value = lambda day: F.get(running, F.date_diff(day, F.lit(first)))
    return (value(end) - value(start)).cast(TOTAL)


def performance_calendar(sales: DataFrame, employees: DataFrame, first_day: date, last_day: date) -> DataFrame:
    """Achieved amount of the day, week and month around every day from ``first_day`` to ``last_day``, for owners with a sale near them."""
    first = min(first_day.replace(day=1), first_day - timedelta(days=first_day.weekday()))
    until = max((last_day.replace(day=1) + timedelta(days=31)).replace(day=1), last_day + timedelta(days=7))
    owners = cumulative(daily_totals(sales, employees, first, until), first, until)
    as_of = F.col("as_of")
    rows = owners.select("*", F.explode(F.sequence(F.lit(first_day), F.lit(last_day))).alias("as_of"))
    week, month = F.to_date(F.trunc(as_of, "week")), F.to_date(F.trunc(as_of, "month"))
    bounds = (("daily", as_of, F.date_add(as_of, 1)), ("weekly", week, F.date_add(week, 7)), ("monthly", month, F.add_months(month, 1)))
    periods = F.array(*[F.struct(F.lit(kind).alias("period_type"), start.alias("period_date"),
                                 range_sum(F.col("running"), first, start, end).alias("achieved_amount")) for kind, start, end in bounds])
    return rows.select("scope", "owner_id", "as_of", F.inline(periods))
