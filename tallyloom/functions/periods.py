"""Day, week and month around a date. Weeks start on Monday, also across a month's start."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    kind: str
    start: date
    end: date

    def contains(self, day: Column) -> Column:
        return (day >= F.lit(self.start)) & (day < F.lit(self.end))


@dataclass(frozen=True)
class Periods:
    """The three current periods of one day, as literals that reach the scan."""

    as_of: date

    @property
    def all(self) -> tuple[Period, Period, Period]:
        week = self.as_of - timedelta(days=self.as_of.weekday())
        month = self.as_of.replace(day=1)
        next_month = (month + timedelta(days=31)).replace(day=1)
        return (
            Period("daily", self.as_of, self.as_of + timedelta(days=1)),
            Period("weekly", week, week + timedelta(days=7)),
            Period("monthly", month, next_month),
        )

    @property
    def scan_from(self) -> date:
        return min(period.start for period in self.all)

    @property
    def scan_until(self) -> date:
        return max(period.end for period in self.all)

    def covers(self, day: Column) -> Column:
        """Bound of the fact scan: the smallest range that holds all three periods."""
        return (day >= F.lit(self.scan_from)) & (day < F.lit(self.scan_until))

    def is_current(self, period_type: Column, period_date: Column) -> Column:
        pairs = [(period_type == p.kind) & (period_date == F.lit(p.start)) for p in self.all]
        return pairs[0] | pairs[1] | pairs[2]

    def rows(self) -> Column:
        """The period grid as an array of literals, to be unfolded per row without a join."""
        return F.array(*[
            F.struct(F.lit(p.kind).alias("period_type"), F.lit(p.start).alias("period_date"),
                     F.lit(p.end).alias("period_end"))
            for p in self.all
        ])


def period_columns(day: Column) -> list[Column]:
    """Starts and exclusive ends of the periods around a date column."""
    week, month = F.to_date(F.trunc(day, "week")), F.to_date(F.trunc(day, "month"))
    return [
        day.alias("day_start"), F.date_add(day, 1).alias("day_end"),
        week.alias("week_start"), F.date_add(week, 7).alias("week_end"),
        month.alias("month_start"), F.add_months(month, 1).alias("month_end"),
    ]


def period_days(kind: str, start: date) -> list[date]:
    """All days of a period that starts on a date."""
    period = next(p for p in Periods(start).all if p.kind == kind)
    return [period.start + timedelta(days=n) for n in range((period.end - period.start).days)]
