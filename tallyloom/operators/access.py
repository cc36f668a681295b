"""What a role may see: rows of the own team, percentages without amounts, live sessions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.defaults import SEES_ALL, SESSION_DAYS


def leader_of_user(team_leaders: DataFrame, user_id: int) -> DataFrame:
    """The team of a user, one row; of several the lowest id, NULL where there is none."""
    return team_leaders.filter(F.col("user_id") == user_id).agg(F.min("id").alias("team_leader_id"))


def own_rows(rows: DataFrame, role: str, leader: DataFrame, owner: str) -> DataFrame:
    """Rows a role may see by their team column; ``leader`` is the one-row result above.

    A NULL team equals nothing, so a leader without a team sees nothing, and so does an unknown role
    without one.
    """
    if role in SEES_ALL:
        return rows
    return rows.filter(F.col(owner) == leader.scalar())


def own_team_rows(rows: DataFrame, role: str, leader: DataFrame, employees: DataFrame) -> DataFrame:
    """Rows of the own team's members or of the team itself, by employee_id or team_leader_id."""
    if role in SEES_ALL:
        return rows
    team = (employees.filter(F.col("team_leader_id") == leader.scalar())
            .select(F.col("id").alias("employee_id"), F.lit(True).alias("_member")))
    return (rows.join(team, "employee_id", "left")
            .filter(F.coalesce("_member", F.lit(False)) | (F.col("team_leader_id") == leader.scalar()))
            .select(*rows.columns))


def without_amounts(performance: DataFrame) -> DataFrame:
    return performance.select("scope", "employee_id", "team_leader_id", "period_type", "period_date",
                              "percentage", "status")


def user_directory(users: DataFrame) -> DataFrame:
    """Users without anything secret; a stored password column never leaves."""
    shown = ["id", "username", "email", "full_name", "role", "is_active", "last_login_at"]
    return users.select(*[c for c in shown if c in users.columns])


def active_sessions(sessions: DataFrame, users: DataFrame, as_of: datetime) -> DataFrame:
    """Unexpired sessions of active users."""
    people = users.filter("is_active").select(F.col("id").alias("user_id"), "full_name", "role")
    return (sessions.filter(F.col("expires_at") > F.lit(as_of))
            .join(people, "user_id").select("session_id", "user_id", "full_name", "role", "expires_at"))


def session_expiry(created_at: Column) -> Column:
    return created_at + F.make_dt_interval(F.lit(SESSION_DAYS))


def active_admins(users: DataFrame) -> DataFrame:
    """Number of active administrators and whether the rule of at least one holds."""
    count = F.count_if((F.col("role") == "admin") & F.col("is_active"))
    return users.agg(count.alias("n_admins"), (count >= 1).alias("is_valid"))
