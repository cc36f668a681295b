"""Teams and their members as JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def team_rosters(team_leaders: DataFrame, employees: DataFrame) -> DataFrame:
    """One row per team and member, the member as JSON, in the order of team, member name and id.

    The order is a range sort over all rows, so no task gathers a team, whatever its size. A team without members
    has one row without a member.
    """
    member = F.to_json(F.struct("full_name", "id", "is_active"))
    members = employees.filter(F.col("team_leader_id").isNotNull()).select(
        "team_leader_id", F.col("full_name").alias("_name"), F.col("id").alias("employee_id"), member.alias("member"))
    teams = team_leaders.select(F.col("id").alias("team_leader_id"), F.col("full_name").alias("team_leader_name"))
    return (teams.join(members, "team_leader_id", "left").orderBy("team_leader_id", "_name", "employee_id")
            .select("team_leader_id", "team_leader_name", "employee_id", "member"))
