"""Batches of changes to the dimension tables: cleaned, checked, applied; what fails is handed back.

Every function returns (rows of the table after the batch, rejected changes with a reason).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.defaults import DEFAULT_KEYWORD_LABEL
from tallyloom.functions.text import none_if_blank, none_if_empty
from tallyloom.operators import integrity, keyed

TARGET_KEY = ["scope", "employee_id", "team_leader_id", "period_type"]


def _filled(changes: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Changes with their own NULLs in these columns replaced by the default."""
    given = {name: F.coalesce(name, value) for name, value in defaults.items() if name in changes.columns}
    return changes.withColumns(given) if given else changes


def _apply(base: DataFrame, checked: DataFrame, order: str, new_id: Column, changed_at: datetime | None,
           defaults: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    valid, broken = integrity.split_by_reasons(checked)
    stamp = F.lit(changed_at) if changed_at is not None else None
    after, unknown = keyed.upsert_rows(base, valid, order=order, new_id=new_id, stamp=stamp, defaults=defaults)
    refused = broken.withColumn("reason", F.array_join("reasons", ", ")).drop("reasons")
    return after, unknown.unionByName(refused)


def upsert_employees(base: DataFrame, changes: DataFrame, *, order: str, new_id: Column,
                     changed_at: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Empty codes and references become NULL; a change without a name is refused."""
    blanks = {c: none_if_empty(F.col(c)) for c in ("employee_code", "external_ref") if c in changes.columns}
    defaults = {"show_in_display": F.lit(True), "is_active": F.lit(True)}
    cleaned = _filled(changes.withColumns(blanks) if blanks else changes, defaults)
    checked = integrity.with_reasons(cleaned, {"missing name": none_if_blank(F.col("full_name")).isNull()})
    return _apply(base, checked, order, new_id, changed_at, defaults)


def upsert_team_leaders(base: DataFrame, changes: DataFrame, *, order: str, new_id: Column,
                        changed_at: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    defaults = {"is_active": F.lit(True)}
    cleaned = _filled(changes, defaults)
    checked = integrity.with_reasons(cleaned, {"missing name": none_if_blank(F.col("full_name")).isNull()})
    return _apply(base, checked, order, new_id, changed_at, defaults)


def upsert_keywords(base: DataFrame, changes: DataFrame, *, order: str, new_id: Column,
                    default_label: str = DEFAULT_KEYWORD_LABEL) -> tuple[DataFrame, DataFrame]:
    """Phrases and labels are trimmed; a rule without a phrase is refused, one without a label gets the default."""
    trimmed = changes.withColumns({"phrase": F.trim("phrase"), "label": none_if_blank(F.col("label"))})
    defaults = {"label": F.lit(default_label), "is_active": F.lit(True)}
    cleaned = _filled(trimmed, defaults)
    checked = integrity.with_reasons(cleaned, {"missing phrase": none_if_blank(F.col("phrase")).isNull()})
    return _apply(base, checked, order, new_id, None, defaults)


def set_targets(stored: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last target given per owner and period (highest id) takes the place of all stored ones."""
    valid, broken = integrity.split_by_reasons(integrity.check_targets(changes))
    latest = keyed.last_per_key(valid, TARGET_KEY, ["id"])
    return (keyed.replace_on_key(stored, latest, TARGET_KEY),
            broken.withColumn("reason", F.array_join("reasons", ", ")).drop("reasons"))
