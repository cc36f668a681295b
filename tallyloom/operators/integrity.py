"""Foreign keys and constraints over whole tables: cascades, set-null, reports of broken rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.defaults import PERIOD_TYPES, ROLES, SCOPES
from tallyloom.functions.text import none_if_blank, normalize_text


def without_children_of(children: DataFrame, deleted: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Children whose parent is not deleted. A child without a parent stays."""
    gone = deleted.select(F.col(pk).alias(fk)).distinct()
    return children.join(gone, fk, "left_anti").select(*children.columns)


def children_of(children: DataFrame, deleted: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """The children a cascade removes; they are the deleted rows of the next level."""
    gone = deleted.select(F.col(pk).alias(fk)).distinct()
    return children.join(gone, fk, "left_semi").select(*children.columns)


def null_children_of(children: DataFrame, deleted: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """All children, with the key of a deleted parent set to NULL; other columns stay as they are."""
    gone = deleted.select(F.col(pk).alias(fk), F.lit(True).alias("_gone")).distinct()
    kept = F.when(F.col("_gone").isNull(), F.col(fk)).alias(fk)
    return (children.join(gone, fk, "left")
            .select(*[kept if c == fk else F.col(c) for c in children.columns]))


def orphan_keys(children: DataFrame, parents: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Keys that point at no parent, with the number of rows that hold them; counted before the join."""
    per_key = children.filter(F.col(fk).isNotNull()).groupBy(fk).agg(F.count("*").alias("n_rows"))
    return per_key.join(parents.select(F.col(pk).alias(fk)), fk, "left_anti")


def with_reasons(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with the names of the rules they break, in rule order. A rule is true where a row breaks it."""
    broken = [F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return rows.withColumn("reasons", F.array_compact(F.array(*broken)))


def split_by_reasons(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the reasons column, rejected rows with it)."""
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def _blank(name: str) -> Column:
    return none_if_blank(F.coalesce(F.col(name), F.lit(""))).isNull()


def _too_long(name: str, limit: int) -> Column:
    return F.length(name) > limit


def _not_in(name: str, allowed: tuple[str, ...]) -> Column:
    return F.col(name).isNull() | ~F.col(name).isin(*allowed)


def check_targets(targets: DataFrame) -> DataFrame:
    scope = F.col("scope")
    return with_reasons(targets, {
        "bad scope": _not_in("scope", SCOPES),
        "bad period": _not_in("period_type", PERIOD_TYPES),
        "bad amount": F.col("target_amount").isNull() | (F.col("target_amount") < 0),
        "missing owner": ((scope == "employee") & F.col("employee_id").isNull())
        | ((scope == "team_leader") & F.col("team_leader_id").isNull()),
    })


def check_employees(employees: DataFrame) -> DataFrame:
    return with_reasons(employees, {
        "missing name": _blank("full_name"),
        "long name": _too_long("full_name", 255),
        "long reference": _too_long("external_ref", 150),
        "missing flag": F.col("is_active").isNull() | F.col("show_in_display").isNull(),
    })


def check_users(users: DataFrame) -> DataFrame:
    return with_reasons(users, {
        "missing username": _blank("username"),
        "missing name": _blank("full_name"),
        "bad role": _not_in("role", ROLES),
    })


def check_keywords(keywords: DataFrame) -> DataFrame:
    """Rules without a phrase, and rules whose phrase normalises to nothing and so can never match."""
    return with_reasons(keywords, {
        "missing phrase": _blank("phrase"),
        "matches nothing": ~_blank("phrase") & (normalize_text(F.col("phrase")) == ""),
    })


def check_performance(performance: DataFrame) -> DataFrame:
    """Snapshot rows outside the allowed words, or with a percentage too wide for the public board."""
    return with_reasons(performance, {
        "bad scope": _not_in("scope", SCOPES),
        "bad period": _not_in("period_type", PERIOD_TYPES),
        "percentage over 9999.99": F.abs("percentage") > F.lit(9999.99).cast("decimal(6,2)"),
    })


def check_settings(settings: DataFrame) -> DataFrame:
    """Settings whose value is not a JSON object."""
    is_object = F.from_json("value", "map<string,string>").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{"))
    return with_reasons(settings, {"not an object": F.col("value").isNull() | ~is_object})


def same_ignoring_case(rows: DataFrame, column: str) -> DataFrame:
    """Values that are equal but for case or outer blanks, with their counts."""
    return (rows.filter(F.col(column).isNotNull()).groupBy(F.lower(F.trim(column)).alias(column))
            .agg(F.count("*").alias("n_rows")).filter("n_rows > 1"))
