"""Table changes by key: first or last row per key, insert if absent, replace, upsert.

Rows per key are reduced with ``min`` / ``max`` of a struct that starts with the order, never with a
window: each task first reduces its own rows, so a key that holds a third of the table leaves every
task as one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _extreme_per_key(rows: DataFrame, keys: list[str], order: list[str], extreme) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c not in order]
    sorted_first = F.struct(*[c for c in order if c not in keys], *rest)
    picked = rows.groupBy(*keys).agg(extreme(sorted_first).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in rows.columns])


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of every key by ``order``, then by the other columns; NULL is a key like any other."""
    return _extreme_per_key(rows, keys, order, F.min)


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _extreme_per_key(rows, keys, order, F.max)


def first_per_known_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per non-NULL key and every row without one, as a unique index would keep them.

    Keys are counted first, alone. Rows whose key does not repeat pass as they are, without a sort; only the others
    are reduced. Rows without a key never enter the shuffle, however many they are.
    """
    known = rows.filter(F.col(key).isNotNull())
    repeated = known.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
    single = known.join(repeated, key, "left_anti").select(*rows.columns)
    reduced = first_per_key(known.join(repeated, key, "left_semi").select(*rows.columns), [key], order)
    return single.unionByName(reduced).unionByName(rows.filter(F.col(key).isNull()))


def _same_key(left: str, right: str, keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def absent(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet. A NULL in the key never matches, so such rows all stay."""
    return rows.join(stored.select(*keys), keys, "left_anti")


def new_rows(arrived: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each key that is not stored yet; rows without a key all pass, unshuffled.

    The stored keys are first cut down to those that arrived. That join moves the small side, so the
    history is scanned for one column and not shuffled.
    """
    identified = arrived.filter(F.col(key).isNotNull())
    known = stored.select(key).join(identified.select(key), key, "left_semi")
    first = absent(first_per_key(identified, [key], order), known, [key])
    return first.unionByName(arrived.filter(F.col(key).isNull()))


def replace_on_key(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows plus the stored rows they do not replace; NULLs in a key are equal."""
    kept = stored.alias("s").join(fresh.select(*keys).alias("f"), _same_key("s", "f", keys), "left_anti")
    return kept.unionByName(fresh.select(*stored.columns))


def duplicate_keys(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def upsert_rows(base: DataFrame, changes: DataFrame, *, order: str, new_id: Column,
                stamp: Column | None = None, defaults: dict[str, Column] | None = None,
                ) -> tuple[DataFrame, DataFrame]:
    """Apply a batch of changes to a dimension with an ``id``; returns (rows, rejected changes).

    A change with an id replaces the columns it carries, one without an id becomes a new row with
    ``new_id``, and one with an unknown id is rejected. The last change per id by ``order`` wins;
    a stored column the changes do not carry keeps its value, and a new row gets the default of such a
    column.
    """
    carried = [c for c in base.columns if c in changes.columns and c != "id"]
    edits = last_per_key(changes.filter(F.col("id").isNotNull()), ["id"], [order])
    packed = edits.select("id", F.struct(*carried).alias("_edit"))

    def value(name: str) -> Column:
        if name in carried:
            return F.when(F.col("_edit").isNotNull(), F.col(f"_edit.{name}")).otherwise(F.col(name)).alias(name)
        if name == "updated_at" and stamp is not None:
            return F.when(F.col("_edit").isNotNull(), stamp).otherwise(F.col(name)).alias(name)
        return F.col(name)

    updated = base.join(packed, "id", "left").select(*[value(c) for c in base.columns])
    added = changes.filter(F.col("id").isNull()).withColumn("id", new_id)
    if "updated_at" in base.columns and stamp is not None:
        added = added.withColumn("updated_at", stamp)
    missing = [c for c in base.columns if c not in added.columns]
    added = added.select("*", *[(defaults or {}).get(c, F.lit(None)).cast(base.schema[c].dataType).alias(c)
                                for c in missing])
    unknown = changes.filter(F.col("id").isNotNull()).join(base.select("id"), "id", "left_anti")
    return (updated.unionByName(added.select(*base.columns)),
            unknown.select(*changes.columns).withColumn("reason", F.lit("unknown id")))
