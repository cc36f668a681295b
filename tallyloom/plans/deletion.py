"""Deleting rows with everything that depends on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from tallyloom.operators.integrity import children_of, null_children_of, without_children_of

# Foreign keys as (child table, column, parent table, cascades). The others are set to NULL.
FOREIGN_KEYS = (
    ("team_leaders", "user_id", "users", False),
    ("sessions", "user_id", "users", True),
    ("audit_log", "user_id", "users", False),
    ("settings", "updated_by", "users", False),
    ("employees", "team_leader_id", "team_leaders", False),
    ("targets", "team_leader_id", "team_leaders", True),
    ("performance", "team_leader_id", "team_leaders", True),
    ("targets", "employee_id", "employees", True),
    ("sales", "employee_id", "employees", True),
    ("performance", "employee_id", "employees", True),
    ("messages", "employee_id", "employees", False),
    ("notes", "employee_id", "employees", False),
    ("messages", "customer_id", "customers", True),
    ("notes", "customer_id", "customers", False),
    ("notes", "message_id", "messages", True),
    ("notes", "keyword_id", "keywords", False),
)
_KEYS = {"messages": "message_id", "sessions": "session_id"}


def _key(name: str) -> str:
    return _KEYS.get(name, "id")


def deleted_keys(tables: dict[str, DataFrame], deleted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Keys of all rows that go, per table that others refer to: the given ones and, to any depth, what cascades from them.

    The foreign keys form no cycle, so parents are worked through before their children and every table is met once.
    """
    parents = [p for p in dict.fromkeys(parent for _, _, parent, _ in FOREIGN_KEYS) if p in tables]
    gone: dict[str, DataFrame] = {}
    for name in parents:
        own = [deleted[name].select(_key(name))] if name in deleted else []
        for child, column, parent, cascades in FOREIGN_KEYS:
            if child == name and cascades and parent in gone:
                own.append(children_of(tables[name], gone[parent], column, _key(parent)).select(_key(name)))
        if own:
            gone[name] = reduce(DataFrame.unionByName, own)
    return gone


def delete_many(tables: dict[str, DataFrame], deleted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after the given rows of some of them are gone, with all their dependants.

    The deleted keys are found first. Then each table is read once, with one join per foreign key whose parent lost rows: rows of a
    cascading key go, other keys become NULL. Tables that are not given are left out.
    """
    gone = deleted_keys(tables, deleted)
    after = {}
    for name, rows in tables.items():
        if name in deleted:
            rows = without_children_of(rows, deleted[name], _key(name), _key(name))
        for child, column, parent, cascades in FOREIGN_KEYS:
            if child == name and parent in gone:
                change = without_children_of if cascades else null_children_of
                rows = change(rows, gone[parent], column, _key(parent))
        after[name] = rows
    return after


def delete_rows(tables: dict[str, DataFrame], name: str, deleted: DataFrame) -> dict[str, DataFrame]:
    """The tables after ``deleted`` rows of table ``name`` are gone."""
    return delete_many(tables, {name: deleted})
