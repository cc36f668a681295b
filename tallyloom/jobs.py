"""Jobs over a warehouse folder: read the stored tables, compute, write, log the run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from tallyloom import schemas
from tallyloom.functions.bands import load_bands
from tallyloom.functions.periods import Periods, period_days
from tallyloom.plans import deltas, performance, review
from tallyloom.plans.deletion import FOREIGN_KEYS, delete_many, deleted_keys
from tallyloom.sources.idtable import IdTable, new_by_table
from tallyloom.sources.sinks import append, log_audit, log_run, replace_periods, replace_snapshot, write_sales
from tallyloom.sources.tables import read_or_empty, read_sales, read_sales_days, read_table


@dataclass(frozen=True)
class Warehouse:
    """Stored tables by name under one root."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return read_table(self.spark, self.path(name), getattr(schemas, name.upper()))


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _rows_seen(written: Observation) -> int:
    """Rows counted by a finished write; an empty result has no count."""
    return written.get.get("n_rows", 0)


def _logged(store: Warehouse, run_id: str, triggered_by: str, work: Callable[[], int]) -> int:
    """Run the work and append its outcome to the run log, also when it fails."""
    started, records, status, message = _now(), 0, "error", None
    try:
        records = work()
        status = "success"
        return records
    except Exception as error:
        message = str(error)
        raise
    finally:
        log_run(store.spark, store.path("run_log"), run_id=run_id, started_at=started, finished_at=_now(),
                status=status, records=records, message=message, triggered_by=triggered_by)


def recompute_performance(store: Warehouse, as_of: date, run_id: str, *, assignments: DataFrame | None = None,
                          triggered_by: str = "auto") -> int:
    """Recompute the current periods of ``as_of`` and put them into the stored snapshots.

    The stored assignments are applied to the sales as they are read, so a recompute keeps every one of them;
    ``assignments`` (sale_id, employee_id, assigned_at) are added to them for this run. Returns the number
    of rows written, counted while they are written.
    """
    def work() -> int:
        periods = Periods(as_of)
        sales = read_sales(store.spark, store.path("sales"), periods.scan_from, periods.scan_until)
        kept = read_or_empty(store.spark, store.path("assignments"), schemas.ASSIGNMENTS)
        if assignments is not None:
            kept = kept.unionByName(assignments.select(*schemas.ASSIGNMENTS.fieldNames()))
        sales = review.with_assignments(sales, kept, "assigned_at")
        fresh = performance.performance_snapshot(
            sales, store.read("employees"), store.read("team_leaders"), store.read("targets"), periods,
            load_bands(store.read("settings")), _now())
        written = Observation("snapshot")
        replace_snapshot(store.spark, fresh.observe(written, F.count("*").alias("n_rows")), store.path("performance"),
                         periods, (store.read("employees"), store.read("team_leaders")))
        return _rows_seen(written)

    return _logged(store, run_id, triggered_by, work)


def assign_sales(store: Warehouse, assignments: DataFrame, *, user_id: int, user_name: str, role: str) -> None:
    """Store manual assignments (sale_id, employee_id; NULL clears) and an audit row for each.

    Both are appended tables; a later recompute applies them. Assignments with their time given keep it.
    """
    now = _now()
    timed = assignments if "assigned_at" in assignments.columns else assignments.withColumn("assigned_at", F.lit(now))
    rows = timed.select(*[F.col(f.name).cast(f.dataType) for f in schemas.ASSIGNMENTS])
    append(rows, store.path("assignments"))
    details = F.to_json(F.struct("employee_id"), {"ignoreNullFields": "false"})
    audit = rows.select(F.lit(user_id).cast("bigint").alias("user_id"), F.lit(user_name).alias("user_name"), F.lit(role).alias("role"),
                        F.lit("assign").alias("action"), F.lit("sale").alias("entity_type"), F.col("sale_id").alias("entity_id"),
                        details.alias("details"), F.lit(now).cast("timestamp").alias("logged_at"))
    append(audit, store.path("audit_log"))


def _stored_assignments(store: Warehouse) -> DataFrame:
    return read_or_empty(store.spark, store.path("assignments"), schemas.ASSIGNMENTS)


def recompute_touched(store: Warehouse, signed: DataFrame, run_id: str, triggered_by: str = "auto") -> int:
    """Recompute the owners and periods that changes touch, past ones included; returns how many.

    ``signed`` are rows (employee_id, sale_date, amount) as in ``plans.deltas``; they say what is touched. The sums are made anew from the
    sales of these periods' days, with all assignments, so that the job can be repeated. The periods are read as a list, which has
    three entries per day that changed at most.
    """
    def work() -> int:
        employees, fresh = store.read("employees"), None
        touched = deltas.sums_by_period(signed, employees).select(*deltas.PERIOD_KEY).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            periods = [(r[0], r[1]) for r in touched.select("period_type", "period_date").distinct().collect()]
            days = sorted({day for kind, start in periods for day in period_days(kind, start)})
            months = sorted({day.replace(day=1) for day in days})
            wanted = store.spark.createDataFrame([(day,) for day in days], "sale_date date")
            sales = review.with_assignments(read_sales_days(store.spark, store.path("sales"), wanted, months), _stored_assignments(store), "assigned_at")
            sums = deltas.sums_by_period(deltas.added_sales(sales), employees)
            zero = F.lit(0).cast(schemas.TOTAL)
            now = touched.join(sums, deltas.PERIOD_KEY, "left").withColumn("amount", F.coalesce("amount", zero).cast(schemas.TOTAL))
            fresh = deltas.rated_rows(now, employees, store.read("team_leaders"), store.read("targets"), load_bands(store.read("settings")), _now())
            fresh = fresh.persist(StorageLevel.MEMORY_AND_DISK)
            replace_periods(store.spark, fresh, store.path("performance"), periods)
            return fresh.count()
        finally:
            touched.unpersist()
            if fresh is not None:
                fresh.unpersist()

    return _logged(store, run_id, triggered_by, work)


def move_sales(store: Warehouse, assignments: DataFrame, run_id: str, *, user_id: int, user_name: str, role: str) -> int:
    """Store manual assignments and recompute the periods, past ones too, of everyone who gains or loses a sale by them."""
    timed = assignments.withColumn("assigned_at", F.lit(_now()))
    sales = review.with_assignments(read_table(store.spark, store.path("sales"), schemas.SALES), _stored_assignments(store), "assigned_at")
    # What moves is written before the assignments are: it is made from them, and a persisted copy would be made anew when they change.
    moves = store.path(f"sale_moves/{run_id}")
    deltas.moved_sales(sales, timed, "assigned_at").write.mode("overwrite").parquet(moves)
    assign_sales(store, timed, user_id=user_id, user_name=user_name, role=role)
    return recompute_touched(store, store.spark.read.schema(schemas.SIGNED_SALES).parquet(moves), run_id, triggered_by="assignment")


def finish_changes(store: Warehouse) -> None:
    """Put tables in place that an interrupted change had written whole; nothing is done where no change is open."""
    marks = read_or_empty(store.spark, store.path("table_changes"), schemas.TABLE_CHANGES)
    done = marks.filter("state = 'done'").select("change_id")
    for mark in marks.filter("state = 'ready'").join(done, "change_id", "left_anti").orderBy("change_id").collect():
        _put_in_place(store, mark["change_id"], mark["tables"])


def _put_in_place(store: Warehouse, change_id: str, names: list[str]) -> None:
    for name in names:
        whole = read_table(store.spark, store.path(f"_changes/{change_id}/{name}"), getattr(schemas, name.upper()))
        whole.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(store.path(name))
    _mark(store, change_id, names, "done")


def _mark(store: Warehouse, change_id: str, names: list[str], state: str) -> None:
    append(store.spark.createDataFrame([(change_id, names, state)], schemas.TABLE_CHANGES).coalesce(1), store.path("table_changes"))


def store_tables(store: Warehouse, changed: dict[str, DataFrame], *, user_id: int, user_name: str, role: str, action: str) -> None:
    """Put changed tables into the warehouse together, with an audit row for each.

    All are first written aside and marked ready, then put in place. A death before the mark changes nothing; after it, the next call, or
    ``finish_changes``, puts the same tables in place again. At most one change is open, so the open marks read are few.
    """
    finish_changes(store)
    now = _now()
    change_id = f"{now:%Y%m%dT%H%M%S%f}"
    for name, rows in changed.items():
        rows.select(*getattr(schemas, name.upper()).fieldNames()).write.mode("overwrite").parquet(store.path(f"_changes/{change_id}/{name}"))
    _mark(store, change_id, list(changed), "ready")
    _put_in_place(store, change_id, list(changed))
    for name in changed:
        log_audit(store.spark, store.path("audit_log"), user_id=user_id, user_name=user_name, role=role, action=action, entity_type=name, logged_at=now)


def store_dimension(store: Warehouse, name: str, changed: DataFrame, *, user_id: int, user_name: str, role: str, action: str) -> None:
    """Put one changed table (the result of an upsert, a replacement or a deletion) into the warehouse, with an audit row."""
    store_tables(store, {name: changed}, user_id=user_id, user_name=user_name, role=role, action=action)


#: Tables that are rewritten as a whole when rows they refer to are deleted. Sales and snapshots lie in folders by time.
_WHOLE_TABLES = ("users", "sessions", "team_leaders", "settings", "employees", "targets", "keywords")


def delete_from(store: Warehouse, name: str, ids: DataFrame, *, user_id: int, user_name: str, role: str) -> list[str]:
    """Delete rows of a dimension by id with everything that cascades from them; returns the tables that were stored anew.

    Sales and snapshots of deleted owners are rewritten in their folders of the months and periods they lie in.
    """
    spark = store.spark
    finish_changes(store)
    tables = {n: read_or_empty(spark, store.path(n), getattr(schemas, n.upper())) for n in _WHOLE_TABLES}
    by_month = T.StructType([*schemas.SALES.fields, T.StructField("sale_month", T.DateType())])
    folders = {"sales": (by_month, ["sale_month"]), "performance": (schemas.PERFORMANCE, ["period_type", "period_date"])}
    tables |= {n: read_or_empty(spark, store.path(n), schema) for n, (schema, _) in folders.items()}
    key = "session_id" if name == "sessions" else "id"
    gone = tables[name].join(ids.select(F.col("id").alias(key)), key, "left_semi")
    left = delete_many(tables, {name: gone})
    touched = {child for child, _, parent, _ in FOREIGN_KEYS if parent in deleted_keys(tables, {name: gone})} | {name}
    facts = {n: left[n] for n in folders if n in touched}
    aside = store.path(f"_deleted/{_now():%Y%m%dT%H%M%S%f}")
    for n, rows in facts.items():
        # Only folders that lose rows are written again; they are read back from aside, since they are made from what they replace.
        parts = folders[n][1]
        before = tables[n].groupBy(*parts).agg(F.count("*").alias("had"))
        kept = rows.groupBy(*parts).agg(F.count("*").alias("has")).withColumnsRenamed({p: f"_{p}" for p in parts})
        same = reduce(Column.__and__, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parts])
        changed = before.join(kept, same, "left").filter("had > coalesce(has, 0)").select(*parts)
        named = changed.withColumnsRenamed({p: f"_{p}" for p in parts})
        rows.join(named, same, "left_semi").write.parquet(f"{aside}/{n}")
        changed.write.parquet(f"{aside}/{n}_folders")
    whole = {n: left[n] for n in _WHOLE_TABLES if n in touched}
    # The tables that name the deleted rows go last: until then the job can be run again.
    for n in facts:
        schema, parts = folders[n]
        emptied = spark.read.parquet(f"{aside}/{n}_folders")
        back = read_table(spark, f"{aside}/{n}", schema)
        _replace_folders(back, emptied, store.path(n), parts)
    store_tables(store, whole, user_id=user_id, user_name=user_name, role=role, action="delete")
    return sorted([*facts, *whole])


def _replace_folders(rows: DataFrame, folders: DataFrame, path: str, parts: list[str]) -> None:
    """Overwrite the named folders; one that has no row left keeps an empty file."""
    held = rows.groupBy(*parts).agg(F.count("*").alias("n")).withColumnsRenamed({p: f"_{p}" for p in parts})
    same = reduce(Column.__and__, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in parts])
    empty = folders.join(held, same, "left_anti")
    for folder in empty.collect():  # folders by month or by period, of deleted owners only
        name = "/".join(f"{p}={folder[p]}" for p in parts)
        rows.limit(0).drop(*parts).write.mode("overwrite").parquet(f"{path}/{name}")
    (rows.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))


def load_sales(store: Warehouse, arrived: DataFrame, order: list[str], run_id: str, triggered_by: str = "auto") -> int:
    """Append the sales that are new by invoice. A repeated load of identified sales adds nothing.

    Known invoices are looked up in a bucketed table of their own. Each load marks its start and its end; if the last one did
    not end, or sales came before the table, it is first rebuilt from the sales.
    """
    def work() -> int:
        spark, marks = store.spark, store.path("sales_loads")
        ids = IdTable(spark, store.path("invoice_ids"))
        loads = read_or_empty(spark, marks, schemas.SALES_LOADS).agg(
            F.max("load_no"), F.max(F.when(F.col("state") == "ended", F.col("load_no")))).first()
        last, ended = (n or 0 for n in loads)
        if last != ended or last == 0:
            ids.rebuild(read_or_empty(spark, store.path("sales"), schemas.SALES).select("invoice_ref"), last)
        now = last + 1
        append(spark.createDataFrame([(now, "started")], schemas.SALES_LOADS), marks)
        # What is appended is fixed before the sales change, since they are appended in place.
        fresh = new_by_table(arrived, "invoice_ref", order, ids, now).select(*schemas.SALES.fieldNames()).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            written = Observation("sales")
            write_sales(fresh.observe(written, F.count("*").alias("n_rows")), store.path("sales"))
            ids.add(fresh.select("invoice_ref"), now)
        finally:
            fresh.unpersist()
        append(spark.createDataFrame([(now, "ended")], schemas.SALES_LOADS), marks)
        return _rows_seen(written)

    return _logged(store, run_id, triggered_by, work)


def live_board(store: Warehouse, as_of: date) -> DataFrame:
    """The public board from the stored snapshots."""
    return performance.live_display(store.read("performance"), store.read("employees"), store.read("team_leaders"),
                                    Periods(as_of))
