"""Writing results so that a repeated write changes nothing."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.defaults import DEFAULT_KEYWORDS, PERIOD_TYPES
from tallyloom.functions.periods import Periods
from tallyloom.operators.keyed import absent
from tallyloom.plans.performance import replace_current, upsert_snapshot
from tallyloom.schemas import AUDIT_LOG, KEYWORDS, PERFORMANCE, RUN_LOG
from tallyloom.sources.tables import read_or_empty


def append(rows: DataFrame, path: str, *partitions: str) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """One micro-batch as one partition folder; a retry of the batch replaces its own folder."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def write_sales(sales: DataFrame, path: str) -> None:
    """Sales partitioned by month of sale, so a recompute reads at most three months' folders.

    The rebalance gives each month files of an even size and splits a month that holds most rows.
    """
    rows = sales.withColumn("sale_month", F.trunc("sale_date", "month"))
    rows.hint("rebalance", "sale_month").write.mode("append").partitionBy("sale_month").parquet(path)


def replace_snapshot(spark: SparkSession, fresh: DataFrame, path: str, periods: Periods, owners: tuple[DataFrame, DataFrame] | None = None) -> None:
    """Put a recompute into the stored snapshots; only the three current period folders are read and rewritten.

    With ``owners`` (employees, team leaders) the rows to replace are found without computing ``fresh`` a second time.
    Snapshots are derived data: a run that dies while it commits is repaired by running it again.
    """
    stored = read_or_empty(spark, path, PERFORMANCE).filter(
        periods.is_current(F.col("period_type"), F.col("period_date")))
    rows = fresh.select(*PERFORMANCE.fieldNames())
    _write_periods(upsert_snapshot(stored, rows) if owners is None else replace_current(stored, rows, *owners, periods), path)


def replace_periods(spark: SparkSession, fresh: DataFrame, path: str, periods: list[tuple[str, date]]) -> None:
    """Put rows of any periods into the stored snapshots; only the folders of these periods are read and rewritten."""
    if not periods:
        return
    wanted = F.lit(False)
    for kind in PERIOD_TYPES:
        wanted = wanted | ((F.col("period_type") == kind) & F.col("period_date").isin([day for k, day in periods if k == kind]))
    stored = read_or_empty(spark, path, PERFORMANCE).filter(wanted)
    _write_periods(upsert_snapshot(stored, fresh.select(*PERFORMANCE.fieldNames())), path)


def _write_periods(rows: DataFrame, path: str) -> None:
    (rows.hint("rebalance", "period_type", "period_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("period_type", "period_date").parquet(path))


def seed_rows(stored: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows and the seeds whose key is missing."""
    return stored.unionByName(absent(seeds, stored, keys).select(*stored.columns))


def default_keywords(spark: SparkSession) -> DataFrame:
    rows = [(n, phrase, label, True) for n, (phrase, label) in enumerate(DEFAULT_KEYWORDS, start=1)]
    return spark.createDataFrame(rows, KEYWORDS)


def log_run(spark: SparkSession, path: str, *, run_id: str, started_at: datetime, finished_at: datetime,
            status: str, records: int, message: str | None = None, triggered_by: str = "auto") -> None:
    row = (run_id, started_at, finished_at, status, records, message, triggered_by)
    append(spark.createDataFrame([row], RUN_LOG), path)


def log_audit(spark: SparkSession, path: str, *, user_id: int | None, user_name: str | None, role: str | None,
              action: str, entity_type: str | None = None, entity_id: int | None = None,
              details: str | None = None, logged_at: datetime) -> None:
    row = (user_id, user_name, role, action, entity_type, entity_id, details, logged_at)
    append(spark.createDataFrame([row], AUDIT_LOG), path)
