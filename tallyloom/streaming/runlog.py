"""The run log of streams: one row per batch, failed ones included, from the progress Spark reports.

Counts are observed while the batch runs. A row is named after the query and the batch, so a batch that a restart reports again is the
same row, and ``logged_runs`` shows it once.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tallyloom import schemas
from tallyloom.sources.sinks import log_run
from tallyloom.sources.tables import read_or_empty

OBSERVED = "deliveries"


def observed(payloads: DataFrame) -> DataFrame:
    """A stream whose rows are counted for the run log."""
    return payloads.observe(OBSERVED, F.count("*").alias("n_rows"))


class RunLog(StreamingQueryListener):
    """Appends to the run log under ``path``; add it with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, path: str, triggered_by: str = "stream"):
        self._spark, self._path, self._by = spark, path, triggered_by

    def _row(self, run_id: str, started: datetime, finished: datetime, status: str, records: int, message: str | None = None) -> None:
        log_run(self._spark, self._path, run_id=run_id, started_at=started, finished_at=finished, status=status, records=records, message=message,
                triggered_by=self._by)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        if OBSERVED not in progress.observedMetrics and not progress.numInputRows:
            return
        counted = progress.observedMetrics.get(OBSERVED)
        started = datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None)
        took = timedelta(milliseconds=progress.durationMs.get("triggerExecution", 0))
        records = counted["n_rows"] if counted is not None else progress.numInputRows
        self._row(f"{progress.id}/{progress.batchId}", started, started + took, "success", records)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            now = datetime.now(timezone.utc).replace(tzinfo=None)
            self._row(f"{event.id}/{event.runId}", now, now, "error", 0, event.exception)


def logged_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run log with one row per run: the last one written."""
    rows = read_or_empty(spark, path, schemas.RUN_LOG)
    rest = [c for c in schemas.RUN_LOG.fieldNames() if c not in ("run_id", "finished_at")]
    last = rows.groupBy("run_id").agg(F.max(F.struct("finished_at", *rest)).alias("r"))
    return last.select("run_id", *[F.col(f"r.{c}").alias(c) for c in schemas.RUN_LOG.fieldNames() if c != "run_id"])
