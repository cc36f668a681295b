"""The chat feed as a stream: deliveries in; messages, customers, notes, rejects and health out.

A micro-batch is written to one folder per table, ``<table>/batch_id=<n>``, and reads stored rows of earlier
batches only. A batch that failed half way is run again by Spark with the same input and number, sees the
same stored rows and replaces the same folders, so every table holds each batch once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from tallyloom import schemas
from tallyloom.operators.matching import assign_employees
from tallyloom.operators.scanning import find_phrases
from tallyloom.plans import messages as feed
from tallyloom.sources.idtable import IdTable, new_by_table
from tallyloom.sources.sinks import write_batch
from tallyloom.sources.tables import read_or_empty


@dataclass(frozen=True)
class FeedTables:
    """Where the stream keeps its tables."""

    root: str

    @property
    def messages(self) -> str:
        return f"{self.root}/messages"

    @property
    def customers(self) -> str:
        return f"{self.root}/customers"

    @property
    def notes(self) -> str:
        return f"{self.root}/notes"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"

    @property
    def health(self) -> str:
        return f"{self.root}/health"

    def message_ids(self, spark: SparkSession) -> IdTable:
        return IdTable(spark, f"{self.root}/message_ids")


def _columns(rows: DataFrame, schema) -> DataFrame:
    return rows.select(*[f for f in schema.fieldNames() if f != "batch_id"])


def _before(spark: SparkSession, path: str, schema, batch_id: int) -> DataFrame:
    return read_or_empty(spark, path, schema).filter(F.col("batch_id") < batch_id)


def notes_of(fresh: DataFrame, arrived: DataFrame, stored_customers: DataFrame, keywords: DataFrame,
             **limits) -> DataFrame:
    """Notes of new messages, with the customer name as it was when each message arrived."""
    hits = find_phrases(fresh, "message_id", "body", keywords,
                        keep=("channel_id", "employee_id", "body", "sent_at", "received_at"), **limits)
    noted = hits.select("message_id", "channel_id", "received_at").distinct()
    names = feed.names_on_arrival(noted, arrived, stored_customers)
    return hits.join(names, "message_id", "left").select(
        "message_id", "channel_id", "employee_id", "customer_name", F.col("body").alias("message_text"),
        F.col("sent_at").alias("message_at"), "keyword_id", "matched_phrase", "label")


def ingest_batch(payloads: DataFrame, batch_id: int, tables: FeedTables, keywords: DataFrame,
                 names: DataFrame | None = None) -> None:
    """Store one batch of deliveries. With ``names``, messages get an employee from their text."""
    spark = payloads.sparkSession
    parsed = feed.parse_payloads(payloads).persist(StorageLevel.MEMORY_AND_DISK)
    arrived = feed.once_per_delivery(feed.flatten_payloads(parsed)).persist(StorageLevel.MEMORY_AND_DISK)
    ids = tables.message_ids(spark)
    fresh = new_by_table(arrived, "channel_message_id", feed.ARRIVAL, ids, batch_id)
    if names is not None:
        fresh = assign_employees(fresh, "message_id", "body", names)
    fresh = fresh.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        write_batch(feed.rejected_payloads(parsed), tables.rejects, batch_id)
        write_batch(_columns(fresh, schemas.MESSAGES), tables.messages, batch_id)
        ids.add(fresh.select("channel_message_id"), batch_id)
        write_batch(feed.customer_changes(arrived, feed.ARRIVAL), tables.customers, batch_id)
        writers = arrived.filter(F.col("channel_id").isNotNull()).select("channel_id")
        log = _before(spark, tables.customers, schemas.CUSTOMER_CHANGES, batch_id)
        customers = feed.current_customers(log.join(writers, "channel_id", "left_semi"))
        write_batch(_columns(notes_of(fresh, arrived, customers, keywords), schemas.NOTES), tables.notes, batch_id)
        write_batch(feed.feed_health(fresh), tables.health, batch_id)
    finally:
        for held in (fresh, arrived, parsed):
            held.unpersist()


def start_ingest(payloads: DataFrame, tables: FeedTables, read_keywords: Callable[[], DataFrame],
                 read_names: Callable[[], DataFrame] | None = None, *, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream; ``checkpoint`` is a folder that the whole cluster reaches.

    Rules are read again for every batch, so an edit applies to new messages only.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, tables, read_keywords(), read_names() if read_names else None)

    return (payloads.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def unique_within(messages: DataFrame, delay: str) -> DataFrame:
    """Streaming alternative with bounded state: repeats are dropped when they come within ``delay``.

    Use it only where deliveries are known not to repeat later than that; the default compares with all
    stored ids. Messages without an id all pass.
    """
    known = messages.filter(F.col("channel_message_id").isNotNull()).withWatermark("received_at", delay)
    unknown = messages.filter(F.col("channel_message_id").isNull()).withWatermark("received_at", delay)
    return known.dropDuplicatesWithinWatermark(["channel_message_id"]).unionByName(unknown)


def compact_customers(spark: SparkSession, tables: FeedTables, target: str) -> None:
    """Write the customer log with one row per customer to a new folder, for a restart from there."""
    log = read_or_empty(spark, tables.customers, schemas.CUSTOMER_CHANGES)
    merged = feed.current_customers(log).withColumn("batch_id", F.lit(-1).cast("bigint"))
    merged.write.mode("overwrite").partitionBy("batch_id").parquet(target)


def current_health(health: DataFrame) -> DataFrame:
    """Health over all batches."""
    last = F.max("last_event_at")
    return health.agg(last.alias("last_event_at"),
                      F.when(last.isNotNull(), "connected").otherwise("unknown").alias("connection_status"),
                      F.sum("new_messages").alias("new_messages"))
