"""The customer name at arrival as keyed state: one value per channel, kept by the stream itself.

The state of a channel is the last name it gave and when. A micro-batch brings a channel's rows to its processor in the order of
arrival; each row leaves with the name known by then. The log of customers is not read again, so the cost of a batch does not
depend on how many customers there are. State lives in RocksDB under the stream's checkpoint and survives restarts.

Rows of one channel in one batch are handled in one call; ``maxFilesPerTrigger`` of the source bounds them. They are read in
chunks, and only their order and names are held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.storagelevel import StorageLevel

from tallyloom import schemas
from tallyloom.operators.matching import assign_employees
from tallyloom.operators.scanning import find_phrases
from tallyloom.plans import messages as feed
from tallyloom.sources.idtable import new_by_table
from tallyloom.sources.sinks import write_batch
from tallyloom.streaming.ingest import FeedTables

_ORDER = ["received_us", "payload_id", "entry_no", "change_no", "message_no"]
_NO_TIME = -(1 << 62)
_STATE = T.StructType([T.StructField("name", T.StringType()), T.StructField("at", T.StringType())])
_REST_TYPE = "channel_message_id string, direction string, body string, sent_us bigint, raw string"
#: A row through the state: place in the order of arrival, the name given and the name known, and the rest of the message as JSON.
NAMED = T.StructType([T.StructField("channel_id", T.StringType()), T.StructField("message_id", T.StringType()),
                      *[T.StructField(n, T.LongType() if n == "received_us" else T.StringType() if n == "payload_id" else T.IntegerType())
                        for n in _ORDER], T.StructField("customer_name", T.StringType()), T.StructField("rest", T.StringType()),
                      T.StructField("seen_name", T.StringType())])


def _moment(row: Any) -> str:
    """The place of a row in the order of arrival, as text that sorts alike."""
    numbers = "/".join(f"{getattr(row, n):010d}" for n in _ORDER[2:])
    return f"{row.received_us - _NO_TIME:020d}/{row.payload_id}/{numbers}"


class LastName(StatefulProcessor):
    """Adds ``seen_name``: the last name given up to and with the row, else the channel id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        name, at = self._last.get() if self._last.exists() else (None, "")
        own = pd.concat(list(rows), ignore_index=True).sort_values(_ORDER, kind="stable")
        # Names carry forward over the rows; before the first one, the stored name holds.
        given = own["customer_name"].where(own["customer_name"].notna(), None)
        seen = given.ffill()
        seen = seen.where(seen.notna(), name if name is not None else key[0])
        named = own[given.notna()]
        if len(named):
            last = next(named.tail(1).itertuples())
            # A late batch does not put an older name in the place of a newer one.
            if _moment(last) >= at:
                self._last.update((last.customer_name, _moment(last)))
        yield own[NAMED.fieldNames()[:-1]].assign(seen_name=seen.astype(object))

    def close(self) -> None:
        pass


def names_at_arrival(messages: DataFrame) -> DataFrame:
    """Rows of a stream of flattened deliveries with ``seen_name``; without a sender there is no name and no state."""
    rest = F.to_json(F.struct("channel_message_id", "direction", "body", F.unix_micros(F.col("sent_at")).alias("sent_us"), "raw"))
    rows = messages.select(
        "channel_id", "message_id", F.coalesce(F.unix_micros(F.col("received_at")), F.lit(_NO_TIME)).alias("received_us"), "payload_id",
        *[F.col(f"position.{n}").alias(n) for n in _ORDER[2:]], "customer_name", rest.alias("rest"))
    named = rows.filter(F.col("channel_id").isNotNull()).groupBy("channel_id").transformWithStateInPandas(LastName(), NAMED, "append", "none")
    unknown = rows.filter(F.col("channel_id").isNull()).withColumn("seen_name", F.lit(None).cast("string"))
    both = named.unionByName(unknown).withColumn("rest", F.from_json("rest", _REST_TYPE))
    received = F.when(F.col("received_us") > _NO_TIME, F.timestamp_micros("received_us")).alias("received_at")
    return both.select("payload_id", received, F.struct(*_ORDER[2:]).alias("position"), "message_id", "rest.channel_message_id", "channel_id",
                       "customer_name", F.lit(None).cast("bigint").alias("employee_id"), "rest.direction", "rest.body",
                       F.timestamp_micros("rest.sent_us").alias("sent_at"), "rest.raw", "seen_name")


def ingest_named_batch(rows: DataFrame, batch_id: int, tables: FeedTables, keywords: DataFrame, names: DataFrame | None = None) -> None:
    """Store one batch of messages that carry the name they were seen with. No stored message or customer is read, only id buckets."""
    arrived = feed.once_per_delivery(rows).persist(StorageLevel.MEMORY_AND_DISK)
    ids = tables.message_ids(rows.sparkSession)
    fresh = new_by_table(arrived, "channel_message_id", feed.ARRIVAL, ids, batch_id)
    if names is not None:
        fresh = assign_employees(fresh, "message_id", "body", names)
    fresh = fresh.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        columns = lambda frame, schema: frame.select(*[f for f in schema.fieldNames() if f != "batch_id"])
        write_batch(columns(fresh, schemas.MESSAGES), tables.messages, batch_id)
        ids.add(fresh.select("channel_message_id"), batch_id)
        write_batch(feed.customer_changes(arrived, feed.ARRIVAL), tables.customers, batch_id)
        hits = find_phrases(fresh, "message_id", "body", keywords, keep=("channel_id", "employee_id", "body", "sent_at", "seen_name"))
        notes = hits.withColumnsRenamed({"seen_name": "customer_name", "body": "message_text", "sent_at": "message_at"})
        write_batch(columns(notes, schemas.NOTES), tables.notes, batch_id)
        write_batch(feed.feed_health(fresh), tables.health, batch_id)
    finally:
        for held in (fresh, arrived):
            held.unpersist()


def start_stateful_ingest(payloads: DataFrame, tables: FeedTables, read_keywords: Callable[[], DataFrame],
                          read_names: Callable[[], DataFrame] | None = None, *, checkpoint: str, **trigger) -> list[StreamingQuery]:
    """The feed with names kept as state: a query for the messages and one for what cannot be read; both have their folder in ``checkpoint``."""
    parsed = feed.parse_payloads(payloads)

    def store(batch: DataFrame, batch_id: int) -> None:
        ingest_named_batch(batch, batch_id, tables, read_keywords(), read_names() if read_names else None)

    def store_rejects(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, tables.rejects, batch_id)

    when = trigger or {"availableNow": True}
    messages = names_at_arrival(feed.flatten_payloads(parsed)).writeStream.foreachBatch(store)
    rejects = feed.rejected_payloads(parsed).writeStream.foreachBatch(store_rejects)
    return [query.option("checkpointLocation", f"{checkpoint}/{part}").trigger(**when).start()
            for part, query in (("messages", messages), ("rejects", rejects))]
