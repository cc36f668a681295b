"""Chat feed: JSON deliveries to message rows, unique messages, current customers, feed health.

Every function takes a batch or a streaming-batch DataFrame; the stream runs the same code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.jsontext import epoch_or_arrival
from tallyloom.functions.text import none_if_empty
from tallyloom.operators.keyed import first_per_key, new_rows
from tallyloom.schemas import CHAT_MESSAGE, PAYLOAD

ARRIVAL = ["received_at", "payload_id", "position"]


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Deliveries with their JSON parsed; ``payloads`` needs payload_id, payload and received_at.

    A delivery without an id is named by its content.
    """
    known = F.coalesce("payload_id", F.sha2(F.coalesce("payload", F.lit("")), 256))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}
    return payloads.withColumns({"payload_id": known, "doc": F.from_json("payload", PAYLOAD, options)})


def rejected_payloads(parsed: DataFrame) -> DataFrame:
    """Deliveries that are not, or not wholly, of the expected form. What could be read is still used."""
    missing = F.col("payload").isNull() | F.col("doc").isNull()
    return (parsed.filter(missing | F.col("doc.malformed").isNotNull())
            .select("payload_id", "payload", F.when(missing, "no document").otherwise("malformed").alias("reason"),
                    "received_at"))


def _message_text(m: str) -> Column:
    """First non-empty of the text, the button and the interactive part; else the kind in brackets."""
    kind = F.coalesce(none_if_empty(F.col(f"{m}.type")), F.lit("message"))
    return F.coalesce(none_if_empty(F.col(f"{m}.text.body")), none_if_empty(F.col(f"{m}.button.text")),
                      none_if_empty(F.col(f"{m}.interactive")), F.concat(F.lit("["), kind, F.lit("]")))


def _contact_name(contacts: Column, channel_id: Column) -> Column:
    """Name of the last contact with the sender's id."""
    same = F.filter(contacts, lambda c: (c["wa_id"] != "") & (c["wa_id"] == channel_id))
    return none_if_empty(F.get(same, F.size(same) - 1)["profile"]["name"])


def _each(array: str, position: str, element: str) -> Column:
    """Elements with their positions.

    The array is unfolded as an expression: for a plain column Spark would first filter on its size,
    and that filter would parse the JSON once more.
    """
    return F.posexplode(F.concat(array)).alias(position, element)


def flatten_payloads(parsed: DataFrame) -> DataFrame:
    """One row per message of every delivery, in the order of arrival, with its own JSON kept as text."""
    delivery = ["payload_id", "received_at"]
    entries = parsed.select(*delivery, _each("doc.entry", "entry_no", "entry"))
    changes = entries.select(*delivery, "entry_no", _each("entry.changes", "change_no", "change"))
    elements = changes.select(*delivery, "entry_no", "change_no", F.col("change.value.contacts").alias("contacts"),
                              _each("change.value.messages", "message_no", "raw"))
    numbers = ["entry_no", "change_no", "message_no"]
    parsed_messages = elements.select(
        "payload_id", "received_at", F.struct(*numbers).alias("position"), *numbers, "contacts", "raw",
        F.from_json("raw", CHAT_MESSAGE).alias("m"))
    sender = F.col("m.from")
    return parsed_messages.select(
        "payload_id", "received_at", "position",
        F.concat_ws("/", "payload_id", *numbers).alias("message_id"),
        F.col("m.id").alias("channel_message_id"), sender.alias("channel_id"),
        _contact_name(F.col("contacts"), sender).alias("customer_name"),
        F.lit(None).cast("bigint").alias("employee_id"), F.lit("inbound").alias("direction"),
        _message_text("m").alias("body"), epoch_or_arrival(F.col("m.timestamp"), F.col("received_at")).alias("sent_at"),
        "raw")


def once_per_delivery(messages: DataFrame) -> DataFrame:
    """Messages of deliveries that a collector sent again are left out: the first of each message_id stays."""
    return first_per_key(messages, ["message_id"], ["received_at"])


def with_direction(messages: DataFrame) -> DataFrame:
    return messages.withColumn("direction", F.coalesce("direction", F.lit("inbound")))


def new_messages(arrived: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """First delivery of each message that is not stored yet; messages without an id all pass."""
    return new_rows(arrived, stored, "channel_message_id", order)


def customer_changes(arrived: DataFrame, order: list[str]) -> DataFrame:
    """One row per customer that wrote, with the last name given and when. Repeated deliveries count."""
    named = F.when(F.col("customer_name").isNotNull(), F.struct(*order))
    return (arrived.filter(F.col("channel_id").isNotNull()).groupBy("channel_id")
            .agg(F.max_by("customer_name", named).alias("name"), F.max(named).alias("name_at")))


def upsert_customers(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Customers after a batch: new ones added, names replaced where a new name was given."""
    fresh = changes.select("channel_id", F.col("name").alias("new_name"))
    both = stored.select("channel_id", "name").join(fresh, "channel_id", "full")
    return both.select("channel_id", F.coalesce("new_name", "name").alias("name"))


def current_customers(log: DataFrame) -> DataFrame:
    """Customers from the log of changes: the last name per customer. The log is its own compaction."""
    return log.groupBy("channel_id").agg(F.max_by("name", "name_at").alias("name"),
                                         F.max("name_at").alias("name_at"))


def feed_health(messages: DataFrame, arrived_at: str = "received_at") -> DataFrame:
    """When the last new message came and whether the feed has ever delivered one."""
    last = F.max(arrived_at)
    return messages.agg(last.alias("last_event_at"),
                        F.when(last.isNotNull(), "connected").otherwise("unknown").alias("connection_status"),
                        F.count("*").alias("new_messages"))


def names_on_arrival(events: DataFrame, arrived: DataFrame, stored: DataFrame) -> DataFrame:
    """message_id and the customer name each event saw when it arrived, one row per message_id.

    That is the last name its customer gave up to and with the event, else the stored one, else the
    channel id; an event without a sender has no name. ``events`` are some of the ``arrived`` rows. Names are carried
    forward from day to day, from second to second of a day and within a second, so that one busy customer
    is many small window groups.
    """
    day, second = F.date_trunc("day", F.col("received_at")).alias("day"), F.date_trunc("second", F.col("received_at")).alias("second")
    order = F.struct(*ARRIVAL)
    known_events = events.filter(F.col("channel_id").isNotNull())
    wanted = known_events.select("channel_id", day, second).distinct()
    per_second = (arrived.filter(F.col("customer_name").isNotNull() & F.col("channel_id").isNotNull())
                  .groupBy("channel_id", day, second).agg(F.max_by("customer_name", order).alias("given")))
    steps = (per_second.unionByName(wanted.withColumn("given", F.lit(None).cast("string")))
             .groupBy("channel_id", "day", "second").agg(F.max("given").alias("given")))

    def carried(rows: DataFrame, keys: list[str], step: str, name: str) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(*keys, step, F.last("given", ignorenulls=True).over(before).alias(name))

    last = F.max_by("given", F.when(F.col("given").isNotNull(), F.col("second"))).alias("given")
    days = carried(steps.groupBy("channel_id", "day").agg(last), ["channel_id"], "day", "before_day")
    seconds = carried(steps, ["channel_id", "day"], "second", "in_day")

    within = (Window.partitionBy("channel_id", "second").orderBy(*ARRIVAL)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = (arrived.withColumns({"day": day, "second": second}).join(wanted, ["channel_id", "day", "second"], "left_semi")
            .select("message_id", "channel_id", "day", "second", *ARRIVAL, F.last("customer_name", ignorenulls=True).over(within).alias("given")))
    seen = seen.groupBy("message_id").agg(F.min(F.struct(*ARRIVAL, "channel_id", "day", "second", "given")).alias("s")).select("message_id", "s.*")
    known = stored.select("channel_id", F.col("name").alias("stored_name"))
    found = (known_events.select("message_id").distinct().join(seen, "message_id")
             .join(seconds, ["channel_id", "day", "second"], "left").join(days, ["channel_id", "day"], "left")
             .join(known, "channel_id", "left")
             .select("message_id", F.coalesce("given", "in_day", "before_day", "stored_name", "channel_id").alias("customer_name")))
    unknown = events.filter(F.col("channel_id").isNull()).select("message_id", F.lit(None).cast("string").alias("customer_name")).distinct()
    return found.unionByName(unknown)
