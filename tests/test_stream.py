"""The stream over landed files: equal to one batch, unchanged by repeats and by a retried batch."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.catalog import Tables, _payloads
from tallyloom.plans.quality import scan_messages
from tallyloom.sources.tables import feed_documents, feed_envelopes
from tallyloom.streaming.ingest import (
    FeedTables,
    compact_customers,
    current_health,
    ingest_batch,
    start_ingest,
    unique_within,
)

START = datetime(2024, 1, 1)
KEYWORDS = "id bigint, phrase string, label string, is_active boolean"
PEOPLE = "id bigint, full_name string, external_ref string, is_active boolean"


def delivery(message_id, sender, text, name=None):
    message = {"from": sender, "timestamp": "1700000000", "type": "text", "text": {"body": text}}
    if message_id:
        message["id"] = message_id
    contacts = [{"wa_id": sender, "profile": {"name": name}}] if name else []
    return json.dumps({"entry": [{"changes": [{"value": {"contacts": contacts, "messages": [message]}}]}]})


def land(folder, name, *payloads, at=0):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"payload_id": f"{name}-{n}", "received_at": (START + timedelta(seconds=at + n)).isoformat(),
                         "payload": p}) for n, p in enumerate(payloads)]
    (folder / f"{name}.json").write_text("\n".join(lines))


FIRST = [delivery("m1", "c1", "send the account", "Ann"), delivery("m2", "c1", "hello", "Anna"),
         delivery("m1", "c1", "send the account"), delivery(None, "c2", "the account"), "{broken"]
SECOND = [delivery("m1", "c1", "send the account", "Annie"), delivery("m3", "c1", "account by Sara Omar"),
          delivery(None, "c2", "the account")]


@pytest.fixture
def keywords(table):
    return table(KEYWORDS, (1, "account", "transfer", True), (2, "hello", "greeting", True))


def read(spark, tables, what, schema):
    return spark.read.schema(schema).parquet(getattr(tables, what))


def state(spark, tables, rows):
    return {
        "messages": rows(read(spark, tables, "messages", schemas.MESSAGES), "channel_message_id", "channel_id", "body"),
        "notes": rows(read(spark, tables, "notes", schemas.NOTES), "customer_name", "message_text", "keyword_id"),
        "rejects": rows(read(spark, tables, "rejects", schemas.REJECTS), "payload"),
        "customers": rows(read(spark, tables, "customers", schemas.CUSTOMER_CHANGES).groupBy("channel_id").agg(
            F.max_by("name", "name_at"))),
        "health": rows(current_health(read(spark, tables, "health", schemas.FEED_HEALTH)), "connection_status", "new_messages"),
    }


def run(spark, landed, tables, keywords, checkpoint, names=None):
    query = start_ingest(feed_envelopes(spark, str(landed), streaming=True), tables, lambda: keywords,
                         (lambda: names) if names is not None else None, checkpoint=str(checkpoint))
    query.awaitTermination()


EXPECTED = {
    "messages": [(None, "c2", "the account"), (None, "c2", "the account"), ("m1", "c1", "send the account"),
                 ("m2", "c1", "hello"), ("m3", "c1", "account by Sara Omar")],
    "notes": [("Ann", "send the account", 1), ("Anna", "hello", 2), ("Annie", "account by Sara Omar", 1),
              ("c2", "the account", 1), ("c2", "the account", 1)],
    "rejects": [("{broken",)],
    "customers": [("c1", "Annie"), ("c2", None)],
    "health": [("connected", 5)],
}


def test_two_batches_equal_one(spark, keywords, tmp_path, rows):
    landed, streamed = tmp_path / "in", FeedTables(str(tmp_path / "streamed"))
    land(landed, "a", *FIRST)
    run(spark, landed, streamed, keywords, tmp_path / "cp")
    land(landed, "b", *SECOND, at=100)
    run(spark, landed, streamed, keywords, tmp_path / "cp")
    assert state(spark, streamed, rows) == EXPECTED

    batch = FeedTables(str(tmp_path / "batch"))
    ingest_batch(feed_envelopes(spark, str(landed)), 0, batch, keywords)
    assert state(spark, batch, rows) == EXPECTED

    # Nothing new has landed: another run changes nothing.
    run(spark, landed, streamed, keywords, tmp_path / "cp")
    assert state(spark, streamed, rows) == EXPECTED


def test_a_retried_batch_replaces_itself(spark, keywords, tmp_path, rows):
    tables = FeedTables(str(tmp_path / "out"))
    for name, payloads, at in (("a", FIRST, 0), ("b", SECOND, 100)):
        land(tmp_path / name, name, *payloads, at=at)
    ingest_batch(feed_envelopes(spark, str(tmp_path / "a")), 0, tables, keywords)
    for _ in range(3):
        ingest_batch(feed_envelopes(spark, str(tmp_path / "b")), 1, tables, keywords)
    assert state(spark, tables, rows) == EXPECTED


def test_rule_edits_apply_to_new_messages_only(spark, table, keywords, tmp_path, rows):
    tables = FeedTables(str(tmp_path / "out"))
    land(tmp_path / "a", "a", *FIRST)
    land(tmp_path / "b", "b", *SECOND, at=100)
    ingest_batch(feed_envelopes(spark, str(tmp_path / "a")), 0, tables, keywords)
    ingest_batch(feed_envelopes(spark, str(tmp_path / "b")), 1, tables, table(KEYWORDS, (9, "sara", "name", True)))
    notes = read(spark, tables, "notes", schemas.NOTES)
    assert rows(notes, "batch_id", "keyword_id") == [(0, 1), (0, 1), (0, 2), (1, 9)]


def test_employees_by_name_on_request(spark, table, keywords, tmp_path, rows):
    from tallyloom.operators.matching import employee_names

    tables = FeedTables(str(tmp_path / "out"))
    land(tmp_path / "b", "b", *SECOND)
    names = employee_names(table(PEOPLE, (5, "Sara Omar", None, True)))
    ingest_batch(feed_envelopes(spark, str(tmp_path / "b")), 0, tables, keywords, names)
    notes = read(spark, tables, "notes", schemas.NOTES)
    assert rows(notes.filter("employee_id = 5"), "message_text") == [("account by Sara Omar",)]


def test_compacted_customers_are_the_same(spark, keywords, tmp_path, rows):
    tables = FeedTables(str(tmp_path / "out"))
    for n, payloads in enumerate((FIRST, SECOND)):
        land(tmp_path / str(n), f"f{n}", *payloads, at=100 * n)
        ingest_batch(feed_envelopes(spark, str(tmp_path / str(n))), n, tables, keywords)
    compact_customers(spark, tables, str(tmp_path / "compact"))
    compacted = spark.read.schema(schemas.CUSTOMER_CHANGES).parquet(str(tmp_path / "compact"))
    assert rows(compacted, "channel_id", "name", "batch_id") == [("c1", "Annie", -1), ("c2", None, -1)]


def test_documents_as_files(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"entry":\n []}')
    (tmp_path / "two.json").write_text("{}")
    found = feed_documents(spark, str(tmp_path)).collect()
    assert sorted(r.payload for r in found) == ['{"entry":\n []}', "{}"]
    assert len({r.payload_id for r in found}) == 2 and all(r.received_at for r in found)


def test_bounded_dedup_passes_messages_without_id(spark, tmp_path, rows):
    schema = "channel_message_id string, received_at timestamp"
    (tmp_path / "in").mkdir()
    lines = [{"channel_message_id": i, "received_at": START.isoformat()} for i in ("a", "a", "b", None, None)]
    (tmp_path / "in" / "x.json").write_text("\n".join(json.dumps(line) for line in lines))
    stream = unique_within(spark.readStream.schema(schema).json(str(tmp_path / "in")), "1 hour")
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "channel_message_id") == [(None,), (None,), ("a",), ("b",)]


def test_sample_feed_equals_the_batch_scan(spark, tmp_path, rows):
    t = Tables(spark, "/root/testdata/sf0.001")
    tables = FeedTables(str(tmp_path / "out"))
    _payloads(t).write.json(str(tmp_path / "in"))
    query = start_ingest(feed_envelopes(spark, str(tmp_path / "in"), streaming=True), tables, lambda: t.keywords,
                         checkpoint=str(tmp_path / "cp"))
    query.awaitTermination()
    notes = read(spark, tables, "notes", schemas.NOTES)
    batch = scan_messages(t.messages, t.channel_customers, t.keywords)
    columns = ["customer_name", "message_text", "message_at", "keyword_id", "matched_phrase", "label"]
    assert rows(notes, *columns) == rows(batch, *columns)
    assert batch.count() > 0
