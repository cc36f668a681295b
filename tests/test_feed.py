from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.jsontext import epoch_or_arrival, json_number, json_text, public_settings
from tallyloom.plans import messages as feed
from tallyloom.sources.tables import feed_of_records

AT = datetime(2024, 2, 1, 8, 30, 15, 500000)
PAYLOADS = "payload_id string, payload string, received_at timestamp"
ARRIVED = ("payload_id string, received_at timestamp, position bigint, channel_message_id string, "
           "channel_id string, customer_name string")


def delivery(*messages, contacts=()):
    return json.dumps({"entry": [{"changes": [{"value": {"contacts": list(contacts), "messages": list(messages)}}]}]},
                      ensure_ascii=False)


def flat(table, *payloads):
    frame = table(PAYLOADS, *[(f"p{n}", p, AT) for n, p in enumerate(payloads)])
    return feed.flatten_payloads(feed.parse_payloads(frame)).orderBy("payload_id", "position").collect()


@pytest.mark.parametrize("message, body", [
    ({"text": {"body": "hello"}, "button": {"text": "no"}}, "hello"),
    ({"text": {"body": ""}, "button": {"text": "yes"}}, "yes"),
    ({"interactive": {"z": 1, "a": 2}}, '{"z":1,"a":2}'),
    ({"interactive": None, "type": "image"}, "[image]"),
    ({"type": ""}, "[message]"),
    ({"text": "not an object", "type": "text"}, "[text]"),
])
def test_message_text(table, message, body):
    assert [r.body for r in flat(table, delivery(message))] == [body]


def test_contact_names(table):
    contacts = [{"wa_id": "1", "profile": {"name": "first"}}, {"wa_id": "1", "profile": {"name": "second"}},
                {"wa_id": "2", "profile": {"name": ""}}, {"wa_id": "3"}, {"wa_id": "", "profile": {"name": "nobody"}}]
    found = flat(table, delivery(*[{"from": c} for c in ("1", "2", "3", "4", "")], {"id": "x"}, contacts=contacts))
    assert [(r.channel_id, r.customer_name) for r in found] == [
        ("1", "second"), ("2", None), ("3", None), ("4", None), ("", None), (None, None)]


def test_order_and_source_are_kept(table):
    found = flat(table, json.dumps({"entry": [
        {"changes": [{"value": {"messages": [{"id": "a", "from": "1"}, {"id": "b"}]}}, {"value": {}}, {}]},
        {}, {"changes": [{"value": {"messages": [{"id": "c", "z": {"y": [1, 2]}}]}}]}]}))
    assert [r.channel_message_id for r in found] == ["a", "b", "c"]
    assert len({r.message_id for r in found}) == 3
    assert json.loads(found[2].raw) == {"id": "c", "z": {"y": [1, 2]}}
    assert {r.direction for r in found} == {"inbound"}


def test_broken_deliveries_are_set_aside_and_others_kept(table):
    good = delivery({"id": "ok"})
    partly = '{"entry":[{"changes":[{"value":{"messages":"oops"}},{"value":{"messages":[{"id":"kept"}]}}]}]}'
    frame = table(PAYLOADS, ("1", "{broken", AT), ("2", good, AT), ("3", None, AT), ("4", "[1,2]", AT), ("5", "{}", AT),
                  ("6", partly, AT))
    parsed = feed.parse_payloads(frame)
    assert {r.payload_id for r in feed.rejected_payloads(parsed).collect()} == {"1", "3", "4", "6"}
    ids = {r.channel_message_id for r in feed.flatten_payloads(parsed).collect()}
    assert "ok" in ids


@pytest.mark.parametrize("text, expected", [
    ("1700000000", datetime(2023, 11, 14, 22, 13, 20)), ("1700000000abc", datetime(2023, 11, 14, 22, 13, 20)),
    (" -5", datetime(1969, 12, 31, 23, 59, 55)), ("0", None), ("x", None), (None, None), ("9" * 30, None)])
def test_epoch(table, text, expected):
    frame = table("t string, at timestamp", (text, AT))
    assert frame.select(epoch_or_arrival(F.col("t"), F.col("at"))).first()[0] == (expected or AT.replace(microsecond=0))


def test_first_delivery_wins_and_unknown_ids_all_pass(table, rows):
    arrived = table(ARRIVED, ("p2", AT, 0, "a", "1", "late"), ("p1", AT, 1, "a", "1", "early"), ("p1", AT, 0, "b", "1", None),
                    ("p3", AT, 0, None, "1", None), ("p4", AT, 0, None, "1", None), ("p5", AT, 0, "c", "1", None))
    stored = table("channel_message_id string", ("c",), (None,))
    found = feed.new_messages(arrived, stored, feed.ARRIVAL)
    assert rows(found, "channel_message_id", "payload_id") == [(None, "p3"), (None, "p4"), ("a", "p1"), ("b", "p1")]


def test_customers_keep_a_name_when_none_is_given(table, rows):
    arrived = table(ARRIVED, ("p1", AT, 0, "a", "1", "old"), ("p2", AT, 0, "a", "1", "new"), ("p3", AT, 0, "b", "1", None),
                    ("p3", AT, 1, "c", "2", None), ("p3", AT, 2, "d", "3", None), ("p3", AT, 3, "e", None, "nobody"))
    changes = feed.customer_changes(arrived, feed.ARRIVAL)
    stored = table("channel_id string, name string", ("1", "stored"), ("2", "stays"), ("9", "away"))
    expected = [("1", "new"), ("2", "stays"), ("3", None), ("9", "away")]
    once = feed.upsert_customers(stored, changes)
    assert rows(once) == expected == rows(feed.upsert_customers(once, changes))
    log = stored.withColumn("name_at", F.when(F.col("name").isNotNull(), F.struct(
        F.lit(datetime(2020, 1, 1)).alias("received_at"), F.lit("").alias("payload_id"), F.lit(0).cast("bigint").alias("position"))))
    assert rows(feed.current_customers(log.unionByName(changes)), "channel_id", "name") == expected


def test_names_are_those_of_the_moment(table, rows):
    def at(second, micro=0):
        return datetime(2024, 1, 1, 0, 0, second, micro)

    arrived = table("message_id string, " + ARRIVED,
                    ("m1", "p1", at(1), 0, None, "1", None), ("m2", "p2", at(2), 0, None, "1", "A"),
                    ("m3", "p3", at(2, 5), 0, None, "1", None), ("m4", "p4", at(9), 0, None, "1", "B"),
                    ("m5", "p5", at(12), 0, None, "1", None), ("m6", "p6", at(12), 0, None, "2", None),
                    ("m7", "p7", at(12), 0, None, None, None))
    stored = table("channel_id string, name string", ("1", "S"),)
    events = arrived.filter("message_id <> 'm4' and channel_id is not null")
    assert rows(feed.names_on_arrival(events, arrived, stored), "message_id", "customer_name") == [
        ("m1", "S"), ("m2", "A"), ("m3", "A"), ("m5", "B"), ("m6", "2")]


def test_health(table):
    none = table("received_at timestamp")
    assert tuple(feed.feed_health(none).first()) == (None, "unknown", 0)
    assert tuple(feed.feed_health(table("received_at timestamp", (AT,))).first()) == (AT, "connected", 1)


def test_log_records_become_payloads(table, rows):
    records = table("topic string, partition int, offset bigint, value binary, timestamp timestamp", ("t", 1, 7, b"{}", AT))
    assert rows(feed_of_records(records)) == [("t/1/7", "{}", AT)]


def test_json_defaults(table):
    row = table("v string", ('{"a":"7x","b":7}',)).select(
        json_number(F.col("v"), "$.a"), json_number(F.col("v"), "$.b"), json_number(F.col("v"), "$.c", "int", 3),
        json_text(F.col("v"), "$.c", "none"), *public_settings(F.col("v"), "board")).first()
    assert tuple(row) == (None, 7, 3, "none", "board", "", 20, "[]")


def test_missing_direction_is_inbound(table, rows):
    frame = table("id int, direction string", (1, None), (2, "outbound"))
    assert rows(feed.with_direction(frame)) == [(1, "inbound"), (2, "outbound")]


def test_repeated_delivery_and_unknown_sender_on_arrival(table, rows):
    arrived = table("message_id string, payload_id string, received_at timestamp, position bigint, channel_id string, customer_name string",
                    ("a", "p", datetime(2024, 1, 1), 0, "c", "First"), ("a", "p", datetime(2024, 1, 1), 0, "c", "First"),
                    ("b", "q", datetime(2024, 1, 3, 5), 0, "c", None), ("d", "q", datetime(2024, 1, 3, 6), 1, None, None),
                    ("e", "r", datetime(2024, 1, 3, 6), 2, "other", None))
    stored = table("channel_id string, name string", ("other", "Kept"))
    assert rows(feed.names_on_arrival(arrived, arrived, stored), "message_id", "customer_name") == [
        ("a", "First"), ("b", "First"), ("d", None), ("e", "Kept")]
