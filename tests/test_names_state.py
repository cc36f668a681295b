"""Names at arrival kept as state: equal to the batch result, with repeats, replays, late rows and a restart."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from tallyloom.plans import messages as feed
from tallyloom.sources.tables import feed_envelopes
from tallyloom.streaming.ingest import FeedTables
from tallyloom.streaming.names import names_at_arrival, start_stateful_ingest
from tests.test_stream import EXPECTED, KEYWORDS, delivery, land, state
from tests.test_stream import FIRST as FEED_FIRST
from tests.test_stream import SECOND as FEED_SECOND

FIRST = [delivery("m1", "c1", "a", "Ann"), delivery("m2", "c1", "b"), delivery("m3", "c2", "c"), delivery("m4", "c1", "d", "Anna"),
         delivery("m2", "c1", "b"), "{broken", delivery("m9", None, "no sender", "Nobody")]
SECOND = [delivery("m5", "c1", "e"), delivery("m1", "c1", "a", "Annie"), delivery("m6", "c2", "f", "Cy"), delivery("m7", "c1", "g")]
LATE = [delivery("m8", "c1", "h", "Old"), delivery("m10", "c1", "i")]


def flat(spark, landed, streaming):
    return feed.flatten_payloads(feed.parse_payloads(feed_envelopes(spark, str(landed), streaming=streaming)))


def run(spark, landed, out, checkpoint):
    query = (names_at_arrival(flat(spark, landed, True)).writeStream
             .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch_id={n}"))
             .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start())
    query.awaitTermination()


def stored(spark, out, rows):
    return rows(spark.read.parquet(str(out)), "message_id", "seen_name")


def test_stream_equals_batch_over_restarts(spark, tmp_path, rows):
    landed, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    for name, payloads, at in (("a", FIRST, 0), ("b", SECOND, 100)):
        land(landed, name, *payloads, at=at)
        run(spark, landed, out, checkpoint)  # each run is a new query that goes on from the checkpoint
    arrived = flat(spark, landed, False)
    none = spark.createDataFrame([], "channel_id string, name string")
    assert stored(spark, out, rows) == rows(feed.names_on_arrival(arrived, arrived, none), "message_id", "customer_name")
    # A replayed batch without new files changes nothing.
    before = stored(spark, out, rows)
    run(spark, landed, out, checkpoint)
    assert stored(spark, out, rows) == before


def test_a_late_batch_is_named_and_does_not_win(spark, tmp_path):
    landed, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    for name, payloads, at in (("a", FIRST, 0), ("late", LATE, -1000), ("b", SECOND[:1], 100)):
        land(landed, name, *payloads, at=at)
        run(spark, landed, out, checkpoint)
    seen = {r.message_id.split("/")[0]: r.seen_name for r in spark.read.parquet(str(out)).collect()}
    assert (seen["late-0"], seen["late-1"], seen["b-0"]) == ("Old", "Old", "Anna")


def test_many_channels_in_one_batch(spark, tmp_path, rows):
    landed = tmp_path / "in"
    landed.mkdir()
    start = datetime(2024, 1, 1)
    for part in range(3):
        lines = [json.dumps({"payload_id": f"p{part}-{n}", "received_at": (start + timedelta(seconds=part * 1000 + n)).isoformat(),
                             "payload": delivery(f"m{part}-{n}", f"c{n % 17}", "x", f"N{part}-{n}" if n % 5 == part else None)}) for n in range(200)]
        (landed / f"{part}.json").write_text("\n".join(lines))
        run(spark, landed, tmp_path / "out", tmp_path / "cp")
    arrived = flat(spark, landed, False)
    none = spark.createDataFrame([], "channel_id string, name string")
    assert stored(spark, tmp_path / "out", rows) == rows(feed.names_on_arrival(arrived, arrived, none), "message_id", "customer_name")


def test_ingest_with_state_equals_the_ingest_without(spark, table, tmp_path, rows):
    keywords = table(KEYWORDS, (1, "account", "transfer", True), (2, "hello", "greeting", True))
    landed, tables = tmp_path / "in", FeedTables(str(tmp_path / "out"))
    for name, payloads, at in (("a", FEED_FIRST, 0), ("b", FEED_SECOND, 100), (None, (), 0)):
        if name:
            land(landed, name, *payloads, at=at)
        for query in start_stateful_ingest(feed_envelopes(spark, str(landed), streaming=True), tables, lambda: keywords, checkpoint=str(tmp_path / "cp")):
            query.awaitTermination()
        if name != "a":
            assert state(spark, tables, rows) == EXPECTED


def test_the_plan_keeps_state_per_channel(spark, tmp_path):
    (tmp_path / "in").mkdir()
    frame = names_at_arrival(flat(spark, tmp_path / "in", True))
    assert frame.isStreaming and "TransformWithState" in frame._jdf.queryExecution().analyzed().toString()
    assert frame.columns == [*flat(spark, tmp_path / "in", False).columns, "seen_name"]
