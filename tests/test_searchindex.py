"""The search index returns what a scan returns, for any pattern, and opens few files."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.plans.quality import filter_notes
from tallyloom.sources.searchindex import SearchIndex, literal_parts

NOTES = "id bigint, customer_name string, message_text string"


@pytest.fixture
def notes(table):
    dice = random.Random(6)
    words = ["Account", "ACCOUNTS", "50%", "a_b", "über", "ÜBER", "İstanbul", "ab", "x", "back\\slash", "حساب", "کتاب"]
    text = lambda n: " ".join(dice.choices(words, k=n))
    rows = [(n, dice.choice([None, "", text(1), text(2)]), dice.choice([None, "", text(dice.randint(1, 6))])) for n in range(80)]
    return table(NOTES, *rows)


@pytest.fixture
def index(spark, notes, tmp_path):
    found = SearchIndex(spark, str(tmp_path / "index"), buckets=16)
    found.add(notes.filter("id < 50"), 0)
    for _ in range(2):  # a retried batch replaces itself
        found.add(notes.filter("id >= 50"), 1)
    return found


@pytest.mark.parametrize("search", ["account", "ACCOUNT", "count ab", "cou%ab", "acc_unt", "50\\%", "a\\_b", "back\\\\sl", "ÜBER", "über x", "İst", "حساب",
                                    "ab", "x", "", "%", "__", "zzz", "unt%50\\%%x", "ab%cd%ef"])
def test_the_same_notes_as_a_scan(notes, index, rows, search):
    assert rows(index.search(notes, search)) == rows(filter_notes(notes, search=search))


def test_parts_between_wildcards():
    assert literal_parts("ab%c_d\\%e\\_\\\\") == ["ab", "c", "d%e_\\"]
    assert literal_parts("%_") == [] and literal_parts("") == []


def test_only_the_buckets_of_the_pieces_are_opened(index):
    pieces = index.pieces("accou")
    assert pieces == ["acc", "cco", "cou"]
    read = index.postings(pieces)
    opened = {r[0].split("gram_bucket=")[1].split("/")[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert 1 <= len(opened) <= 3
    assert "gram_bucket" in read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_a_run_log_row_for_each_batch(spark, tmp_path, table, rows):
    from tallyloom.sources.tables import feed_envelopes
    from tallyloom.streaming.ingest import FeedTables, start_ingest
    from tallyloom.streaming.runlog import RunLog, logged_runs, observed
    from tests.test_stream import FIRST, KEYWORDS, SECOND, land

    path, landed, keywords = str(tmp_path / "log"), tmp_path / "in", table(KEYWORDS, (1, "account", "transfer", True))

    def run(read_keywords):
        payloads = observed(feed_envelopes(spark, str(landed), streaming=True))
        return start_ingest(payloads, FeedTables(str(tmp_path / "out")), read_keywords, checkpoint=str(tmp_path / "cp"))

    def broken():
        raise ValueError("no rules today")

    listener = RunLog(spark, path)
    spark.streams.addListener(listener)
    try:
        land(landed, "a", *FIRST)
        run(lambda: keywords).awaitTermination()
        land(landed, "b", *SECOND, at=100)
        with pytest.raises(Exception, match="no rules today"):
            run(broken).awaitTermination()
        run(lambda: keywords).awaitTermination()  # the failed batch again
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(listener)
    found = logged_runs(spark, path)
    assert rows(found, "status", "records_synced") == [("error", 0), ("success", len(SECOND)), ("success", len(FIRST))]
    (message,) = (r.message for r in found.filter("status = 'error'").collect())
    assert "no rules today" in message
    batches = [r.run_id.split("/")[1] for r in found.filter("status = 'success'").collect()]
    assert sorted(batches) == ["0", "1"] and json.dumps(batches)
