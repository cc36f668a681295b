from __future__ import annotations

import gzip
import hashlib

import pytest

from tallyloom.llm import warc

PAGES = "page_id long, url string, html string, payload int, record_type string"
BIG = "x" * 100


def _rows(frame):
    return sorted(map(str, (tuple(r) for r in frame.select("page_id", "payload_bytes", "record_type", "refers_to").collect())))


def test_round_trip_and_revisits(table):
    pages = table(PAGES, (7, "http://a/\r\nX: 1", BIG, 1, "c"), (3, None, BIG, 1, "c"), (3, "u", BIG, 1, "c"), (None, "u", BIG, 1, "c"),
                  (1, "u", "small", 1, "c"), (2, "u", "small", 1, "c"), (4, "u", None, 1, "c"), (5, "u", "", 1, "c"), (None, "u", BIG + "y", 1, "c"))
    want = [(7, 100, "revisit", 3), (3, 100, "response", None), (3, 100, "response", None), (None, 100, "revisit", 3), (1, 5, "response", None),
            (2, 5, "response", None), (4, 0, "response", None), (5, 0, "response", None), (None, 101, "response", None)]
    for size in (10, 200, 1 << 20):
        assert _rows(warc.round_trip(pages, range_bytes=size)) == sorted(map(str, want))


def test_payloads_and_large_ids(table):
    html = "<p>é😀\r\n\r\n</p>" * 200000
    pages = table(PAGES, (2**62 + 1, "u", html, 0, ""), (2**62 + 3, "u", html, 0, ""))
    rows = warc.round_trip(pages, range_bytes=1000, payloads=True).orderBy("page_id").collect()
    assert [r["page_id"] for r in rows] == [2**62 + 1, 2**62 + 3] and rows[1]["refers_to"] == 2**62 + 1
    assert bytes(rows[0]["payload"]).decode() == html and rows[1]["payload"] is None
    assert {r["payload_digest"] for r in rows} == {hashlib.sha256(html.encode()).hexdigest()}


def test_no_pages(table):
    assert warc.round_trip(table(PAGES)).count() == 0


def test_archives_are_plain_gzip_members(table, tmp_path):
    listed = warc.write_archives(table(PAGES, (1, "u", BIG, 0, ""), (2, "u", BIG, 0, "")), str(tmp_path)).collect()
    data = b"".join(gzip.open(r["path"]).read() for r in listed)
    assert data.count(b"WARC/1.1\r\n") == 2 and b"WARC-Type: revisit" in data


class _Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at:at + n]


@pytest.mark.parametrize("step", [1, 7, 64, 10**6])
def test_every_record_is_owned_once(step):
    records = [warc.record_bytes(n, "u", bytes([n]) * n * 40, "d", "response", None) for n in range(30)]
    noise = [b"\x1f\x8b\x08" * 5, b"", warc._gzip(b"no record"), b"\x1f", b"junk"]
    data = b"".join(warc._gzip(r) + noise[n % 5] for n, r in enumerate(records))
    found = [r for at in range(0, len(data), step) for r in warc._records(_Bytes(data), len(data), at, min(at + step, len(data)))]
    assert found == records


def test_damaged_payload_stops_the_job():
    record = warc.record_bytes(1, "u", b"abc", hashlib.sha256(b"abd").hexdigest(), "response", None)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(record)
