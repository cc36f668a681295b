"""WARC archives: a writer with revisit records, and a reader that splits compressed archives at any byte."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.storage import fresh_folder, stored
from tallyloom.llm.words import whole

#: Payloads from this size on are written once; equal ones revisit it.
SMALLEST_REVISIT = 100
#: An archive is closed at this size; a reader's task takes ranges of this many bytes.
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
_READ_BYTES = 1 << 20
# What the format prescribes.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decided(pages: DataFrame, page_id: str = "page_id", html: str = "html", smallest: int = SMALLEST_REVISIT) -> DataFrame:
    """``pages`` with payload, payload_digest, record_type and refers_to.

    Of equal payloads of ``smallest`` bytes or more the rows with the smallest id are responses, all others revisit
    it. A NULL id is larger than any; rows whose equals have no id at all are responses. Smallest ids are
    found before the join, one row per digest and task, and the join splits a digest that is hot.
    """
    payload = whole(F.col(html)).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= smallest
    first = rows.filter(large).groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("first_id"))
    joined = rows.join(first, large & (rows["payload_digest"] == first["digest"]), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("first_id")).alias("refers_to"))


def _urn(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record_bytes(page_id, url, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    """A record: headers, an HTTP response, and its payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    headers = {"WARC-Type": record_type, "WARC-Date": DATE, "WARC-Payload-Digest": f"sha256:{digest}",
               "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"}
    if page_id is not None:
        headers["WARC-Page-ID"] = str(page_id)
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")
    if record_type == "revisit":
        headers |= {"WARC-Refers-To": _urn(refers_to), "WARC-Profile": PROFILE}
    headers |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _none_if_missing(x):
    return None if x is None or pd.isna(x) else x


def _write(frames: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    """Archives of one task; a task that is run again writes files of other names, and only one run's names are kept."""
    files, base = arrow_fs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    out, path, size, done = None, "", 0, []
    for frame in frames:
        for row in frame.itertuples(index=False):
            if out is None:
                path, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                out = files.open_output_stream(f"{base}/{path}", compression=None)  # records are compressed one by one
            number = lambda x: None if _none_if_missing(x) is None else int(x)
            size += out.write(_gzip(record_bytes(number(row.page_id), _none_if_missing(row.url), bytes(row.payload), row.payload_digest,
                                                 row.record_type, number(row.refers_to))))
            if size >= ARCHIVE_BYTES:
                out.close()
                done.append((path, size))
                out = None
    if out is not None:
        out.close()
        done.append((path, size))
    yield pd.DataFrame(done, columns=["path", "bytes"]).astype({"path": "object", "bytes": "int64"})


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a record per row; returns the stored list (path, bytes) of the archives.

    ``folder`` is where executors and readers can all write and read, by default a new one under
    ``spark.checkpoint.dir``. Ids are whole numbers; they pass as text, so that NULLs do not round them.
    """
    target = folder or fresh_folder(pages.sparkSession, "warc")
    rows = decided(pages).withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")})
    written = rows.mapInPandas(lambda frames: _write(frames, target), "path string, bytes long")
    return stored(written.select(F.concat(F.lit(target.rstrip("/") + "/"), "path").alias("path"), "bytes"), "manifest")


class _Archive:
    """Bytes of an archive, read ahead in pieces."""

    def __init__(self, stream, size: int, at: int):
        self.stream, self.size, self.start, self.data = stream, size, at, b""

    def upto(self, end: int) -> bool:
        """Reads until ``end`` is there, or the file ends."""
        have = self.start + len(self.data)
        if have < min(end, self.size):
            self.data += self.stream.read_at(min(max(end - have, _READ_BYTES), self.size - have), have)
        return end <= self.size

    def forget(self, at: int) -> None:
        self.data, self.start = self.data[at - self.start:], at


def _member(archive: _Archive, at: int) -> tuple[bytes, int] | None:
    """The record of the gzip member at ``at`` and where the member ends; None if no record begins there."""
    reader, out, place = zlib.decompressobj(31), [], at
    seen = 0
    while not reader.eof:
        if place >= archive.size:
            return None
        archive.upto(place + 1)
        piece = archive.data[place - archive.start:place - archive.start + _READ_BYTES]
        try:
            out.append(reader.decompress(piece))
        except zlib.error:
            return None
        seen += len(out[-1])
        place += len(piece)
        if seen >= len(VERSION) and not b"".join(out[:8]).startswith(VERSION):
            return None
    record = b"".join(out)
    return (record, place - len(reader.unused_data)) if record.startswith(VERSION) else None


def _records(stream, size: int, start: int, end: int) -> Iterator[bytes]:
    """Records whose gzip member starts in the range.

    Every place with a gzip magic is a candidate; it is one if it unpacks, checksum included, to a record. After a
    record the search goes on at its end, so nothing inside it is taken for another.
    """
    archive, at = _Archive(stream, size, start), start
    while at < end:
        archive.forget(at)
        archive.upto(min(end, at + _READ_BYTES) + len(MAGIC))
        found = archive.data.find(MAGIC)
        if found < 0:
            at = max(at + 1, archive.start + len(archive.data) - len(MAGIC) + 1)
            if archive.start + len(archive.data) >= archive.size:
                return
            continue
        at = archive.start + found
        if at >= end:
            return
        member = _member(archive, at)
        if member is None:
            at += 1
        else:
            yield member[0]
            at = member[1]


def parse_record(record: bytes) -> dict:
    """Fields of a record; size and digest are of the whole payload, which a revisit only names."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(headers["Content-Length"])].partition(b"\r\n\r\n")
    revisit = headers["WARC-Type"] == "revisit"
    named = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    digest = named if revisit else hashlib.sha256(payload).hexdigest()
    if digest != named:
        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    refers = re.search(r"<urn:page:(-?\d+)>", headers.get("WARC-Refers-To", ""))
    return {"page_id": headers.get("WARC-Page-ID"), "url": headers.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
            "record_type": headers["WARC-Type"], "refers_to": refers[1] if refers else None, "payload": None if revisit else payload}


_FIELDS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
_SCHEMA = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def _read(frames: Iterator[pd.DataFrame], payloads: bool) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples(index=False):
            files, base = arrow_fs.FileSystem.from_uri(row.path)
            with files.open_input_file(base) as stream:
                batch, held = [], 0
                for record in _records(stream, stream.size(), row.start, row.end):
                    fields = parse_record(record)
                    held += len(record)
                    batch.append(fields if payloads else fields | {"payload": None})
                    if held >= _READ_BYTES * 8:
                        yield pd.DataFrame(batch, columns=_FIELDS)
                        batch, held = [], 0
                if batch:
                    yield pd.DataFrame(batch, columns=_FIELDS)


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Records of the archives (path, bytes), each read by the task whose byte range it starts in.

    No index is needed and ranges may cut a record anywhere. A damaged payload stops the job; bytes between
    records are passed over. Without archives there are no records.
    """
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = archives.filter("bytes > 0").select("path", "bytes", start.alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("end"))
    dealt = ranges.repartition("path", "start")
    records = dealt.mapInPandas(lambda frames: _read(frames, payloads), _SCHEMA)
    return records.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def round_trip(pages: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = False) -> DataFrame:
    """Pages (page_id, url, html) written as archives and read back: one row per page.

    NULL and empty html are an empty payload, always a response; repeated rows are records of their own, all
    responses if their id is the smallest; a NULL page_id or url comes back NULL (the url percent-encoded); no pages give
    no archives and no rows; further columns are not written.
    """
    return read_archives(write_archives(pages), range_bytes, payloads)
