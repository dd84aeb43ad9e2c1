"""Web archives as chunked record tables.

Writing: a payload longer than a chunk becomes WARC segments (a response and its continuations), so
no row of the job holds more than a chunk besides the payload it came from.  Spark's text writer puts
the records into gzip files, with the blank lines that end a record as its line separator.

Reading: an archive is read line by line in one task, as gzip cannot be split; the bytes of a payload
are handed on in chunks, rows of record id and chunk number with the SHA-1 of everything up to there.
Memory holds one chunk (and one line, the least that Spark's reader hands over), never a record.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

CHUNK_BYTES = 1 << 20
LEAST_REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD_LIMIT = 1 << 16

FIELDS = (
    "record_id string, record_type string, target_uri string, refers_to string, chunk_no bigint, chunk binary, payload_bytes bigint, "
    "payload_digest string, declared_digest string, declared_bytes bigint, last boolean"
)
NAMES = [field.split()[0] for field in FIELDS.split(", ")]


def record_id(key) -> str:
    """The record id of a row key; a null key has the id ``null``."""
    return f"urn:page:{'null' if key is None else key}"


def _record(block: bytes, **fields: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Date: {DATE}", f"Content-Length: {len(block)}"]
    for name, value in fields.items():
        if value is not None:
            # Control characters would end a header line.
            value = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value) if name != "Content_Type" else value
            lines.append(f"{'' if name == 'Content_Type' else 'WARC-'}{name.replace('_', '-')}: {value}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def records(key, url: str | None, payload: bytes, digest: str, refers_to, chunk_bytes: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = {"Record_ID": f"<{record_id(key)}>", "Target_URI": url, "Payload_Digest": f"sha1:{digest}", "Content_Type": "application/http; msgtype=response"}
    if refers_to is not None:
        yield _record(head, Type="revisit", Profile=REVISIT_PROFILE, Refers_To=f"<{record_id(refers_to)}>", **own)
        return
    view = memoryview(payload)
    if len(payload) <= chunk_bytes:
        yield _record(head + payload, Type="response", **own)
        return
    yield _record(head + bytes(view[:chunk_bytes]), Type="response", Segment_Number="1", **own)
    for number, at in enumerate(range(chunk_bytes, len(payload), chunk_bytes), 2):
        total = str(len(head) + len(payload)) if at + chunk_bytes >= len(payload) else None
        yield _record(
            bytes(view[at : at + chunk_bytes]), Type="continuation", Record_ID=f"<{record_id(key)}:{number}>", Segment_Number=str(number),
            Segment_Origin_ID=own["Record_ID"], Segment_Total_Length=total,
        )


def with_revisits(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``key, url, payload, digest, refers_to``: equal payloads of ``least`` bytes or more refer to the largest key.

    Rows that repeat that key are responses like it; a null key refers to the largest key there is.
    Only digests that occur twice are kept for the join, so the payloads move only if those are many;
    then Spark splits a digest that holds many rows.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    hashed = pages.select(F.col(key).alias("key"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = hashed.where(F.octet_length("payload") >= least)
    repeated = large.groupBy("digest").agg(F.max("key").alias("newest"), F.count("*").alias("n")).where("n > 1 AND newest IS NOT NULL")
    repeated = written(repeated.drop("n"), "repeated")
    return hashed.join(repeated, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("key").eqNullSafe(F.col("newest")), F.col("newest"))
    ).select("key", "url", "payload", "digest", "refers_to")


def write_warc(pages: DataFrame, path: str, key: str = "page_id", html: str = "html", chunk_bytes: int = CHUNK_BYTES) -> None:
    """Archive a page table below ``path``, one gzip file a task.

    Null html is an empty payload, a null url has no target.  An empty table writes an empty archive.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, digest, refers_to = (column[i].as_py() for column in batch.columns)
                for record in records(page, url, payload, digest, refers_to, chunk_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["record"])

    found = with_revisits(pages, key, html).mapInArrow(rows, "record binary")
    found.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


class Reader:
    """Lines of one archive to chunk rows, by position in the stream and declared lengths alone."""

    def __init__(self, chunk_bytes: int = CHUNK_BYTES, with_chunks: bool = True):
        self.chunk_bytes, self.with_chunks = chunk_bytes, with_chunks
        self.header: list[bytes] | None = None
        self.fields: dict[str, str] = {}
        self.need = 0  # bytes of the block still to come
        self.open: dict | None = None  # the record whose payload is being read

    def feed(self, line: bytes) -> Iterator[tuple]:
        """A line without its line feed."""
        if self.need:
            data = (line + b"\n")[: self.need]
            self.need -= len(data)
            yield from self._payload(data)
        elif self.header is None:
            if line.startswith(b"WARC/"):
                self.header = []
        elif line.rstrip(b"\r"):
            self.header.append(line.rstrip(b"\r"))
        else:
            pairs = (x.decode("utf-8", "replace").partition(":") for x in self.header)
            self.fields = {name.strip().lower(): value.strip() for name, _, value in pairs}
            self.header, self.need = None, int(self.fields.get("content-length", 0))
            origin = self.fields.get("warc-segment-origin-id")
            if not (self.open and self.fields.get("warc-type") == "continuation" and origin == self.open["id"]):
                yield from self.close()
                http = self.fields.get("content-type", "").startswith("application/http")
                self.open = {
                    "id": self.fields.get("warc-record-id"), "fields": self.fields, "sha1": hashlib.sha1(), "bytes": 0, "chunk": bytearray(),
                    "number": 0, "head": bytearray() if http else None, "length": None,
                }

    def _payload(self, data: bytes) -> Iterator[tuple]:
        record = self.open
        if record["head"] is not None:
            record["head"] += data
            end = record["head"].find(b"\r\n\r\n")
            if end < 0 and len(record["head"]) < HEAD_LIMIT:
                return
            # The payload starts after the HTTP header; without one the block is the payload.
            data = bytes(record["head"][end + 4 if end >= 0 else 0 :])
            length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", record["head"][: max(end, 0)])
            record["length"], record["head"] = int(length[1]) if length else None, None
        for at in range(0, len(data), self.chunk_bytes):
            part = data[at : at + self.chunk_bytes]
            if len(record["chunk"]) + len(part) > self.chunk_bytes:
                yield self._row(False)
            record["sha1"].update(part)
            record["bytes"] += len(part)
            record["chunk"] += part

    def _row(self, last: bool) -> tuple:
        record, fields = self.open, self.open["fields"]
        bare = lambda name: (fields.get(name) or "").strip("<>") or None
        row = (
            bare("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), bare("warc-refers-to"), record["number"],
            bytes(record["chunk"]) if self.with_chunks else None, record["bytes"], record["sha1"].hexdigest(),
            (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None, record["length"], last,
        )
        record["number"] += 1
        record["chunk"].clear()
        return row

    def close(self) -> Iterator[tuple]:
        """The last chunk of the open record."""
        if self.open:
            head = self.open["head"]
            if head:  # the block ended within what looked like an HTTP header
                self.open["head"] = None
                self.open["sha1"].update(head)
                self.open["bytes"] += len(head)
                self.open["chunk"] += head
            yield self._row(True)
            self.open = None


def read_warc(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, with_chunks: bool = True) -> DataFrame:
    """Chunk rows of the gzip archives below ``path``: :data:`FIELDS`.

    ``payload_bytes`` and ``payload_digest`` are of the payload up to and with the chunk, so the row
    marked ``last`` has those of the whole; an empty payload is one empty chunk.  Continuations are
    part of the record they continue.  ``with_chunks=False`` leaves the bytes out.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, reader, file = [], 0, Reader(chunk_bytes, with_chunks), None
        for batch in batches:
            for line, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if name != file:
                    rows += reader.close()
                    reader, file = Reader(chunk_bytes, with_chunks), name
                for row in reader.feed(line.as_py()):
                    rows.append(row)
                    held += len(row[5] or b"") + 300
                if held > 8 * chunk_bytes:
                    yield _batch(rows)
                    rows, held = [], 0
        rows += reader.close()
        if rows:
            yield _batch(rows)

    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file")).mapInArrow(parse, FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)
