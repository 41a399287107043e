"""WARC archives as a table of chunks.

A record is a row with its header block followed by rows with at most ``CHUNK_BYTES`` of its payload, numbered within the
record; a record that fits into one chunk is a single row. Each row carries the SHA-1 of the payload up to its end, so a
reader can check as it goes; no step after the first cut holds more than a chunk of a record. The ``data`` of the rows of
an archive, in order, are a WARC/1.1 file.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.lookup import lookup
from tabwright.llm.common import removed_at_end, shared_folder, written

CHUNK_BYTES = 1 << 16
REVISIT_BYTES = 1000
ARCHIVES = 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
BATCH = 128
CHUNKS = "archive int, record_id string, page_id long, chunk_no int, whole boolean, data binary, digest string"


def repeated_payloads(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``sha1, sha256, refers_to, n`` of the payloads of ``least`` bytes or more that several rows have: the largest page id.

    Rows without a page id count, but are never referred to; payloads that only such rows have are left out. An empty
    table gives no rows.
    """
    payload = pages.select(F.col("page_id").cast("long").alias("page_id"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("p"))
    digests = payload.filter(F.octet_length("p") >= least).select("page_id", F.sha1("p").alias("sha1"), F.sha2("p", 256).alias("sha256"))
    counted = digests.groupBy("sha1", "sha256").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    return counted.filter("n > 1 AND refers_to IS NOT NULL")


def records(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, least: int = REVISIT_BYTES, archives: int = ARCHIVES) -> DataFrame:
    """A row per chunk of each page: ``archive, page_id, url, number, refers_to, size, sha1, chunk_no, chunk``; cut in the JVM.

    Payloads are looked up among those that repeat: with few of those, no payload is moved. ``number`` tells rows apart
    that repeat a page and its url. A page without an id is a response.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    plain = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.monotonically_increasing_id().alias("number"), payload.alias("_payload"),
    )
    digests = plain.select("*", F.sha1("_payload").alias("sha1"), F.sha2("_payload", 256).alias("sha256"))
    found = lookup(digests, written(repeated_payloads(pages, least)), ["sha1", "sha256"], "n")
    typed = found.withColumn("refers_to", F.when(F.col("page_id") != F.col("refers_to"), F.col("refers_to")))
    size = F.octet_length("_payload")
    stored = F.when(F.col("refers_to").isNull(), size).otherwise(0)
    chunks = F.greatest(F.lit(1), F.ceil(stored / chunk_bytes)).cast("int")
    cut = typed.select(
        F.pmod(F.xxhash64("page_id", "url"), F.lit(archives)).cast("int").alias("archive"), "page_id", "url", "number", "refers_to",
        size.cast("long").alias("size"), "sha1", stored.alias("_stored"), "_payload", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk_no"),
    )
    data = F.expr(f"substring(_payload, chunk_no * {chunk_bytes} + 1, {chunk_bytes})")
    return cut.select(*cut.columns[:7], "chunk_no", F.when(F.col("_stored") > 0, data).otherwise(F.lit(b"")).alias("chunk"))


def header(page_id: int | None, url: str | None, refers_to: int | None, size: int, sha1: str, number: int = 0) -> tuple[str, bytes]:
    """Record id and header block. A revisit names the response's page and has no payload of its own."""
    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {sha1} {number}')}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"X-Page-ID: {'' if page_id is None else page_id}", "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {size if refers_to is None else 0}")
    return record_id, ("\r\n".join(lines) + "\r\n\r\n").encode()


END = b"\r\n\r\n"


def formatted(chunk_bytes: int):
    """Chunks as they come, each record's in order, with headers, running digests and the end of each record."""

    def rows_of(batch: pa.RecordBatch, open_: dict) -> Iterator[tuple]:
        for row in batch.to_pylist():
            if row["chunk_no"] == 0:
                open_["id"], head = header(row["page_id"], row["url"], row["refers_to"], row["size"], row["sha1"], row["number"])
                open_["sha1"], open_["seen"] = hashlib.sha1(), 0
            open_["sha1"].update(row["chunk"])
            open_["seen"] += len(row["chunk"])
            ends = row["refers_to"] is not None or open_["seen"] == row["size"]
            data = row["chunk"] + END if ends else row["chunk"]
            known = row["archive"], open_["id"], row["page_id"]
            if row["chunk_no"] == 0:
                if ends and len(head) + len(row["chunk"]) <= chunk_bytes:
                    yield (*known, 0, True, head + data, open_["sha1"].hexdigest())
                    continue
                yield (*known, 0, False, head, hashlib.sha1().hexdigest())
            yield (*known, row["chunk_no"] + 1, False, data, open_["sha1"].hexdigest())

    def format_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict = {}
        types = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                columns = list(zip(*rows_of(batch.slice(at, BATCH), open_), strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])

    return format_


def write_archives(pages: DataFrame, path: str | None = None, chunk_bytes: int = CHUNK_BYTES, least: int = REVISIT_BYTES) -> str:
    """Write the archives of ``pages`` as a chunk table and return its path.

    The default path is in the shared folder and goes when the application ends. A null page, url or html is an empty
    one. Rows that repeat a page and its url give one record each, whatever their html; an empty table gives no record.
    """
    spark = pages.sparkSession
    if path is None:
        path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
        removed_at_end(spark, path)
    records(pages, chunk_bytes, least).mapInArrow(formatted(chunk_bytes), CHUNKS).write.option("compression", "zstd").parquet(path)
    return path


class Reader:
    """Reads one record from its chunks in order: parses the header, digests the payload, checks every prefix digest."""

    def __init__(self, head: bytes):
        block, _, rest = head.partition(END)
        lines = block.decode().split("\r\n")
        if lines[0] != "WARC/1.1" or rest:
            raise ValueError("a record must start with its header block")
        self.fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        self.left, self.tail, self.sha1, self.next = int(self.fields["Content-Length"]), b"", hashlib.sha1(), 1

    def feed(self, number: int, data: bytes, digest: str) -> None:
        if number != self.next:
            raise ValueError(f"{self.fields['WARC-Record-ID']}: chunk {number} where {self.next} should be")
        self.next += 1
        payload, rest = data[: self.left], data[self.left :]
        self.left -= len(payload)
        self.tail += rest
        self.sha1.update(payload)
        if self.sha1.hexdigest() != digest:
            raise ValueError(f"{self.fields['WARC-Record-ID']}: chunk {number} does not have its digest")

    def row(self) -> tuple:
        if self.left or self.tail != END:
            raise ValueError(f"{self.fields['WARC-Record-ID']}: the record does not end where it should")
        field = self.fields.get
        page, kind, stored = field("X-Page-ID"), field("WARC-Type"), field("WARC-Payload-Digest").removeprefix("sha1:")
        if kind == "response" and self.sha1.hexdigest() != stored:
            raise ValueError(f"{field('WARC-Record-ID')}: the payload does not have its digest")
        refers = field("X-Refers-To-Page-ID")
        return int(page) if page else None, int(field("X-Payload-Length")), stored, kind, None if refers is None else int(refers)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per record. The rows of a record come together and in order."""
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [c.split()[0] for c in RECORD.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    current, reader, out = None, None, []
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            for record_id, number, whole, data, digest in zip(*(part.column(c).to_pylist() for c in ("record_id", "chunk_no", "whole", "data", "digest")), strict=True):
                if whole:
                    head, end, payload = data.partition(END)
                    alone = Reader(head + end)
                    alone.feed(1, payload, digest)
                    out.append(alone.row())
                    continue
                if record_id != current:
                    out += [reader.row()] if reader else []
                    current, reader = record_id, Reader(data)
                else:
                    reader.feed(number, data, digest)
            if len(out) >= 1024:
                yield table(out)
                out = []
    out += [reader.row()] if reader else []
    if out:
        yield table(out)


def read_archives(spark, path: str) -> DataFrame:
    """One row per record of the chunk table: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Records of one row are read where they are; only the rows of longer ones are brought together.
    """
    chunks = spark.read.parquet(path).select("record_id", "chunk_no", "whole", "data", "digest")
    several = chunks.filter("NOT whole").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return chunks.filter("whole").mapInArrow(parsed, RECORD).union(several.mapInArrow(parsed, RECORD))
