"""WARC archives with revisit records.

resolve: only headers (page_id, digest, length) are shuffled, by payload digest. Of equal payloads of at least `least`
bytes, the one with the largest page_id is the response and the others revisit it; smaller ones are all responses.
write: each page's record is built with fresh headers (the date is that of writing; revisits have no block; the payload's length is
in X-Payload-Length, which revisits need) and compressed as a gzip member of its own, as the format advises. Members are gathered
into archives of about file_bytes. A member ends in 0x00 (the high byte of a length below 16 MiB; a larger record is followed by an
empty member), so archives are rows of a text table whose line separator is that byte: Spark's own writer and committer put
them into any store. read: archives come through Spark's binaryFile source and are parsed by length alone, in one pass.

Null html is an empty payload. Rows with one page_id are each kept, with the same WARC-Record-ID; equal rows are all responses. A null page_id sorts
below any other, and a record without one has no WARC-Record-ID of its own. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, shared_dir

#: Fixed values of the format.
VERSION, PROFILE, END = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"\r\n\r\n"
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003030000000000" + "00000000")


def resolve(headers: DataFrame, *, least: int = 0) -> DataFrame:
    """One row per distinct (page_id, digest) of headers (page_id, digest, length): record_type and refers_to."""
    counted = headers.filter(F.col("length") >= least).groupBy("digest").agg(F.max("page_id").alias("original"))
    known = headers.distinct().join(counted.hint("merge"), "digest", "left")
    revisits = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    return known.select("page_id", "digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("original")).alias("refers_to"))


def urn(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    """A gzip member with one record."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Target-URI: {url}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    block = payload
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
        block = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode() + END + block + END
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    member = press.compress(data) + press.flush()
    return member if member[-1] == 0 else member + EMPTY_MEMBER


def write(pages: DataFrame, path: str, *, least: int = 0, file_bytes: int = 32 << 20, date: str | None = None) -> None:
    """Archives that end with the record which brings them to so many bytes; date: of the records, now by default."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html")).withColumn("digest", F.sha1("html"))
    types = resolve(pages.select("page_id", "digest", F.octet_length("html").alias("length")), least=least)
    types = types.withColumnsRenamed({"page_id": "id", "digest": "of"})
    typed = pages.join(types.hint("merge"), pages["page_id"].eqNullSafe(types["id"]) & (pages["digest"] == types["of"])).select("page_id", "url", "html", "record_type", "refers_to")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                for x in zip(*(c.to_pylist() for c in b.slice(i, 256).columns), strict=True):
                    held.append(record(*x, date))
                    size += len(held[-1])
                    if size >= file_bytes:
                        yield batch("archive binary", archive=[b"".join(held)[:-1]])
                        held, size = [], 0
        if held:
            yield batch("archive binary", archive=[b"".join(held)[:-1]])

    archives = typed.mapInArrow(work, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    view, at = memoryview(data), 0
    while at < len(view):
        un, out = zlib.decompressobj(31), []
        while not un.eof:
            part = view[at : at + (1 << 14)]
            if not part:
                raise ValueError("archive is cut off")
            out.append(un.decompress(part))
            at += len(part)
        at -= len(un.unused_data)
        member = b"".join(out)
        if not member:
            continue
        head, _, tail = member.partition(END)
        version, *lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines)
        n = int(headers["Content-Length"])
        if version != VERSION or tail[n:] != END:
            raise ValueError("broken record")
        yield headers, tail[:n]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) from the archives; a revisit has no payload."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    number = lambda x: None if x in (None, urn(None)) else int(x[10:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows: list[tuple] = []
                for h, block in records_of(data):
                    if h["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != h["WARC-Payload-Digest"][5:]:
                        raise ValueError("payload and digest differ")
                    rows.append((number(h["WARC-Record-ID"]), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:], h["WARC-Type"], number(h.get("WARC-Refers-To")), None if h["WARC-Type"] == "revisit" else block))
                if rows:
                    yield batch(schema, **dict(zip(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"), zip(*rows, strict=True), strict=True)))

    return files.mapInArrow(work, schema)


def write_and_read(pages: DataFrame, **options) -> DataFrame:
    path = shared_dir(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path)
