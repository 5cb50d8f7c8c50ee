"""WARC archives in which repeated payloads are stored once.

Headers are shuffled by payload digest; the smallest page id of a digest becomes the
response and the others revisit it. Archives are written by Spark's text writer: a record is
a header block, an empty line and the payload, and the writer's line separator is the CRLF
CRLF that ends a WARC record, so every part file is a valid gzip-compressed WARC file and a
repeated or lost task leaves no half-written archive behind.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

RECORDS = ("page_id long, url string, record_type string, record_id string, refers_to long, "
           "payload_bytes long, payload_digest string, payload binary")


def resolve_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) per row of ``pages``.

    Of rows with equal payloads of at least ``min_bytes`` that with the smallest ``page_id`` is the
    response and the others are revisits of it. A null html is an empty payload. Rows that repeat the
    response's ``page_id`` are responses too; a row without ``page_id`` is a response and is never
    referred to. Columns other than page_id, url and html are left out.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select("page_id", "url", payload.alias("html"),
                         F.octet_length(payload).cast("long").alias("payload_bytes"),
                         F.sha2(payload, 256).alias("payload_digest"))
    # Two rows or more, so that what is joined back holds repeated payloads only.
    first = (sized.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
             .groupBy(F.col("payload_digest").alias("__digest"))
             .agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1"))
    joined = sized.join(first, F.col("payload_digest") == F.col("__digest"), "left")
    revisit = F.col("page_id") > F.col("__first")
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("__first")).alias("refers_to"))


def _record_id(page_id, digest):
    name = F.md5(F.concat_ws("/", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
                    F.lit(">"))


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row of ``resolved`` under ``path``, with fresh headers.

    Line breaks inside a URL are percent-encoded, since a header is one line. Dates are a
    parameter, so that a rerun writes the same bytes.
    """
    def header(name, value):
        return F.concat(F.lit(f"{name}: "), value)

    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    lines = F.concat_ws(
        "\r\n", F.lit(VERSION), header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        F.when(url.isNotNull(), header("WARC-Target-URI", url)),
        F.lit(f"WARC-Date: {date}"), header("X-Page-ID", F.col("page_id").cast("string")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, header("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_digest")))),
        F.when(revisit, header("X-Refers-To-Page-ID", F.col("refers_to").cast("string"))),
        F.when(~revisit, F.lit("Content-Type: text/html; charset=utf-8")),
        header("Content-Length", F.octet_length(block).cast("string")))
    (resolved.select(F.concat(lines, F.lit(END), block).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", 20_000).text(path))


def _parse(stream) -> Iterator[dict]:
    """Records of one archive, one at a time."""
    while line := stream.readline():
        headers = {}
        if line.strip() != VERSION.encode():
            raise ValueError(f"not the start of a WARC record: {line[:80]!r}")
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(len(END)) != END.encode():
            raise ValueError(f"record {headers.get('WARC-Record-ID')} is cut short")
        stored = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        response = headers["WARC-Type"] == "response"
        if response and hashlib.sha256(block).hexdigest() != stored:
            raise ValueError(f"record {headers['WARC-Record-ID']} doesn't have its payload's digest")
        page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
        yield {"page_id": None if page is None else int(page), "url": headers.get("WARC-Target-URI"),
               "record_type": headers["WARC-Type"], "record_id": headers["WARC-Record-ID"],
               "refers_to": None if refers is None else int(refers),
               "payload_bytes": len(block) if response else None, "payload_digest": stored,
               "payload": block if response else None}


def _read(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                                ("record_id", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                                ("payload_digest", pa.string()), ("payload", pa.binary())])
            for content in batch.column(0):
                rows, size = [], 0
                for record in _parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    size += record["payload_bytes"] or 0
                    if not with_payload:
                        record["payload"] = None
                    rows.append(record)
                    if len(rows) >= 5_000 or with_payload and size >= 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)
    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record; a response's digest is computed again and compared with its header."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read(with_payload), RECORDS)


def resolved_records(records: DataFrame) -> DataFrame:
    """Records with the size of the full payload also for revisits, taken from the response they refer to."""
    responses = (records.where("record_type = 'response' and page_id is not null")
                 .select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"),
                         F.col("payload_bytes").alias("__bytes")).distinct())
    return records.join(responses, (F.col("refers_to") == F.col("__page"))
                        & (F.col("payload_digest") == F.col("__digest")), "left").select(
        *[F.coalesce("payload_bytes", "__bytes").alias(c) if c == "payload_bytes" else F.col(c)
          for c in records.columns])
