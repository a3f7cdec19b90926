"""WARC archives: writing captures, reading records, assembling transactions.

``write_archive`` writes three records per capture (request, response or
revisit, metadata), which name each other by WARC-Concurrent-To.
``read_archive`` parses archives by Content-Length, so a payload may hold any
text, WARC headers included.  ``assemble`` joins the records of a capture
through those identifiers and emits one nested row per capture, and
``resolve_revisits`` looks up the payload facts of a revisit at the response
that it refers to.
"""

from __future__ import annotations

import gzip
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Payload bytes that one archive file gets on average.
ARCHIVE_BYTES = 16 << 20
# Equal payloads shorter than this are stored again and again.
MIN_REVISIT_BYTES = 100

# Fixed values of the format: version line, line end and record end, revisit profile.
VERSION, EOL, RECORD_END = "WARC/1.1", "\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "record_type STRING, record_id STRING, concurrent_to STRING, refers_to STRING, target_uri STRING, warc_date STRING, "
    "payload_digest STRING, content_type STRING, payload_bytes BIGINT, payload_sha256 STRING, payload BINARY, fields STRING"
)


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, partitions: int | None = None) -> DataFrame:
    """``pages`` (page_id, url, html) as captures: payload facts and what a revisit refers to.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest page_id is the response.  A null html is an empty payload, a
    row without page_id is always a response, and of rows that repeat page_id
    and payload the first is the response and the others revisit it.  The
    payload moves once, by page_id and digest, into ``partitions`` if given;
    which payloads are equal is found from digests alone, and a payload that
    very many pages share is a sum per task.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    facts = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )
    long_enough = (F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()
    narrow = facts.where(long_enough).select("page_id", "payload_digest").distinct()
    firsts = narrow.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = narrow.join(firsts, "payload_digest").where(F.col("page_id") != F.col("first_id"))
    later = later.select("page_id", "payload_digest", "first_id")
    repeat = F.row_number().over(Window.partitionBy("page_id", "payload_digest").orderBy("url"))
    again = (repeat > 1) & long_enough
    placed = facts.repartition(partitions, "page_id", "payload_digest") if partitions else facts
    marked = placed.join(later, ["page_id", "payload_digest"], "left").withColumn("copy_no", repeat)
    return marked.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", "copy_no",
        F.coalesce("first_id", F.when(again, F.col("page_id"))).alias("refers_to"),
    )


def _urn(*parts: Column | str) -> Column:
    """A record id in UUID form, hashed from what makes the record unique."""
    h = F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _header_safe(value: Column) -> Column:
    """A value without the characters that would end or split a header line."""
    return F.replace(F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))


def _record(kind: str, headers: list[tuple[str, Column]], content: Column) -> Column:
    """Text of one record up to, but without, its end mark; headers that are null are left out."""
    lines = [F.lit(f"{VERSION}{EOL}WARC-Type: {kind}"), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(content).cast("string")))
    return F.concat(F.concat_ws(EOL, *lines), F.lit(EOL + EOL), content)


def records_of(captures: DataFrame) -> DataFrame:
    """One row ``value`` per WARC record of ``captures`` (see ``mark_revisits``)."""
    key = ("page_id", "payload_digest", "copy_no")
    main = _urn("main", *map(F.col, key))
    original = _urn("main", F.col("refers_to"), F.col("payload_digest"), F.lit(1))
    uri = _header_safe(F.col("url"))
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(EOL + EOL),
    )
    shared = [("WARC-Record-ID", main), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest"))]
    typed = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", [*shared, typed], F.concat(http, F.col("payload")))
    revisit = _record("revisit", [*shared, ("WARC-Refers-To", original), ("WARC-Profile", F.lit(REVISIT_PROFILE)), typed], http)
    request = _record(
        "request",
        [
            ("WARC-Record-ID", _urn("request", *map(F.col, key))),
            ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", main),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{EOL}User-Agent: seedweave{EOL}{EOL}")),
    )
    metadata = _record(
        "metadata",
        [
            ("WARC-Record-ID", _urn("metadata", *map(F.col, key))),
            ("WARC-Target-URI", uri),
            ("WARC-Concurrent-To", main),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(EOL)),
    )
    return captures.select(F.explode(F.array(request, F.when(is_revisit, revisit).otherwise(response), metadata)).alias("value"))


def write_archive(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` as gzipped WARC files under ``path``, of about ``archive_bytes`` payload each.

    The text writer's line separator is the record end of the format, so
    Spark itself writes the files, wherever the path lies.
    """
    total = pages.agg(F.sum(F.octet_length("html").cast("bigint"))).first()[0] or 0
    n_files = max(1, math.ceil(total / archive_bytes))
    marked = mark_revisits(pages, partitions=n_files)
    records_of(marked).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of one archive file, decompressed or not, framed by Content-Length."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in data[at:head_end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
        size = int(headers["content-length"])
        start = head_end + 4
        if start + size > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        headers["content"] = data[start : start + size]
        yield headers
        at = start + size + 4


def _row(record: dict, keep_payload: bool) -> tuple:
    kind, content = record.get("warc-type"), record["content"]
    payload = fields = None
    if kind == "response":
        payload = content.partition(b"\r\n\r\n")[2] if content.startswith(b"HTTP/") else content
    elif kind == "metadata":
        fields = content.decode("utf-8", "replace")
    return (
        kind, record.get("warc-record-id"), record.get("warc-concurrent-to"), record.get("warc-refers-to"), record.get("warc-target-uri"),
        record.get("warc-date"), record.get("warc-payload-digest"), record.get("content-type"),
        None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest(),
        payload if keep_payload else None, fields,
    )


def read_archive(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of all WARC files under ``path``, one row each, facts taken from the payload itself.

    A file is one task's input; ``write_archive`` bounds its size.  A damaged
    file raises an error.  ``keep_payload=False`` leaves the bytes out.
    """
    names = [part.strip().split(" ")[0] for part in RECORD_SCHEMA.split(",")]
    types = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for record in parse_records(data.as_py()):
                    rows.append(_row(record, keep_payload))
                    held += len(record["content"])
                    if len(rows) >= 5000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, response (or revisit) record, request, metadata.

    Requests and metadata find their capture by concurrent_to.  A capture
    without one of them has null there; of several the one with the smallest
    record_id is taken and n_requests, n_metadata tell how many there were.
    Records that name no existing capture stay out.
    """
    body = [c for c in records.columns if c != "concurrent_to"]
    main = records.where(F.col("record_type").isin("response", "revisit"))

    def tied(kind: str, short: str) -> DataFrame:
        own = F.struct("record_id", "target_uri", "warc_date", "content_type", "fields")
        found = records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        return found.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min(own).alias(kind), F.count(F.lit(1)).alias(f"n_{short}"))

    joined = main.select("record_id", F.struct(*body).alias("capture")).join(tied("request", "requests"), "record_id", "left")
    return joined.join(tied("metadata", "metadata"), "record_id", "left").withColumnRenamed("record_id", "capture_id")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Captures plus ``original`` (page_id, payload_bytes, payload_sha256) of the response that holds the payload."""
    page = F.nullif(F.regexp_extract(F.col("metadata.fields"), "(?m)^page-id: (-?[0-9]+)", 1), F.lit("")).cast("bigint")
    known = captures.withColumn("page_id", page)
    facts = F.struct("page_id", F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.payload_sha256").alias("payload_sha256"))
    responses = known.where(F.col("capture.record_type") == "response").select(F.col("capture_id").alias("original_id"), facts.alias("original"))
    holder = F.coalesce(F.col("capture.refers_to"), F.col("capture_id"))
    return known.withColumn("original_id", holder).join(responses, "original_id", "left").drop("original_id")
