"""WARC archives: write captures as record transactions, read them back, assemble them.

Each capture is three records: a request and a metadata record that name the response's
id in WARC-Concurrent-To, and the response itself or, where another capture has the same
payload, a revisit that refers to it. Reading frames every record by its Content-Length;
assembly joins the three through those identifiers and gives one nested row per capture.

Archives are written with Spark's text writer, whose row separator is the blank line
pair that ends a WARC record, and read with its binary reader, so they lie wherever
Spark can write. A file holds at most ``FILE_RECORDS`` captures; readers stream it.

Defined results: a null payload is empty; a null url gives no WARC-Target-URI; control
characters and spaces in a url are percent-encoded; a null page_id never keeps or
revisits a payload. Rows that repeat a page_id and payload share their record ids and
assemble to one row with ``records`` above 1. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n\r\n"
FILE_RECORDS = 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, "
          "payload_bytes long, payload_digest string, fields map<string,string>, payload binary")


def base32_sha1(text) -> F.Column:
    """Bare upper-case base32 SHA-1 of a string or binary column.

    Forty bits at a time, since ``conv`` works on longs; its digits 0-9A-V are then
    renamed to the base32 alphabet.
    """
    digest = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(captures: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``digest``, ``size`` and ``keeper``: the page_id that keeps this payload, null for the keeper itself.

    ``captures`` has page_id, url and payload (string). Only payloads met twice are joined
    back, and the join is one that adaptive execution may split for a hot payload.
    """
    sized = captures.select("page_id", "url", F.coalesce("payload", F.lit("")).alias("payload"))
    sized = sized.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    shared = (sized.where(F.col("size") >= min_bytes).groupBy(F.col("digest").alias("__digest"), F.col("size").alias("__size"))
              .agg(F.max("page_id").alias("__keeper"), F.count("*").alias("__n")).where("__n > 1").drop("__n"))
    return (sized.join(shared, (F.col("digest") == F.col("__digest")) & (F.col("size") == F.col("__size")), "left")
            .withColumn("keeper", F.when(F.col("page_id") < F.col("__keeper"), F.col("__keeper")))
            .drop("__digest", "__size", "__keeper"))


def _record(kind, record_id, headers: list, block) -> F.Column:
    """Text of one record, without the blank lines that end it."""
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id,
             F.lit(f"\r\nWARC-Date: {DATE}\r\n")]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_archives(captures: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write request, response or revisit, and metadata records of all captures below ``path``, gzipped."""
    df = with_revisits(captures, min_bytes)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))

    def name(which, part):
        return F.concat(F.lit("<urn:x-capture:"), which, F.lit("."), F.col("digest"), F.lit(f"#{part}>"))

    uri = F.expr(r"regexp_replace(regexp_replace(regexp_replace(url, '\r', '%0D'), '\n', '%0A'), '[\\x00-\\x20]', '%20')")
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    main, again = name(page, "response"), F.col("keeper").isNotNull()
    target = ("WARC-Target-URI", uri)
    request = _record(F.lit("request"), name(page, "request"), [
        target, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + END)))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(END))
    response = _record(F.when(again, "revisit").otherwise("response"), main, [
        target, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http;msgtype=response")),
        ("WARC-Profile", F.when(again, PROFILE)),
        ("WARC-Refers-To", name(F.col("keeper").cast("string"), "response"))],
        F.when(again, head).otherwise(F.concat(head, F.col("payload"))))
    metadata = _record(F.lit("metadata"), name(page, "metadata"), [
        target, ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))],
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")))
    (df.select(F.concat(request, F.lit(END), response, F.lit(END), metadata).alias("value"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path))


def parse_records(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of a binary stream; header names in lower case.

    Raises ValueError on anything that is not a whole record.
    """
    while True:
        version = stream.readline()
        if not version:
            return
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record starts here: {version[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, block


def _fields(lines: bytes) -> dict:
    pairs = (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n") if ":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def record_row(headers: dict, block: bytes, with_payload: bool) -> tuple:
    """One row of the RECORD schema. A response's size and digest are those of the payload read."""
    kind = headers.get("warc-type")
    size = digest = payload = None
    fields: dict = {}
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        fields = _fields(head)
        if kind == "response":
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        else:
            size = int(fields.get("content-length", 0))
            digest, payload = headers.get("warc-payload-digest", "").removeprefix("sha1:"), None
    elif kind == "metadata":
        fields = _fields(block)
    return (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
            headers.get("warc-target-uri"), size, digest, fields, payload if with_payload else None)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records below ``path``, one row each; files are decompressed and framed as streams."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                got: list = []
                stream = io.BytesIO(content)
                zipped = content[:2] == b"\x1f\x8b"
                for headers, block in parse_records(io.BufferedReader(gzip.GzipFile(fileobj=stream)) if zipped else stream):
                    got.append(record_row(headers, block, with_payload))
                    if len(got) == 2000:
                        yield pd.DataFrame(got, columns=names)
                        got = []
                if got:
                    yield pd.DataFrame(got, columns=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(rows, RECORD)


def assembled(records: DataFrame) -> DataFrame:
    """One nested row per capture: its request, response (or revisit) and metadata records.

    Records meet on the id of the response: their WARC-Concurrent-To, or its own id.
    Records that repeat an id are reduced before the shuffle; ``records`` counts the
    responses. A transaction without a response keeps a null one.
    """
    parts = [c for c in records.columns if c != "fields"]
    whole = F.struct(*parts, F.map_entries("fields").alias("fields"))
    answer = F.col("type").isin("response", "revisit")
    return (records.withColumn("__capture", F.when(answer, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
            .groupBy(F.col("__capture").alias("capture_id"))
            .agg(F.max(F.when(F.col("type") == "request", whole)).alias("request"),
                 F.max(F.when(answer, whole)).alias("response"),
                 F.max(F.when(F.col("type") == "metadata", whole)).alias("metadata"),
                 F.sum(answer.cast("long")).alias("records")))


def remove_archives(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def round_trip(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``path``, read them back, and give a row per page."""
    write_archives(pages.select("page_id", "url", F.col("html").alias("payload")), path, min_bytes)
    captures = assembled(read_records(pages.sparkSession, path, with_payload=False)).where("response IS NOT NULL")
    page = F.map_from_entries("metadata.fields")["page-id"].cast("long")
    keeper = F.regexp_extract("response.refers_to", r"^<urn:x-capture:(-?\d+)\.", 1)
    return (captures.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("records"))))
            .select(page.alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
                    F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"),
                    F.when(keeper != "", keeper).cast("long").alias("refers_to")))


#: DuckDB SQL of the query. Base32 is spelt from the digest's bits, five at a time.
ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), hashed AS (
  SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p
), spelt AS (
  SELECT page_id, payload_bytes, hex,
         list_aggregate(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
             (CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest
  FROM hashed
), k AS (
  SELECT hex, max(page_id) AS keeper FROM spelt GROUP BY hex
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM spelt JOIN k USING (hex)
"""
