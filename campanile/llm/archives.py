"""WARC archives: writing pages with payloads kept once, reading them back, resolving revisits."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, page_id long, url string, payload_digest string, refers_to_id string, payload_bytes long, payload string"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits, five hexadecimal digits, give four characters."""
    digits = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", page.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def resolve(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Each page with payload, digest, record type and, for revisits, the page_id of the response.

    Of equal payloads of at least `min_bytes` bytes the one with the smallest page_id is the response; repeated rows of that id are all responses, and rows without
    an id come last (without any id in the group all are responses). A null payload is empty. Only digest and id are combined before the shuffle by digest;
    a payload with very many copies is a skewed key of a join, which adaptive execution splits.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", payload_digest(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = rows.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    revisits = (F.col("payload_bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "payload_digest", "left").withColumn("refers_to", F.when(revisits, F.col("first"))).withColumn("record_type", F.when(revisits, "revisit").otherwise("response")).drop("first")


def _record(date: str) -> Column:
    """A WARC/1.1 record without the two line ends that close it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    # line ends would break a header, so they are percent-encoded there
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat_ws(
        END,
        F.lit("WARC/1.1"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("payload_digest"))),
        F.lit(f"WARC-Date: {date}"), line("WARC-Target-URI", target), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")), F.when(revisit, line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("payload_digest")))),
        line("Page-ID", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"), line("Content-Length", F.octet_length(block).cast("string")), F.lit(""), block,
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", compression: str = "gzip", records_per_file: int = 5000, date: str | None = None) -> None:
    """Write the pages under `folder` as WARC/1.1 files, equal payloads once (see `resolve`).

    Spark's text writer makes the files: a record ends with two line ends, which is the separator. Committed tasks only leave files, so lost executors do no harm.
    Null urls and ids leave their header out. With gzip a file is one stream, not one member a record.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = resolve(pages, page_id, url, html, min_bytes)
    rows.select(_record(date).alias("value")).write.option("lineSep", END + END).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(folder)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by the lengths the headers state."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {first[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives under `folder`, as in SCHEMA.

    payload_bytes and payload_digest of a response are taken from its block and must agree with the header; a revisit has no payload of its own (null bytes).
    Files are read whole, so their size bounds the memory; records within are read one after another.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_py()
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
                rows, size = [], 0
                for headers, block in parse(stream):
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                    body = block.partition(b"\r\n\r\n")[2]
                    if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} does not have the digest of its header")
                    own = kind == "response"
                    page = headers.get("page-id")
                    rows.append((headers["warc-record-id"], kind, int(page) if page else None, headers.get("warc-target-uri"), digest, headers.get("warc-refers-to"), len(body) if own else None, body.decode() if own and payload else None))
                    size += len(block)
                    if size > 16_000_000:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").mapInArrow(run, SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Records with each revisit joined to its response: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Only headers are shuffled. A revisit whose response is not there keeps null bytes and refers_to.
    """
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = records.where("record_type = 'response'")
    originals = responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(originals, "refers_to_id", "left")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(revisits.select(columns))
