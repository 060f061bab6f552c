"""Deduplicated WARC archives: revisit records for payloads that another record holds.

Only headers (page_id, digest, length) are shuffled to find equal payloads.
Archives are written by Spark's text writer: a record is one row, the blank
lines that end it are the row separator, files are gzip streams of a bounded
number of records. They are read back file by file along Content-Length, never
by searching for separators.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtwarden.llm.common import Run, saved, saved_by, small_batches

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload string"


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Pages (page_id, url, payload, digest, size, refers_to): of equal payloads of ``least_bytes`` or more the largest page_id is kept.

    A null html is an empty payload. Rows without page_id never stand for
    others and are never revisits. Rows that repeat the kept page_id are
    responses too.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    # payloads are written by buckets of page_id once; from there on only headers are shuffled
    with Run(pages.sparkSession) as run:
        rows, plain = saved_by(rows, "payloads", "page_id")
        revisits = _revisits(plain, least_bytes)
        run.keep(rows, revisits)
    # the digest is compared after the join, so that page_id alone is its key and the buckets serve
    other = F.col("digest").contains(F.col("_d"))
    return rows.join(revisits.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "refers_to"), (F.col("page_id") == F.col("_p")) & other, "left").drop("_p", "_d")


def _revisits(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another."""
    heads = saved(rows.where((F.col("size") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest"), "heads")
    originals = saved(heads.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least"), "originals")
    return saved(heads.join(originals, "digest").where("page_id <> refers_to").distinct(), "revisits")


def write_archives(rows: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 1000) -> None:
    """One WARC record per row of :func:`with_revisits`; header values lose line breaks."""
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    again = F.col("refers_to").isNotNull()
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")), F.lit("\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: "), urn(F.col("refers_to")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    out = rows.select(F.concat(head, block).alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _headers(file: io.BufferedIOBase) -> tuple[str, dict[str, str]] | None:
    first = file.readline()
    while first in (b"\r\n", b"\n"):
        first = file.readline()
    if not first:
        return None
    out = {}
    while (line := file.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8").partition(":")
        out[name.strip().lower()] = value.strip()
    return first.decode("utf-8").strip(), out


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").rpartition(":")[2]
    return int(number) if number.lstrip("-").isdigit() else None


def records_of(content: bytes) -> Iterator[tuple]:
    """The records of one archive file, plain or gzip; digests of stored payloads are checked."""
    file = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while (found := _headers(file)) is not None:
        version, head = found
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        block = file.read(int(head["content-length"]))
        kind = head["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        part = io.BytesIO(block)
        http = (_headers(part) or ("", {}))[1]
        payload, digest = part.read(), head.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response":
            real = hashlib.sha1(payload).hexdigest()
            if digest and digest != real:
                raise ValueError(f"payload digest of {head.get('warc-record-id')} is {real}, not {digest}")
            digest = real
        size = len(payload) if kind == "response" else int(http.get("content-length", 0))
        yield _page(head.get("warc-record-id")), kind, _page(head.get("warc-refers-to")), head.get("warc-target-uri"), size, digest, payload.decode("utf-8", "replace") if kind == "response" else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of all archives in a folder."""
    small_batches(spark, 200)
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                some, size = [], 0
                for r in records_of(batch.column(0)[i].as_py()):
                    some.append(r)
                    size += r[4]
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records with revisits given the payload of the response they refer to, or of one with their digest; null if there is none."""
    held = records.where((F.col("record_type") == "response") & F.col("payload").isNotNull())
    by_digest = held.groupBy("payload_digest").agg(F.max("page_id").alias("_held"))
    target = records.where(F.col("record_type") == "revisit").drop("payload").join(by_digest, "payload_digest", "left").withColumn("_held", F.coalesce("_held", "refers_to"))
    texts = held.select(F.col("page_id").alias("_held"), F.col("payload_digest"), "payload").dropDuplicates(["_held", "payload_digest"])
    restored = target.join(texts, ["_held", "payload_digest"], "left").select(*records.columns)
    return records.where("record_type <> 'revisit'").unionByName(restored)


def deduplicated(pages: DataFrame, path: str) -> DataFrame:
    """Writes the archives of ``pages`` to a new folder and returns what they hold."""
    write_archives(with_revisits(pages), path)
    return read_archives(pages.sparkSession, path)
