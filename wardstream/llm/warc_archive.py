"""Content-addressed WARC archive.

``write_archive`` makes two tables: ``payloads`` keeps the bytes of each payload once under
its SHA-256, and ``headers`` keeps the exact header block of every record.  Records are
rebuilt by joining the two.  Payloads filed under one digest are compared by length and a
second digest while they are written; a mismatch fails the job.

Defined results: null html is the empty payload; among equal payloads of at least
``least_bytes`` the largest page_id is the response (null ids come last; rows that repeat
the largest id are all responses); a null url leaves out the target header; control
characters and spaces in a url are percent-encoded; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
END = "\r\n"


def _safe_url(url: Column) -> Column:
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), F.url_encode(url)).otherwise(url)


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """One row per page: page_id, the store key, the exact header block."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    narrow = pages.select(
        "page_id", F.col("url"), F.sha2(payload, 256).alias("key"), F.sha1(payload).alias("sha1"),
        F.octet_length(payload).cast("long").alias("n"))
    first = narrow.filter(F.col("n") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("first_id"))
    owned = narrow.join(first, "key", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(END))

    kind = F.when(revisit, "revisit").otherwise("response")
    head = F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", kind), line("WARC-Record-ID", _name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", _safe_url(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _name(F.col("first_id"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))), F.lit(END))
    return owned.select("page_id", "key", F.encode(head, "UTF-8").alias("header"))


def payloads(pages: DataFrame) -> DataFrame:
    """Each payload once under its SHA-256, checked by length and SHA-1."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    stored = pages.select(F.sha2(payload, 256).alias("key"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    same = (F.min("sha1") == F.max("sha1")) & (F.min(F.octet_length("payload")) == F.max(F.octet_length("payload")))
    kept = stored.groupBy("key").agg(F.first("payload").alias("payload"), same.alias("same"))
    checked = F.when(F.col("same"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads under one digest")))
    return kept.select("key", checked.alias("payload"))


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    payloads(pages).write.parquet(f"{path}/payloads")
    records(pages, least_bytes, date).write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of an archive."""
    headers = spark.read.schema("page_id long, key string, header binary").parquet(f"{path}/headers")
    return headers, spark.read.schema("key string, payload binary").parquet(f"{path}/payloads")


def field(header: Column, name: str) -> Column:
    """The value of a header field; null if the block lacks it."""
    text = F.decode(header, "UTF-8")
    return F.nullif(F.regexp_extract(text, rf"(?m)^{name}: ([^\r\n]*)$", 1), F.lit(""))


def _rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """page_id, key, header, type, record and payload of every record."""
    headers, stored = read_archive(spark, path)
    typed = headers.withColumn("type", field(F.col("header"), "WARC-Type"))
    body = F.when(F.col("type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return typed.join(stored, "key", "left").select(
        "page_id", "key", "header", "type", F.concat("header", body, F.lit(END * 2).cast("binary")).alias("record"), "payload")


def rebuild(spark: SparkSession, path: str) -> DataFrame:
    """page_id, the bytes of the original WARC record, and the full payload also for revisits."""
    return _rebuilt(spark, path).select("page_id", "record", "payload")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """What each rebuilt record says and what its payload is.

    Every record is rebuilt.  Digest and length are taken from the bytes after its header,
    for a revisit from the payload it refers to; a record whose header tells another digest
    or another Content-Length than its bytes have fails the job.
    """
    head = F.octet_length("header")
    rebuilt = _rebuilt(spark, path).withColumn("body", F.substring(F.col("record"), head + 1, F.octet_length("record") - head - 2 * len(END)))
    data = F.when(F.col("type") == "response", F.col("body")).otherwise(F.col("payload"))
    said = rebuilt.select(
        "page_id", F.col("type").alias("record_type"), F.octet_length(data).cast("long").alias("payload_bytes"), F.sha1(data).alias("measured"),
        (F.sha2(data, 256) == F.col("key")).alias("filed"),
        (field(F.col("header"), "Content-Length").try_cast("long") == F.octet_length("body")).alias("sized"),
        field(F.col("header"), "WARC-Payload-Digest").alias("said"),
        F.regexp_extract(field(F.col("header"), "WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1).cast("long").alias("refers_to"))
    intact = F.coalesce(F.col("filed") & F.col("sized") & (F.col("said") == F.concat(F.lit("sha1:"), F.col("measured"))), F.lit(False))
    digest = F.when(intact, F.col("measured")).otherwise(F.raise_error(F.lit("a record does not match its payload")))
    return said.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
