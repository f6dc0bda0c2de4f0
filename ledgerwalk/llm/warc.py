"""Content-addressed WARC archive.

An archive is two Parquet tables.  ``payloads`` holds every distinct payload
once under its SHA-256; ``records`` holds the exact header bytes of each record
and the digest of its payload.  Reading joins the two, and every stored
payload is hashed again first: a payload that does not match its address
stops the read.

Of the records with equal payloads of at least ``MIN_REVISIT`` bytes the one
with the smallest page_id is a response and the others are revisits of it;
records with smaller payloads are all responses.

Null html is an empty payload; a null url gives an empty target.  A null
page_id sorts last, so it is a response only if all its group's ids are null.
Repeated rows are records of their own and share one payload; rows that tie on
the smallest page_id are all responses.  An empty table gives an empty
archive.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 100
WARC_DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def record_header(page_id: Column, url: Column, kind: Column, n_bytes: Column, digest: Column, refers_to: Column,
                  date: str = WARC_DATE) -> Column:
    """The header of a record up to and including its blank line, and the HTTP
    head that begins the block.  The block of a revisit has no payload."""
    length = F.lit(len(HTTP_HEAD)) + F.when(kind == "response", n_bytes).otherwise(0)
    refers = F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: "), _urn(refers_to), F.lit("\r\n"))).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), _urn(page_id),
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", " "),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha256:"), digest, F.lit("\r\n"), refers,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"),
        F.lit("\r\n\r\n"), F.lit(HTTP_HEAD)).cast("binary")


def write_archive(pages: DataFrame, path: str) -> None:
    """Write one record per row of ``pages`` (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    stores = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("page_id").alias("first_id"))
    stores = stores.withColumn("n_bytes", F.octet_length("payload").cast("bigint"))
    stores.write.option("compression", "zstd").parquet(f"{path}/payloads")
    held = pages.sparkSession.read.schema(stores.schema).parquet(f"{path}/payloads").drop("payload")
    records = rows.drop("payload").join(held, "digest")
    again = (F.col("n_bytes") >= MIN_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(again, "revisit").otherwise("response")
    header = record_header(F.col("page_id"), F.col("url"), kind, F.col("n_bytes"), F.col("digest"), F.col("first_id"))
    records.select(header.alias("header"), "digest").write.option("compression", "zstd").parquet(f"{path}/records")


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("_head"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def _page(c: Column) -> Column:
    return F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: parsed header fields, the exact header bytes, the
    payload (of a revisit: that of the record it refers to) and ``record``, the
    original bytes of the whole record."""
    payloads = spark.read.parquet(f"{path}/payloads")
    real = F.sha2("payload", 256)
    checked = payloads.select(
        F.when(real == F.col("digest"), real).otherwise(F.raise_error(F.concat(F.lit("payload does not match its address "), "digest"))).alias("digest"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"), "payload")
    records = spark.read.parquet(f"{path}/records").withColumn("_head", F.col("header").cast("string"))
    digest = F.regexp_extract(_field("WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1)
    fields = records.select(
        F.when(digest == F.col("digest"), digest).otherwise(F.raise_error(F.concat(F.lit("header names another payload than "), "digest"))).alias("digest"), "header",
        _page(_field("WARC-Record-ID")).alias("_page"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"), _page(_field("WARC-Refers-To")).alias("_refers"))
    fields = fields.select("digest", "header", F.expr("try_cast(_page as bigint)").alias("page_id"), "url", "record_type",
                           F.expr("try_cast(_refers as bigint)").alias("refers_to"))
    out = fields.join(checked, "digest")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return out.withColumnRenamed("digest", "payload_digest").withColumn(
        "record", F.concat(F.col("header"), body, F.lit(b"\r\n\r\n")))
