"""Content-addressed WARC archive: every payload once, exact record headers apart, records rebuilt by a join.

Two tables in the shared folder make an archive: ``payloads`` (SHA-256 of the bytes, the bytes) and ``headers``
(sequence keys, the record's header block byte for byte, the payload's address). Reading joins them on the address,
verifies the digest over the stored bytes again and parses the header block. Records are never rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohera.llm.registry import query, table
from cohera.llm.shared import work_path

#: RFC 4648 base32 digits (fixed values), and the digits that conv() writes for the same values.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
EPOCH = "1970-01-01T00:00:00Z"


def sha1_base32(data: Column) -> Column:
    """SHA-1 in upper-case base32: four groups of 40 bits, eight digits each."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), CONV32, BASE32)


@dataclass(frozen=True)
class Archive:
    payloads: str
    headers: str


def header_block(uri: Column, record_id: Column, kind: Column, digest: Column, length: Column, refers: Column) -> Column:
    """WARC/1.1 header block, CRLF lines, with the blank line that ends it."""
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.concat(F.lit("WARC-Date: "), F.lit(EPOCH)), F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest), F.concat(F.lit("WARC-Refers-To: "), refers),
        F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def record_urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> Archive:
    """Write one record per row and return where the archive lies.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest id is the response (rows
    that repeat this id too), the others are revisits that refer to it; smaller payloads are all responses. A null
    payload is empty, a null url is an empty URI (line ends in a URL become spaces), a null id never is the smallest
    unless a payload has no other. An empty table gives an empty archive.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\r\n]+", " ").alias("url"), payload.alias("payload"))
    p = p.withColumn("address", F.unhex(F.sha2("payload", 256)))
    slim = p.select("id", "url", "address", F.octet_length("payload").cast("long").alias("bytes"), sha1_base32(F.col("payload")).alias("digest"))
    first = slim.groupBy("address").agg(F.min("id").alias("first_id"))
    rows = slim.join(first, "address")
    response = F.col("id").eqNullSafe(F.col("first_id")) | (F.col("bytes") < min_bytes)
    kind = F.when(response, F.lit("response")).otherwise(F.lit("revisit"))
    refers = F.when(~response, record_urn(F.col("first_id")))
    head = header_block(F.col("url"), record_urn(F.col("id")), kind, F.col("digest"), F.col("bytes"), refers)
    at = Archive(work_path(spark, "warc-payloads"), work_path(spark, "warc-headers"))
    rows.select("id", "first_id", "address", head.cast("binary").alias("header")).write.parquet(at.headers)
    # one copy of each payload: copies are dropped within each task first, then across tasks
    p.select("address", "payload").dropDuplicates(["address"]).write.option("compression", "zstd").parquet(at.payloads)
    return at


def read_archive(spark: SparkSession, at: Archive, id_type: str = "long") -> DataFrame:
    """Rebuilt records: id, header, payload, record (exact bytes), and whether the payload passed its digests."""
    headers = spark.read.schema(f"id {id_type}, first_id {id_type}, address binary, header binary").parquet(at.headers)
    payloads = spark.read.schema("address binary, payload binary").parquet(at.payloads)
    tail = F.lit("\r\n\r\n").cast("binary")
    joined = headers.join(payloads, "address", "left")
    block = F.col("header").cast("string")
    field = lambda name: F.nullif(F.regexp_extract(block, rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))
    return joined.select(
        "id", "first_id", "header", "payload", F.concat("header", "payload", tail).alias("record"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        field("WARC-Type").alias("record_type"), field("WARC-Payload-Digest").alias("stated_digest"), field("WARC-Refers-To").alias("refers_urn"), field("Content-Length").cast("long").alias("stated_bytes"),
        sha1_base32(F.col("payload")).alias("payload_digest"), (F.unhex(F.sha2("payload", 256)) == F.col("address")).alias("address_holds"),
    )


def verified(records: DataFrame) -> DataFrame:
    """The same rows; a record whose stored bytes do not match its header or its address stops the job."""
    sound = F.coalesce(
        F.col("address_holds") & (F.col("stated_bytes") == F.col("payload_bytes")) & (F.col("stated_digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))), F.lit(False),
    )
    return records.withColumn("payload_digest", F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload does not match its record")).cast("string")))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS k, sha1(html) AS x FROM p),
b AS (SELECT page_id, payload_bytes, k, list_aggregate(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31))::INT, 1)), 'string_agg', '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM b WINDOW w AS (PARTITION BY k)
"""


@query("op10_warc_archive", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = verified(read_archive(spark, write_archive(table(spark, sf_dir, "pages"))))
    refers = F.regexp_extract("refers_urn", "^<urn:page:(.*)>$", 1)
    return records.select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_urn").isNotNull(), refers.try_cast("long")).alias("refers_to"),
    )
