"""Exact dedup against a dictionary, with forced digest collisions and many micro-batches; WARC round trips."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from cohera.llm.exact_dedup import exact_duplicates, sha256
from cohera.llm.warc_store import read_archive, verified, write_archive

ROWS = [
    (5, "Same text", "x"), (9, "same TEXT", "y"), (2, "Éa", "y"), (3, "éa", None), (4, None, "z"), (8, "", "z"), (None, "lone", "q"),
    (None, "lone", "q"), (7, "w " * 40_000, "long"), (1, "W " * 40_000, "long"), (6, "tie", "a"), (6, "tie", "a"),
]


def expected(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(lower(t), []).append(i)
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    return sorted(((i, best(groups[lower(t)]), len(groups[lower(t)]), i == best(groups[lower(t)])) for i, t, _ in rows), key=str)


@pytest.mark.parametrize("digest", [sha256, lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 1))], ids=["sha256", "colliding"])
def test_exact_duplicates(spark, tmp_path, digest):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, id string").repartition(5)
    docs.write.parquet(str(tmp_path / "docs"))
    for d in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        got = exact_duplicates(d, digest=digest).select("doc_id", "keep_id", "group_size", "kept").collect()
        assert sorted((tuple(r) for r in got), key=str) == expected(ROWS)


def test_locator_names_the_row(spark, tmp_path):
    spark.createDataFrame(ROWS[:6], "doc_id long, text string, id string").coalesce(1).write.parquet(str(tmp_path / "d"))
    r = exact_duplicates(spark.read.parquet(str(tmp_path / "d"))).where("doc_id = 5").first()
    assert r.locator.file.endswith(".parquet") and r.locator.row == 1


def test_exact_duplicates_of_nothing(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


PAGES = [(3, "http://a/\r\nx", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (7, "u", ""), (5, "u", "big " * 50_000), (None, "u", "<p>é</p>"), (9, "u", "<p>\r\n\r\nx</p>"), (9, "u", "<p>\r\n\r\nx</p>")]


def test_warc_round_trip(spark):
    records = verified(read_archive(spark, write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string")))).collect()
    assert len(records) == len(PAGES)
    html = {i: h or "" for i, _, h in PAGES}
    for r in records:
        body = html[r.id].encode()
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert rest == body + b"\r\n\r\n" and bytes(r.payload) == body
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert int(fields[b"Content-Length"]) == len(body) == r.payload_bytes and head.startswith(b"WARC/1.1\r\nWARC-Type: ")
    kind = {(r.id, r.record_type, r.refers_urn) for r in records}
    assert kind == {(1, "response", None), (3, "revisit", "<urn:page:1>"), (None, "revisit", "<urn:page:1>"), (2, "response", None), (7, "revisit", "<urn:page:2>"), (5, "response", None), (9, "response", None)}


def test_small_payloads_and_single_copies(spark):
    at = write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), min_bytes=5)
    assert spark.read.parquet(at.payloads).count() == 4
    assert {r.id for r in read_archive(spark, at).where("record_type = 'response'").collect()} == {1, 2, 5, 7, 9}


def test_damaged_payload_is_refused(spark):
    at = write_archive(spark.createDataFrame(PAGES[:2], "page_id long, url string, html string"))
    kept = spark.read.parquet(at.payloads).withColumn("payload", F.concat("payload", F.lit("x").cast("binary"))).collect()
    spark.createDataFrame(kept, "address binary, payload binary").write.mode("overwrite").parquet(at.payloads)
    with pytest.raises(Exception, match="payload does not match"):
        verified(read_archive(spark, at)).collect()


def test_empty_archive(spark):
    assert read_archive(spark, write_archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
