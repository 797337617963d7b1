"""Exact duplicates by a stateful stream: disk-backed keyed state without expiry, full bytes checked on hits.

An index of (digest, id, locator) is written once. A stream reads the index and keeps, per digest, how many rows have
come and which of them stays, with the place of its text; the state lives in RocksDB on the executors' disks, its
checkpoints in the shared folder, and no key ever expires. Rows of one digest are combined before the shuffle, so a
digest that a third of all rows share costs a row per task. Whatever met its digest before (a hit) is then compared
byte by byte; should two texts share a digest, their rows are grouped by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cohera.llm.registry import query, table
from cohera.llm.shared import Stored, ascii_lower, join_checked, work_path

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each small store reserves megabytes
}
BATCH_MB_PER_CORE = 16  # index bytes of a micro-batch for each core of the cluster


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextmanager
def _state_settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_groups(spark: SparkSession, index: Stored, batch_mb: int | None = None) -> DataFrame:
    """Per digest: ``keep`` (id, file, row of the row with the largest id) and ``n``, as the state has them at the end."""
    batch_mb = batch_mb or BATCH_MB_PER_CORE * spark.sparkContext.defaultParallelism
    out = work_path(spark, "dedup-groups")
    rows = spark.readStream.schema(index.schema).option("maxBytesPerTrigger", batch_mb << 20).parquet(index.path)
    grouped = rows.groupBy("digest").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))

    def save(batch: DataFrame, number: int) -> None:  # a repeated batch overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _state_settings(spark):
        run = (
            grouped.writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", work_path(spark, "dedup-stream")).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    schema = StructType([*grouped.schema.fields, StructField("batch", IntegerType())])
    if index.df.isEmpty():
        return spark.createDataFrame([], grouped.schema)
    last = spark.read.schema(schema).parquet(out).groupBy("digest").agg(F.max(F.struct("batch", "keep", "n")).alias("s"))
    return last.select("digest", "s.keep", "s.n")


def _has_place(docs: DataFrame) -> bool:
    """Whether rows still know their file; after a join or an aggregation they don't, and the locator is null."""
    try:
        return "row_index" in docs.select("_metadata").schema["_metadata"].dataType.fieldNames()
    except (AnalysisException, AttributeError):
        return False


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, batch_mb: int | None = None,
) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``digest``, ``locator``.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. The row with the largest id stays. Null
    ids sort below all others, so a group of null ids keeps a null. Rows repeated with the largest id all count as
    kept (they are the same document). Other columns of ``docs`` are not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = ascii_lower(F.col(text_col))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    if not _has_place(docs):
        place = [F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("row")]
    index = Stored(docs.select(digest(text).alias("digest"), F.col(id_col).alias("id"), *place), "dedup-index")
    groups = Stored(stream_groups(spark, index, batch_mb), "dedup-state")
    hit = groups.df.where("n > 1").select("digest")
    # full bytes on hits: all texts of a digest are the same exactly if the least and the greatest are
    texts = join_checked(docs.select(digest(text).alias("digest"), text.alias("t")), hit, ["digest"], "left_semi")
    differ = Stored(texts.groupBy("digest").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("digest"), "dedup-differ")
    place = F.struct("keep.file", "keep.row").alias("locator")
    sound = groups.df if differ.df.isEmpty() else groups.df.join(differ.df, "digest", "left_anti")
    out = index.df.select("digest", "id").join(sound, "digest").select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep.id")).alias("kept"), "digest", place,
    )
    if not differ.df.isEmpty():
        rows = docs.select(F.col(id_col).alias("id"), digest(text).alias("digest"), text.alias("t")).join(differ.df, "digest")
        by_text = rows.groupBy("digest", "t").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        place = F.lit(None).cast(out.schema["locator"].dataType).alias("locator")
        out = out.unionByName(rows.join(by_text, ["digest", "t"]).select(
            F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", place,
        ))
    return out


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


@query("op7_exact_dedup", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
