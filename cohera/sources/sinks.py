"""Table sinks: partitioned parquet, ordered CSV, restartable units of work, manifests, count reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Parquet by partition columns; rows are clustered first so that each folder gets few files, and a large
    partition value is still split over tasks by adaptive execution."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_ordered_csv(df: DataFrame, path: str, *order: str) -> None:
    """CSV in a total order. The sort is a range shuffle: file k holds the k-th range, so names give the order."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=False)


def pending_units(planned: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Units of work still to do."""
    return planned.join(finished.select(*keys).distinct(), keys, "left_anti")


def run_pending(
    spark: SparkSession, planned: DataFrame, keys: list[str], path: str, work: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Compute only units without output and append them, one folder per unit (dynamic partition overwrite).

    A unit's folder appears by the commit of the write, so a broken run leaves no half unit behind.
    """
    types = dict(planned.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    exists = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    done = spark.read.parquet(path).select(*keys) if exists else spark.createDataFrame([], schema)
    todo = pending_units(planned, done, keys)
    out = work(todo)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return spark.read.parquet(path)


def manifest(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """One row per file: name, bytes, SHA-256. Each file is hashed where it is read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def rows_per_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def count_report(df: DataFrame, section: str, counts: dict[str, Column]) -> DataFrame:
    """Counts of one stage as (section, name, value) rows from one aggregation."""
    one = df.agg(*[c.cast("double").alias(n) for n, c in counts.items()])
    return one.select(F.lit(section).alias("section"), F.expr(stack(list(counts)))).select("section", "name", "value")


def stack(cols: list[str]) -> str:
    return f"stack({len(cols)}, " + ", ".join(f"'{c}', `{c}`" for c in cols) + ") AS (name, value)"
