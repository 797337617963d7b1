"""Written tables in the shared folder, row keys and ASCII lower case, used by all operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohera.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors and the driver share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Stored:
    """A derived table written once to the shared folder. It survives lost executors and may be dropped when used up."""

    def __init__(self, df: DataFrame, name: str = "stored"):
        self.spark = df.sparkSession
        self.path = work_path(self.spark, name)
        self.schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Overwrite the table with no rows: a public call that frees the space in any store Spark can write to."""
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self.path)


def ascii_lower(text: Column) -> Column:
    """A-Z only; letters outside ASCII keep their case. Null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def content_key(text: Column) -> Column:
    """128-bit key of the exact text (null as empty): rows with the same text share it, whatever their ids are."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int = 1_000_000) -> DataFrame:
    """Join with a broadcast of ``right`` if it has at most ``rows`` narrow rows, else a shuffled join: same result."""
    return left.join(F.broadcast(right) if small_enough(right, rows) else right, on, how)
