"""Session defaults for local runs and the checkpoint folder rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(app: str = "cohera", cores: str = "*", **conf) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch folder only where none is set (local tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write a derived table once to the shared checkpoint folder and read it back.

    Used for run parameters (cuts, fits, quantiles: one row per split) and between rounds of an iteration. The table
    survives the loss of executors, is computed once however often it is used, and keeps later plans small; its file
    size tells the optimizer whether it may be broadcast.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def release(df: DataFrame) -> None:
    """Free a settled table that nothing reads any more: it is overwritten with no rows, in whatever store it lies."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(df.settled_path)


def settle_parameters(df: DataFrame) -> DataFrame:
    """Fix a table of run parameters (one row per split, model and level).

    The table is written like any other; the size of its file decides between a broadcast and a shuffled join, under
    ``spark.sql.autoBroadcastJoinThreshold``. Nothing is collected and no hint is given.
    """
    return settle(df)
