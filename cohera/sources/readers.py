"""Table sources: keyed CSV, many result files with differing columns, pruned parquet, event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohera.operators.checks import broken_rows, require, row_count, unique_key


def read_keyed_csv(spark: SparkSession, path: str, schema: str, key: str, null_keys: int | None = None, unique: bool = False) -> DataFrame:
    """CSV with a declared schema; rows without a key are dropped, bad numbers become missing.

    ``null_keys``: how many rows without a key the file must have. ``unique``: keys must not repeat. Both are counted over
    the whole file first, and a difference raises ``ValueError``.
    """
    df = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")
    kept = df.where(F.col(key).isNotNull())
    reports = [unique_key(kept, [key])] if unique else []
    if null_keys is not None:
        reports.append(row_count(df.where(F.col(key).isNull()), null_keys, "null_keys"))
    if reports:
        require(*reports)
    return kept


def read_result_files(spark: SparkSession, folders: dict[str, str], schemas: dict[str, str]) -> DataFrame:
    """Stack result CSVs of several runs; absent columns become missing, ``run_dir`` names the run."""
    out = None
    for run, path in folders.items():
        part = spark.read.csv(path, header=True, schema=schemas[run]).withColumn("run_dir", F.lit(run))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_columns(spark: SparkSession, path: str, *cols: str) -> DataFrame:
    """Column-pruned parquet scan."""
    return spark.read.parquet(path).select(*cols)


def read_slice(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    """Parquet scan with a pushed predicate; prunes folders when the table is partitioned by ``column``."""
    return spark.read.parquet(path).where(F.col(column) == value)


def typed_results(
    df: DataFrame, keys: list[str] | None = None, forbidden: dict[str, list[str]] | None = None, flags: dict[str, Column] | None = None,
) -> DataFrame:
    """Result rows with defaults: population ``primary``, no noise, boolean flags without nulls.

    ``forbidden``: values that an origin column must not have; ``flags``: named conditions that every row must satisfy;
    ``keys``: columns that identify a row. They are checked on the typed rows before they are returned (``ValueError``).
    """
    out = _typed(df)
    rules = {f"{c}_allowed": ~F.coalesce(F.col(c).isin(v), F.lit(False)) for c, v in (forbidden or {}).items()} | (flags or {})
    reports = ([broken_rows(out, **rules)] if rules else []) + ([unique_key(out, keys)] if keys else [])
    if reports:
        require(*reports)
    return out


def _typed(df: DataFrame) -> DataFrame:
    out = df
    for c, default in (("population", F.lit("primary")), ("noise_mult", F.lit(0.0)), ("noise_add", F.lit(0.0))):
        out = out.withColumn(c, F.coalesce(F.col(c), default) if c in df.columns else default)
    return out.withColumn("descriptive_only", F.coalesce(F.col("descriptive_only").cast("boolean"), F.lit(False)))


# Fixed pattern: "<iso time> START [i/n]" or "<iso time> END [i/n]".
LOG_EVENT = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})\s+(START|END)\s+\[(\d+)/\d+\]"


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines to (stream, at, kind, job); lines of another form are dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"), F.col("_metadata.file_path").alias("stream"))

    def grab(i: int):
        return F.regexp_extract("v", LOG_EVENT, i)

    return lines.where(F.col("v").rlike(LOG_EVENT)).select(
        "stream", F.to_timestamp_ntz(grab(1), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("at"), grab(2).alias("kind"),
        grab(3).cast("long").alias("job"),
    )
