"""Load checks: what a table must satisfy, as a report of violations or as a failing job.

Counts of broken rows come from one aggregation; keys are checked by grouped counts, which are combined before the
shuffle, so a key that repeats often costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def broken_rows(df: DataFrame, **rules: Column) -> DataFrame:
    """rule, violations: rows for which a rule is false or unknown."""
    counts = [F.struct(F.lit(n).alias("rule"), F.count_if(~F.coalesce(c, F.lit(False))).alias("violations")) for n, c in rules.items()]
    return df.agg(F.array(*counts).alias("_r")).select(F.inline("_r"))


def row_count(df: DataFrame, expected: int, name: str = "row_count") -> DataFrame:
    """How far the number of rows is from the expected one."""
    return df.agg(F.lit(name).alias("rule"), F.abs(F.count(F.lit(1)) - expected).alias("violations"))


def unique_key(df: DataFrame, keys: list[str], name: str = "unique_key") -> DataFrame:
    """Rows beyond the first of each key; nulls form keys of their own."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return n.agg(F.lit(name).alias("rule"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("violations"))


def join_cardinality(left: DataFrame, right: DataFrame, keys: list[str], name: str = "join_cardinality") -> DataFrame:
    """Rows of ``left`` that do not meet exactly one row of ``right``."""
    n = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    met = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).join(n, keys, "left")
    wrong = F.when(F.coalesce("_n", F.lit(0)) != 1, F.col("_rows"))
    return met.agg(F.lit(name).alias("rule"), F.coalesce(F.sum(wrong), F.lit(0)).cast("long").alias("violations"))


def non_empty(df: DataFrame, column: str, values: list[str], name: str = "non_empty") -> DataFrame:
    """Values of ``column`` that no row has, of those that must occur."""
    seen = df.agg(*[F.coalesce(F.bool_or(F.col(column) == v), F.lit(False)).alias(f"_{i}") for i, v in enumerate(values)])
    missing = sum((~F.col(f"_{i}")).cast("long") for i in range(len(values)))
    return seen.select(F.lit(name).alias("rule"), missing.cast("long").alias("violations"))


def require(*reports: DataFrame) -> None:
    """Raise with the rules that are broken; a report has a row per rule."""
    whole = reports[0]
    for r in reports[1:]:
        whole = whole.unionByName(r)
    bad = whole.where("violations <> 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.violations}" for r in sorted(bad)))
