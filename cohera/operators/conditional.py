"""Coverage given the group, the class of the input, or the distance to the training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohera.operators.evaluate import covered, width
from cohera.operators.selection import median, quantiles
from cohera.session import settle_parameters


def quantile_bin(df: DataFrame, keys: list[str], value: str, bins: int = 5) -> DataFrame:
    """Adds ``bin`` 0..bins-1 by exact quantile edges, right-closed; the lowest value belongs to bin 0."""
    names = {f"_e{i}": i / bins for i in range(1, bins)}
    base = df if keys else df.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    edges = settle_parameters(quantiles(base, by, value, names).drop("n"))
    b = F.lit(0)
    for e in names:
        b = b + (F.col(value) > F.col(e)).cast("int")
    return base.join(edges, by).withColumn("bin", b).drop(*names, "_all")


def conditional_shares(rows: DataFrame, keys: list[str], split: list[str], group: str, min_n: int = 5) -> DataFrame:
    """Distribution of within-group coverage over (split, group) with at least ``min_n`` rows."""
    hit = covered(F.col("y"), F.col("lower"), F.col("upper"))
    g = rows.withColumn("_h", hit).groupBy(*keys, *split, group).agg(
        F.avg("_h").alias("cov"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)
    share = g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_group_splits"),
        *[F.avg((F.col("cov") < t).cast("double")).alias(f"share_below_{round(t * 100):03d}") for t in (0.9, 0.8, 0.5)],
        F.avg((F.col("cov") <= 0).cast("double")).alias("share_zero"),
    )
    return share.join(median(g, keys, "cov", "median_cov").drop("n"), keys)


def class_by_argmax(a: Column, cuts: list[tuple[int, str]], last: str) -> Column:
    """Class from the 0-based position of the largest element; cuts are left-closed upper ends."""
    pos = F.array_position(a, F.array_max(a)) - 1
    out = None
    for end, name in cuts:
        out = F.when(pos < end, name) if out is None else out.when(pos < end, name)
    return out.otherwise(last)


def coverage_by_class(rows: DataFrame, keys: list[str], cls: str) -> DataFrame:
    hit = covered(F.col("y"), F.col("lower"), F.col("upper"))
    return rows.where(F.col(cls).isNotNull()).groupBy(*keys, cls).agg(F.avg(hit).alias("cov"), F.count(F.lit(1)).alias("n_rows"))


def coverage_by_bin(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage and median width per bin (rows carry ``bin``)."""
    r = rows.withColumn("_h", covered(F.col("y"), F.col("lower"), F.col("upper"))).withColumn(
        "_w", width(F.col("lower"), F.col("upper")))
    by = [*keys, "bin"]
    cov = r.groupBy(*by).agg(F.avg("_h").alias("cov"), F.count(F.lit(1)).alias("n_rows"))
    return cov.join(median(r, by, "_w", "width").drop("n"), by)
