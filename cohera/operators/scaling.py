"""Scaling fitted on the training rows of each split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohera.operators.selection import quantiles
from cohera.session import settle_parameters


def scale_on_training(df: DataFrame, split: list[str], col: str, role: str = "role") -> DataFrame:
    """Adds ``robust`` (median / IQR, a zero IQR counts as 1), ``minmax`` to [-1, 1] and ``standard`` (population SD)."""
    train = df.where(F.col(role) == "train")
    q = quantiles(train, split, col, {"_q1": 0.25, "_md": 0.5, "_q3": 0.75}).drop("n")
    m = train.groupBy(*split).agg(
        F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.avg(col).alias("_mu"), F.stddev_pop(col).alias("_sd")
    )
    p = settle_parameters(q.join(m, split))
    iqr = F.when(F.col("_q3") == F.col("_q1"), F.lit(1.0)).otherwise(F.col("_q3") - F.col("_q1"))
    span = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo"))
    sd = F.when(F.col("_sd") == 0, F.lit(1.0)).otherwise(F.col("_sd"))
    out = df.join(p, split)
    return out.withColumns(
        {
            "robust": (F.col(col) - F.col("_md")) / iqr,
            "minmax": F.lit(2.0) * (F.col(col) - F.col("_lo")) / span - 1,
            "standard": (F.col(col) - F.col("_mu")) / sd,
        }
    ).drop("_q1", "_md", "_q3", "_lo", "_hi", "_mu", "_sd")
