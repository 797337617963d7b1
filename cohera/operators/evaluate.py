"""Scores of point predictions and intervals per split, group-averaged and pooled."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohera.functions.keys import hash52
from cohera.functions.numeric import INF, conformal_rank, is_infinite, pow10
from cohera.functions.special import beta_quantile_udf
from cohera.operators.selection import aggregates_with_median, median

LN10 = math.log(10.0)


def point_metrics(rows: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Median symmetric accuracy and bias in percent, log MAE, log bias, log RMSE (inputs are log10)."""
    e = rows.select(*keys, (F.col(pred) - F.col(y)).alias("_e")).withColumn("_a", F.abs("_e"))
    means = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_a").alias("logmae"),
        F.avg("_e").alias("logbias"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("logrmse"),
    )
    med_a = median(e, keys, "_a", "_ma").drop("n")
    med_e = median(e, keys, "_e", "_me").drop("n")
    out = means.join(med_a, keys).join(med_e, keys)
    return out.select(
        *keys, "n",
        (F.lit(100.0) * (F.exp(F.lit(LN10) * F.col("_ma")) - 1)).alias("mdsa"),
        (F.lit(100.0) * F.signum("_me") * (F.exp(F.lit(LN10) * F.abs("_me")) - 1)).alias("sspb"),
        "logmae", "logbias", "logrmse",
    )


def covered(y: Column, lo: Column, hi: Column) -> Column:
    return ((y >= lo) & (y <= hi)).cast("double")


def width(lo: Column, hi: Column) -> Column:
    """Multiplicative width; infinite when a bound is."""
    return F.when(is_infinite(lo) | is_infinite(hi), F.lit(INF)).otherwise(pow10(hi - lo))


def interval_score(y: Column, lo: Column, hi: Column, alpha: Column) -> Column:
    """Winkler score; infinite when a bound is infinite."""
    below = F.when(y < lo, F.lit(2.0) / alpha * (lo - y)).otherwise(0.0)
    above = F.when(y > hi, F.lit(2.0) / alpha * (y - hi)).otherwise(0.0)
    return F.when(is_infinite(lo) | is_infinite(hi), F.lit(INF)).otherwise((hi - lo) + below + above)


def interval_rows(rows: DataFrame, y: str = "y", lo: str = "lower", hi: str = "upper", alpha: str = "alpha"):
    c = F.col
    return rows.withColumns(
        {
            "hit": covered(c(y), c(lo), c(hi)),
            "width": width(c(lo), c(hi)),
            "score": interval_score(c(y), c(lo), c(hi), c(alpha)),
            "is_inf": (is_infinite(c(lo)) | is_infinite(c(hi))).cast("double"),
        }
    )


def group_coverage(rows: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Per-group coverage table: keys, group, coverage, n."""
    hit = covered(F.col("y"), F.col("lower"), F.col("upper"))
    return rows.withColumn("_h", hit).groupBy(*keys, group).agg(
        F.avg("_h").alias("coverage"), F.count(F.lit(1)).alias("n")
    )


def interval_metrics(rows: DataFrame, keys: list[str], group: str, min_group_n: int = 10) -> DataFrame:
    """All interval metrics per key. Group means are means of within-group means, never pooled."""
    by = [*keys, group]
    r = interval_rows(rows).select(*by, "hit", "width", "score", "is_inf")
    sums = {"n": F.count(F.lit(1)), "hits": F.sum("hit"), "scores": F.sum("score"), "infs": F.sum("is_inf")}
    per = aggregates_with_median(r, by, "width", "med_w", sums)
    cov = F.col("hits") / F.col("n")
    big = F.col("n") >= min_group_n
    out = per.groupBy(*keys).agg(
        F.avg(cov).alias("cov_group"),
        (F.sum("hits") / F.sum("n")).alias("cov_pooled"),
        F.min(F.when(big, cov)).alias("cov_worst"),
        F.count_if(big).alias("n_big_groups"),
        F.avg("med_w").alias("width_group"),
        F.avg(F.log10("med_w")).alias("width_group_log10"),
        F.avg(F.col("scores") / F.col("n")).alias("score_group"),
        (F.sum("scores") / F.sum("n")).alias("score_pooled"),
        (F.sum("infs") / F.sum("n")).alias("inf_rate"),
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("n").alias("n_rows"),
    )
    pooled = median(r, keys, "width", "width_pooled_median").drop("n")
    return out.join(pooled, keys)


BLOCK = 8_192  # groups of a key that meet in one task


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 32-bit numbers (held in 64 bits)."""
    low = np.uint64(0xFFFFFFFF)
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(0x7FEB352D)) & low
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(0x846CA68B)) & low
    return x ^ (x >> np.uint64(16))


def _share(key: int, b: int, groups: int, block: int, at_most: int) -> np.ndarray:
    """Per replicate: how many of its ``groups`` draws fall into a block, by halving the range of blocks.

    A node's draws go to its left half by a binomial law, from a generator keyed by the node, so every task on the path
    finds the same numbers, and the counts of all blocks are multinomial.
    """
    blocks = -(-groups // at_most)
    size = lambda x: min(x * at_most, groups)
    lo, hi, n = 0, blocks, np.full(b, groups, dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.random.default_rng([key, lo, hi]).binomial(n, (size(mid) - size(lo)) / (size(hi) - size(lo)))
        if block < mid:
            hi, n = mid, left
        else:
            lo, n = mid, n - left
    return n


def _replicate_sums(keys: list[str], b: int, at_most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One block of a key's groups -> the sums of its draws in every replicate."""
        pdf = pdf.sort_values("_rank")
        m, block = len(pdf), int(pdf["_block"].iloc[0])
        hits, n = pdf["hits"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        key = int(pdf["_key"].iloc[0]) & 0xFFFFFFFF
        draws = _share(key, b, int(pdf["_n"].iloc[0]), block, at_most)
        table = np.stack([hits / n, hits, n], axis=1).astype(float)
        out = np.zeros((b, 3))
        start = _mix(np.uint64(key) ^ _mix(np.arange(b, dtype=np.uint64)))
        for r in range(b):
            slot = np.arange(draws[r], dtype=np.uint64) + np.uint64(block * at_most)
            at = (_mix((start[r] + slot) & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
            out[r] = np.bincount(at.astype(np.int64), minlength=m) @ table
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys}, "cov": [out[:, 0]], "hits": [out[:, 1]], "n": [out[:, 2]], "groups": [int(pdf["_n"].iloc[0])]})

    return run


def cluster_bootstrap(groups: DataFrame, keys: list[str], group: str, b: int = 2000, seed: int = 0, level=0.95, block: int = BLOCK):
    """Percentile interval of both coverages under resampling of whole groups.

    ``groups``: keys, group, hits, n. A replicate draws as many groups as there are, with replacement. Slot i of
    replicate r draws by a number keyed by (keys, seed, r, i), and a task adds its draws up in vectors of ``b`` sums: no row
    per group and replicate is made, and memory is bounded by ``b`` and ``block``. A key with more groups is cut into
    blocks, among which the draws of a replicate are dealt by a multinomial law first.
    Output: keys, cov_lo, cov_hi, pooled_lo, pooled_hi.
    """
    from cohera.operators.splits import dense_rank_by_hash

    h = hash52("bootrank", *[F.col(k) for k in keys], F.col(group))
    ranked = dense_rank_by_hash(groups.select(*keys, group, "hits", "n").withColumn("_h", h), keys, "_h", group)
    ranked = ranked.withColumn("_block", F.floor((F.col("_rank") - 1) / block)).withColumn("_key", hash52(F.lit(f"boot{seed}"), *[F.col(k) for k in keys]))
    types = dict(groups.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", cov array<double>, hits array<double>, n array<double>, groups long"
    sums = ranked.drop(group).groupBy(*keys, "_block").applyInPandas(_replicate_sums([*keys], b, block), schema)
    parts = sums.select(*keys, "groups", F.posexplode(F.arrays_zip("cov", "hits", "n")).alias("_r", "_s"))  # b rows a block
    means = parts.groupBy(*keys, "groups", "_r").agg(
        (F.sum("_s.cov") / F.col("groups")).alias("cov"), (F.sum("_s.hits") / F.sum("_s.n")).alias("pooled"))
    a = (1 - level) / 2
    # b replicates per key: a fixed, small number of values
    return means.groupBy(*keys).agg(
        F.percentile("cov", a).alias("cov_lo"),
        F.percentile("cov", 1 - a).alias("cov_hi"),
        F.percentile("pooled", a).alias("pooled_lo"),
        F.percentile("pooled", 1 - a).alias("pooled_hi"),
    )


def beta_law(n: Column, alpha: Column) -> dict[str, Column]:
    """Coverage law of split conformal with n exchangeable units: rank, mean, SD, infinite flag."""
    k = conformal_rank(n, alpha)
    inf = k > n
    a, b = k, n + 1 - k
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return {
        "beta_k": k,
        "beta_mean": F.when(inf, F.lit(1.0)).otherwise(k / (n + 1)),
        "beta_sd": F.when(inf, F.lit(0.0)).otherwise(sd),
        "beta_infinite": inf,
    }


def beta_quantiles(df: DataFrame, n: str, alpha: str, level: float = 0.95) -> DataFrame:
    """Adds the central quantiles of the coverage law (Arrow UDF on summary rows)."""
    k = conformal_rank(F.col(n), F.col(alpha))
    ok = k <= F.col(n)
    a, b = F.when(ok, k.cast("double")), F.when(ok, (F.col(n) + 1 - k).cast("double"))
    lo, hi = (1 - level) / 2, 0.5 + level / 2
    return df.withColumn("beta_q_lo", F.coalesce(beta_quantile_udf(F.lit(lo), a, b), F.lit(1.0))).withColumn(
        "beta_q_hi", F.coalesce(beta_quantile_udf(F.lit(hi), a, b), F.lit(1.0))
    )

