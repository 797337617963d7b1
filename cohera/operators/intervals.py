"""Prediction intervals: calibrate on calibration rows, apply to test rows, for every split, model and level at once."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from cohera.functions.numeric import INF, RANK_TOL, conformal_rank, normal_cdf
from cohera.functions.special import normal_quantile_udf
from cohera.operators.cvplus import cv_plus  # noqa: F401
from cohera.operators.selection import order_statistics
from cohera.session import settle_parameters

ALPHAS = (0.05, 0.1, 0.2)


def conformal_quantile(scores: DataFrame, keys: list[str], score: str, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Finite-sample quantile per key and level. Output: keys, alpha, n_cal, qhat (infinite when the rank passes n),
    inf_flag."""
    ranks = {f"_q{i}": (lambda n, a=a: conformal_rank(n, a)) for i, a in enumerate(alphas)}
    got = order_statistics(scores, keys, score, ranks, [1 - a for a in alphas])
    levels = F.explode(
        F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"_q{i}").alias("q")) for i, a in enumerate(alphas)])
    )
    return got.select(*keys, F.col("n").alias("n_cal"), levels.alias("_l")).select(
        *keys,
        F.col("_l.alpha").alias("alpha"),
        "n_cal",
        F.coalesce(F.col("_l.q"), F.lit(INF)).alias("qhat"),
        F.col("_l.q").isNull().alias("inf_flag"),
    )


def apply_quantile(test: DataFrame, qhat: DataFrame, keys: list[str], lo: Column, hi: Column, scale=None) -> DataFrame:
    """Test rows with ``lower = lo - q scale`` and ``upper = hi + q scale``.

    ``qhat`` has one row per (split, model, level): parameters of the run, not data, so it is broadcast.
    """
    s = F.lit(1.0) if scale is None else scale
    q = F.col("qhat")
    out = test.join(qhat, keys)
    return out.withColumn("lower", F.when(F.col("inf_flag"), F.lit(-INF)).otherwise(lo - q * s)).withColumn(
        "upper", F.when(F.col("inf_flag"), F.lit(INF)).otherwise(hi + q * s)
    )


def absolute_score(y: Column, pred: Column) -> Column:
    return F.abs(y - pred)


def normalised_score(y: Column, pred: Column, sigma: Column) -> Column:
    return F.abs(y - pred) / sigma


def quantile_score(y: Column, qlo: Column, qhi: Column) -> Column:
    return F.greatest(qlo - y, y - qhi)


def normal_z(alpha: float) -> float:
    """Two-sided standard normal quantile of any level."""
    return NormalDist().inv_cdf(1 - alpha / 2)


def gaussian_halfwidth(oof: DataFrame, keys: list[str], alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """z times the sample SD of out-of-fold residuals. ``oof``: keys, y, pred_oof."""
    levels = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(normal_z(a)).alias("z")) for a in alphas]))
    sd = oof.groupBy(*keys).agg(
        F.stddev_samp(F.col("y") - F.col("pred_oof")).alias("sd"), F.count(F.lit(1)).alias("n_cal")
    )
    return sd.select(*keys, "n_cal", "sd", levels.alias("_l")).select(
        *keys, F.col("_l.alpha").alias("alpha"), "n_cal", (F.col("_l.z") * F.col("sd")).alias("qhat"),
        F.lit(False).alias("inf_flag"),
    )


def cv_plus_bound(n: Column, k: Column, alpha: Column) -> Column:
    """Worst-case coverage of CV+ with n units and k folds."""
    first = F.lit(2.0) * (F.lit(1.0) - F.lit(1.0) / k) / (n / k + F.lit(1.0))
    second = (F.lit(1.0) - k / n) / (k + F.lit(1.0))
    return F.lit(1.0) - F.lit(2.0) * alpha - F.least(first, second)


def recalibration_levels(pit: DataFrame, keys: list[str], levels: list[float]) -> DataFrame:
    """Quantile recalibration: for each wanted level, the nominal level whose observed share equals it.

    The observed share at nominal level t is the share of rows with PIT at or below t. It rises at the distinct PIT
    values only, so it is inverted exactly there, with straight lines between them and from (0, 0): the wanted rank is an
    exact order statistic v, and one more pass counts the rows at and below it and finds the value before it.
    ``pit``: keys and ``pit`` in [0, 1], missing values ignored. Output: keys, level, recal.
    """
    ranks = {f"_v{i}": (lambda n, p=p: F.greatest(F.lit(1), F.ceil(n * p - RANK_TOL))) for i, p in enumerate(levels)}
    at = settle_parameters(order_statistics(pit, keys, "pit", ranks, levels))
    rows, found = pit.where("pit is not null").join(at, keys), []
    for i in range(len(levels)):
        v = F.col(f"_v{i}")
        found += [F.count_if(F.col("pit") <= v).alias(f"_le{i}"), F.count_if(F.col("pit") < v).alias(f"_lt{i}"), F.max(F.when(F.col("pit") < v, F.col("pit"))).alias(f"_b{i}")]
    got = rows.groupBy(*keys, "n", *ranks).agg(*found)

    def recal(i: int, level: float) -> Column:
        before, below = F.coalesce(F.col(f"_b{i}"), F.lit(0.0)), F.col(f"_lt{i}")
        share = F.greatest(F.lit(level) * F.col("n") - below, F.lit(0.0)) / (F.col(f"_le{i}") - below)
        return before + F.least(share, F.lit(1.0)) * (F.col(f"_v{i}") - before)

    each = F.array(*[F.struct(F.lit(float(p)).alias("level"), recal(i, p).alias("recal")) for i, p in enumerate(levels)])
    return got.select(*keys, F.inline(each))


def recalibrated_intervals(fit: DataFrame, test: DataFrame, keys: list[str], alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Gaussian intervals with recalibrated levels: ``test`` with alpha, level_lo, level_hi, lower, upper.

    ``fit`` and ``test``: keys, ``mean``, ``sd``; ``fit`` also ``y``, on rows that the model has not seen.
    """
    pit = fit.select(*keys, normal_cdf((F.col("y") - F.col("mean")) / F.col("sd")).alias("pit"))
    levels = sorted({p for a in alphas for p in (a / 2, 1 - a / 2)})
    by = settle_parameters(recalibration_levels(pit, keys, levels).groupBy(*keys).agg(*[
        F.max(F.when(F.col("level") == p, F.col("recal"))).alias(f"_r{i}") for i, p in enumerate(levels)]))
    ends = F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"_r{levels.index(a / 2)}").alias("level_lo"), F.col(f"_r{levels.index(1 - a / 2)}").alias("level_hi")) for a in alphas])
    ends = by.select(*keys, F.inline(ends))
    ends = settle_parameters(ends.withColumn("_zl", normal_quantile_udf("level_lo")).withColumn("_zh", normal_quantile_udf("level_hi")))
    side = lambda z: F.col("mean") + F.col("sd") * F.col(z)
    return test.join(ends, keys).withColumn("lower", side("_zl")).withColumn("upper", side("_zh")).drop("_zl", "_zh")


def calibration_record(scheme: str, scores: DataFrame, keys: list[str], group: str, folds: int | None = None) -> DataFrame:
    """Bookkeeping of a calibration step: scheme, number of scores, distinct groups, folds."""
    return scores.groupBy(*keys).agg(
        F.lit(scheme).alias("calib_scheme"),
        F.count(F.lit(1)).alias("k_cal_rows"),
        F.count_distinct(group).alias("k_cal_units"),
        F.lit(folds).cast("int").alias("cv_folds"),
    )
