"""Factories of the default models of a target, by name: each takes (train, score) and returns ``score`` with ``pred``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cohera.operators import models as M
from cohera.operators.balance import row_balanced_folds
from cohera.session import settle_parameters

Factory = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Inputs:
    """What the models of a table use: split columns, group, target, the terms of ridge, the log ratio, the normalised
    difference, the reflectance of the saturating form, and the numeric columns of the trees."""

    split: list[str]
    group: str
    terms: Callable[[], list[Column]]
    ratio: str
    difference: Callable[[], Column]
    reflectance: Callable[[], Column]
    features: list[str]
    y: str = "y"
    folds: int = 5
    trees: int = 20
    depth: int = 4
    seed: int = 1000


def factories(x: Inputs) -> dict[str, Factory]:
    """All models that :data:`models.DEFAULT_MODELS` names."""

    def const(train: DataFrame, score: DataFrame) -> DataFrame:
        return score.join(settle_parameters(M.fit_median(train, x.split, x.y)), x.split)

    def least_squares(basis: Callable[[], list[Column]]) -> Factory:
        """Least squares where the inputs are valid, the training median elsewhere."""

        def run(train: DataFrame, score: DataFrame) -> DataFrame:
            terms = basis()
            valid = terms[0].isNotNull()
            mom = M.add_moments(M.moments(train.where(valid), [*x.split, x.group], terms, x.y), x.split, len(terms))
            par = M.fit_median(train, x.split, x.y).withColumnRenamed("pred", "_m").join(M.solve_ols(mom, x.split).withColumnRenamed("coef", "_c"), x.split, "left")
            pred = M.with_fallback(M.linear_prediction(F.col("_c"), terms), valid, F.col("_m"))
            return score.join(settle_parameters(par), x.split).withColumn("pred", pred).drop("_m", "_c")

        return run

    def ridge(train: DataFrame, score: DataFrame) -> DataFrame:
        terms = x.terms()
        folds = row_balanced_folds(train, x.split, x.group, x.folds).drop("n").withColumnRenamed("fold", "_fold")
        mom = M.moments(train, [*x.split, x.group], terms, x.y).join(folds, [*x.split, x.group])
        mom = M.add_moments(mom.withColumnRenamed("_fold", "fold"), [*x.split, "fold"], len(terms))
        fit = settle_parameters(M.fit_ridge(mom, x.split, len(terms)).select(*x.split, F.col("coef").alias("_c")))
        return score.join(fit, x.split).withColumn("pred", M.linear_prediction(F.col("_c"), terms)).drop("_c")

    def saturating(train: DataFrame, score: DataFrame) -> DataFrame:
        known = train.withColumn("_r", x.reflectance())
        par = M.fit_median(train, x.split, x.y).withColumnRenamed("pred", "_m").join(M.fit_saturating(known, x.split, "_r", x.y).withColumnsRenamed({"log_a": "_a", "c": "_c"}), x.split, "left")
        pred = M.saturating_prediction(F.col("_a"), F.col("_c"), F.col("_r"), F.col("_m"))
        return score.join(settle_parameters(par), x.split).withColumn("_r", x.reflectance()).withColumn("pred", pred).drop("_m", "_a", "_c", "_r")

    def boosted(train: DataFrame, score: DataFrame) -> DataFrame:
        values = [tuple(r) for r in train.select(*x.split).distinct().collect()]  # the splits of the run
        fits = M.fit_each_split(train, values, x.split, lambda df: M.fit_boosted(df, x.features, x.y, x.seed, x.trees, x.depth))
        out = None
        for key, model in fits.items():
            own = F.lit(True)
            for c, v in zip(x.split, key):
                own = own & (F.col(c) == v)
            part = model.transform(score.where(own)).drop("features")
            out = part if out is None else out.unionByName(part)
        return score.withColumn("pred", F.lit(None).cast("double")).limit(0) if out is None else out

    return {
        "const": const, "ridge": ridge, "boosted": boosted, "emp_nechad": saturating,
        "emp_ratio": least_squares(lambda: [F.col(x.ratio)]),
        "emp_oc": least_squares(lambda: M.powers(F.col(x.ratio), 4)),
        "emp_ndci": least_squares(lambda: M.powers(x.difference(), 2)),
    }


def default_registry(x: Inputs) -> M.ModelRegistry:
    """A registry of all default models; ``run(models.DEFAULT_MODELS[target], ...)`` fits those of a target."""
    out = M.ModelRegistry()
    for name, make in factories(x).items():
        out.register(name, make)
    return out
