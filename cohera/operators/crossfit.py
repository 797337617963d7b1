"""Fits on all folds but one, for every fold at once, and the predictions they give.

Nothing is copied per left-out fold. What a fit needs is added up per fold; the statistics of all other folds are the sum
without the own fold's part. That holds for sums (normal equations) and, through counts, for order statistics: the count
of values at or below v in the other folds is the count of all less the count of the own fold. A model without such
statistics is fitted on a filter of the rows, once per fold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohera.operators import models as M
from cohera.operators.selection import ACCURACY, running_total
from cohera.session import settle, settle_parameters

GRID = 256  # sketch levels per fold; they only set how wide the bracket is


def _ranks(n: Column | np.ndarray, p: float):
    """Ranks (from 1) between which the p-quantile of n values is interpolated, and its place between them."""
    floor, ceil = (np.floor, np.ceil) if not isinstance(n, Column) else (F.floor, F.ceil)
    at = n * p - p
    return floor(at) + 1, ceil(at) + 1, at - floor(at)


def _bracket(folds: pd.DataFrame, k: int, p: float) -> tuple[float, float]:
    """Values between which the p-quantile of every set of k - 1 folds lies, from sketches of the folds."""
    n, low, high = (folds[c].to_numpy(float) for c in ("n", "low", "high"))
    edges = [np.asarray(e, float) for e in folds["edges"]]
    levels = np.arange(GRID + 1) / GRID
    v = np.unique(np.concatenate([*edges, low, high]))
    least, most = np.zeros((len(n), len(v))), np.zeros((len(n), len(v)))  # bounds of the counts at or below v, and below v
    for g, e in enumerate(edges):
        at = np.searchsorted(e, v, "right") - 1
        least[g] = np.where(v >= high[g], n[g], np.where(at < 0, 0, np.floor(n[g] * np.maximum(0, levels[np.maximum(at, 0)] - 2 / ACCURACY)) - 1))
        to = np.searchsorted(e, v, "left")
        most[g] = np.where(v <= low[g], 0, np.where(to > GRID, n[g], np.ceil(n[g] * np.minimum(1, levels[np.minimum(to, GRID)] + 2 / ACCURACY)) + 1))
    lo, hi = np.inf, -np.inf
    own = folds["fold"].to_numpy()
    for f in range(k):
        part = own != f
        m = n[part].sum()
        if m == 0:
            continue
        first, last, _ = _ranks(m, p)
        enough = np.flatnonzero(least[part].sum(axis=0) >= last)
        few = np.flatnonzero(most[part].sum(axis=0) <= first - 1)
        hi, lo = max(hi, v[enough[0]]), min(lo, v[few[-1]])
    return lo, hi


def complement_quantile(df: DataFrame, split: list[str], fold: str, value: str, k: int, p: float = 0.5, name: str = "pred") -> DataFrame:
    """Linear-interpolation p-quantile of ``value`` over all folds but one: split, ``fold`` (the one left out), ``name``.

    Sketches per fold bracket all k quantiles of a split; rows below the bracket are counted, those above are dropped,
    and values inside are counted per fold where they lie. Running counts per fold over the distinct values inside, dealt
    by ranges, give every complement's count at once. Missing values are ignored; a fold without rows counts none.
    """
    rows = df.where(F.col(value).isNotNull()).select(*split, F.col(fold).cast("int").alias("fold"), F.col(value).cast("double").alias("v"))
    sketch = rows.groupBy(*split, "fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("edges"))
    types = dict(rows.dtypes)
    head = ", ".join(f"{c} {types[c]}" for c in split)

    def bracket(folds: pd.DataFrame) -> pd.DataFrame:  # k rows of one split
        lo, hi = _bracket(folds, k, p)
        n = np.zeros(k, dtype=np.int64)
        n[folds["fold"].to_numpy()] = folds["n"].to_numpy()
        return pd.DataFrame({**{c: [folds[c].iloc[0]] for c in split}, "lo": [lo], "hi": [hi], "sizes": [n.tolist()]})

    around = settle_parameters(sketch.groupBy(*split).applyInPandas(bracket, f"{head}, lo double, hi double, sizes array<long>"))
    inside = F.when(F.col("v") >= F.col("lo"), F.col("v"))
    held = rows.join(around.select(*split, "lo", "hi"), split).where(F.col("v") <= F.col("hi")).select(*split, "fold", inside.alias("v"))
    parts = {f"_c{f}": F.count(F.when(F.col("fold") == f, F.lit(1))).alias(f"_c{f}") for f in range(k)}
    held = held.groupBy(*split, "v").agg(*parts.values())  # counts below the bracket stand at null, which sorts first
    upto = running_total(held, split, ["v"], {f"_u{f}": c for f, c in enumerate(parts)})
    total = sum((F.col(f"_u{f}") for f in range(k)), F.lit(0))
    all_rows = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)
    found = upto.join(around, split).where("v is not null")
    wanted, size = [], {}
    for f in range(k):
        size[f] = all_rows - F.get("sizes", F.lit(f))
        first, last, _ = _ranks(size[f], p)
        wanted += [F.min(F.when(total - F.col(f"_u{f}") >= r, F.col("v"))).alias(f"_{s}{f}") for s, r in (("a", first), ("b", last))]
    got = found.groupBy(*split, "sizes").agg(*wanted)
    out = F.array(*[F.struct(F.lit(f).alias("fold"), F.when(size[f] > 0, F.struct(
        F.col(f"_a{f}").alias("a"), F.col(f"_b{f}").alias("b"), _ranks(size[f], p)[2].alias("w"))).alias("q")) for f in range(k)])
    got = got.select(*split, F.inline(out)).where("q is not null")
    lost = F.raise_error(F.lit("a quantile sketch missed its bracket")).cast("double")
    q = F.when(F.col("q.a").isNull() | F.col("q.b").isNull(), lost).when(F.col("q.a") == F.col("q.b"), F.col("q.a"))
    return got.select(*split, F.col("fold").alias(fold), q.otherwise(F.col("q.a") + (F.col("q.b") - F.col("q.a")) * F.col("q.w")).alias(name))


@dataclass(frozen=True)
class FoldModel:
    """A model in two steps: ``fit(rows, split, fold, k)`` gives one row of parameters (a column ``par``) per split and
    left-out fold; ``predict(par)`` is a column over a row's own columns."""

    fit: Callable[[DataFrame, list[str], str, int], DataFrame]
    predict: Callable[[Column], Column]


def constant(y: str = "y", digits: int | None = None) -> FoldModel:
    """The median of the other folds."""

    def fit(rows, split, fold, k):
        value = F.col("pred") if digits is None else F.round("pred", digits)
        return complement_quantile(rows, split, fold, y, k).select(*split, fold, F.struct(value.alias("pred")).alias("par"))

    return FoldModel(fit, lambda par: par["pred"])


def _with_median(fitted: DataFrame, rows: DataFrame, split: list[str], fold: str, y: str, k: int) -> DataFrame:
    med = complement_quantile(rows, split, fold, y, k, name="median")
    return med.join(fitted, [*split, fold], "left").select(*split, fold, F.struct("coef", "median").alias("par"))


def _fold_moments(rows: DataFrame, split: list[str], fold: str, group: str, basis: list[Column], valid: Column, y: str) -> DataFrame:
    rows = rows.where(valid) if fold == "fold" else rows.where(valid).drop("fold").withColumnRenamed(fold, "fold")
    mom = M.moments(rows, [*split, "fold", group], basis, y)
    return settle_parameters(M.add_moments(mom, [*split, "fold"], len(basis)))


def _predict(basis: list[Column], valid: Column) -> Callable[[Column], Column]:
    return lambda par: M.with_fallback(M.linear_prediction(par["coef"], basis), valid, par["median"])


def linear(basis: list[Column], valid: Column, group: str, y: str = "y") -> FoldModel:
    """Least squares on ``basis`` where ``valid``; the median of the other folds elsewhere."""

    def fit(rows, split, fold, k):
        mom = M.leave_fold_out(_fold_moments(rows, split, fold, group, basis, valid, y), split, len(basis), k)
        return _with_median(M.solve_ols(mom, [*split, "fold"]).withColumnRenamed("fold", fold), rows, split, fold, y, k)

    return FoldModel(fit, _predict(basis, valid))


def ridge(basis: list[Column], valid: Column, group: str, y: str = "y", grid: tuple[float, ...] = M.RIDGE_GRID) -> FoldModel:
    """Ridge on standardised terms; the penalty of a fit is chosen by cross-validation over its own k - 1 folds."""

    def fit(rows, split, fold, k):
        mom = _fold_moments(rows, split, fold, group, basis, valid, y)
        others = mom.withColumn("_left", F.explode(F.array(*map(F.lit, range(k))))).where(F.col("_left") != F.col("fold"))  # k (k - 1) rows
        fitted = M.fit_ridge(others, [*split, "_left"], len(basis), grid).withColumnRenamed("_left", fold)
        return _with_median(fitted.select(*split, fold, "coef"), rows, split, fold, y, k)

    return FoldModel(fit, _predict(basis, valid))


def cross_fit(model: FoldModel, rows: DataFrame, split: list[str], fold: str, k: int) -> DataFrame:
    """Settled parameters per split and left-out fold."""
    return settle_parameters(model.fit(rows, split, fold, k))


def out_of_fold(model: FoldModel, params: DataFrame, rows: DataFrame, split: list[str], fold: str, name: str = "pred_oof") -> DataFrame:
    """``rows`` with the prediction of the fit that did not see their fold."""
    return rows.join(params, [*split, fold]).withColumn(name, model.predict(F.col("par"))).drop("par")


def fold_predictions(model: FoldModel, params: DataFrame, rows: DataFrame, split: list[str], fold: str, name: str = "mu") -> DataFrame:
    """``rows`` with the array of all k fits' predictions, in the order of the left-out folds."""
    arr = params.groupBy(*split).agg(F.transform(F.sort_array(F.collect_list(F.struct(fold, "par"))), lambda e: e["par"]).alias("_pars"))  # k entries
    return rows.join(settle_parameters(arr), split).withColumn(name, F.transform("_pars", model.predict)).drop("_pars")


def cross_fit_any(
    factory: Callable[[DataFrame, DataFrame], DataFrame], rows: DataFrame, test: DataFrame, split: list[str], fold: str, k: int, test_id: str,
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and fold predictions of any registered model.

    ``factory(train, score)`` returns ``score`` with ``pred`` for all splits, as those of :class:`models.ModelRegistry`
    do. The rows are written once; a fold's fit reads all but its own. Returns ``rows`` with pred_oof, and split,
    ``test_id``, mu (by left-out fold).
    """
    rows, test = settle(rows), settle(test)
    oof, asked = None, None
    for f in range(k):
        own, left = F.col(fold) == f, rows.where(F.col(fold) != f)
        both = rows.where(own).withColumn("_test", F.lit(False)).unionByName(test.withColumn("_test", F.lit(True)), allowMissingColumns=True)
        scored = settle(factory(left, both))
        part = scored.where("not _test").drop("_test").withColumnRenamed("pred", "pred_oof")
        more = scored.where("_test").select(*split, test_id, F.lit(f).alias("_f"), "pred")
        oof = part if oof is None else oof.unionByName(part)
        asked = more if asked is None else asked.unionByName(more)
    mu = F.transform(F.sort_array(F.collect_list(F.struct("_f", "pred"))), lambda e: e["pred"])  # k entries
    return oof, asked.groupBy(*split, test_id).agg(mu.alias("mu"))
