"""Point and scale models fitted on the training rows of every split at once.

Linear models never pull rows together: each group contributes its cross-product sums once, the sums are added per
split and fold, and only the p x p solve (one small row per split) runs in an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohera.functions.numeric import normal_cdf
from cohera.operators.selection import quantiles
from cohera.session import settle, settle_parameters

LOG_FLOOR = 1e-5  # fixed value: non-positive inputs are floored here before logs
RIDGE_GRID = tuple(float(v) for v in np.logspace(-3, 3, 13))


# ---------------------------------------------------------------- medians
def fit_median(train: DataFrame, split: list[str], y: str = "y") -> DataFrame:
    """Constant model: the training median per split. Output: split columns, ``pred``."""
    return quantiles(train, split, y, {"pred": 0.5}).select(*split, "pred")


def with_fallback(pred: Column, valid: Column, fallback: Column) -> Column:
    """Rows with invalid inputs get the fallback (the training median)."""
    return F.when(valid & pred.isNotNull(), pred).otherwise(fallback)


# ---------------------------------------------------------------- normal equations
def moments(df: DataFrame, by: list[str], basis: list[Column], y: str = "y") -> DataFrame:
    """Cross-product sums of (1, basis, y) per key: ``n``, ``xx`` (upper triangle, row major), ``xy``, ``yy``."""
    x = [F.lit(1.0), *basis]
    p = len(x)
    cols = {f"_x{i}": c for i, c in enumerate(x)}
    rows = df.select(*by, F.col(y).alias("_y"), *[c.alias(n) for n, c in cols.items()])
    xx = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(p) for j in range(i, p)]
    xy = [F.sum(F.col(f"_x{i}") * F.col("_y")) for i in range(p)]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*xx).alias("xx"),
        F.array(*xy).alias("xy"),
        F.sum(F.col("_y") * F.col("_y")).alias("yy"),
    )


def add_moments(df: DataFrame, by: list[str], p: int) -> DataFrame:
    """Sum of moment rows per key (p = basis size without the constant)."""
    q = p + 1
    return df.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.get("xx", F.lit(i))) for i in range(q * (q + 1) // 2)]).alias("xx"),
        F.array(*[F.sum(F.get("xy", F.lit(i))) for i in range(q)]).alias("xy"),
        F.sum("yy").alias("yy"),
    )


def _gram(xx, p: int) -> np.ndarray:
    g = np.zeros((p, p))
    g[np.triu_indices(p)] = xx
    return g + np.triu(g, 1).T


def solve_ols(mom: DataFrame, split: list[str]) -> DataFrame:
    """Least squares coefficients (constant first) from the moments. Output: split columns, ``coef`` array."""

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(xx, xy):
            b = np.asarray(b, float)
            out.append(np.linalg.lstsq(_gram(a, len(b)), b, rcond=None)[0].tolist())
        return pd.Series(out)

    return mom.select(*split, solve("xx", "xy").alias("coef"))


def linear_prediction(coef: Column, basis: list[Column]) -> Column:
    out = F.get(coef, F.lit(0))
    for i, c in enumerate(basis):
        out = out + F.get(coef, F.lit(i + 1)) * c
    return out


def powers(x: Column, degree: int) -> list[Column]:
    return [F.pow(x, F.lit(float(d))) for d in range(1, degree + 1)]


def fit_line(train: DataFrame, split: list[str], x: str, y: str = "y") -> DataFrame:
    """One-term regression in closed form. Output: split columns, ``slope``, ``intercept``."""
    return train.where(F.col(x).isNotNull()).groupBy(*split).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def fit_ridge(fold_moments: DataFrame, split: list[str], p: int, grid: tuple[float, ...] = RIDGE_GRID) -> DataFrame:
    """Ridge on standardised terms, penalty by grouped cross-validation, from per-fold moments only.

    ``fold_moments``: split columns, ``fold``, moments. Means and spreads of every inner fit come from the inner
    training folds. Output: split columns, ``penalty``, ``coef`` (on the raw scale, constant first).
    """

    def ridge(n, g, b, lam):
        mean, ybar = g[0, 1:] / n, b[0] / n
        cov = g[1:, 1:] - n * np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov) / n, 0.0))
        sd[sd == 0] = 1.0
        beta = np.linalg.solve(cov / np.outer(sd, sd) + lam * np.eye(len(sd)), (b[1:] - n * mean * ybar) / sd) / sd
        return np.r_[ybar - beta @ mean, beta]

    def per_split(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(r.n, _gram(r.xx, p + 1), np.asarray(r.xy, float), r.yy) for r in pdf.itertuples()]
        n, g, b = (sum(q[i] for q in parts) for i in range(3))
        best, pick = np.inf, 1.0
        if len(parts) > 1:
            for lam in grid:
                sse = 0.0
                for vn, vg, vb, vy in parts:
                    w = ridge(n - vn, g - vg, b - vb, lam)
                    sse += vy - 2 * w @ vb + w @ vg @ w
                if sse < best:
                    best, pick = sse, lam
        head = {c: [pdf[c].iloc[0]] for c in split}
        return pd.DataFrame({**head, "penalty": [pick], "coef": [ridge(n, g, b, pick).tolist()]})

    types = dict(fold_moments.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in split) + ", penalty double, coef array<double>"
    return fold_moments.groupBy(*split).applyInPandas(per_split, schema)  # one row per fold in each group


def leave_fold_out(fold_moments: DataFrame, split: list[str], p: int, k: int) -> DataFrame:
    """Moments of all folds but one, for each fold: ``split, fold`` (the fold left out) and the summed moments."""
    other = fold_moments.withColumn("_left", F.explode(F.array(*[F.lit(i) for i in range(k)])))
    other = other.where(F.col("_left") != F.col("fold")).drop("fold").withColumnRenamed("_left", "fold")
    return add_moments(other, [*split, "fold"], p)


# ---------------------------------------------------------------- saturating form
def moments_at(df: DataFrame, by: list, y: str) -> DataFrame:
    """Per key the number, mean and sum of squares about the mean of ``y``: by, _n, _mean, _ss (missing y do not count)."""
    return df.groupBy(*by).agg(F.count(y).alias("_n"), F.avg(y).alias("_mean"), (F.var_pop(y) * F.count(y)).alias("_ss"))


def fit_saturating(train: DataFrame, split: list[str], r: str, y: str = "y", points: int = 40, rounds: int = 3):
    """log10 y = log10(A r / (1 - r / C)): for each C the best log10 A is a mean, so C is searched on a grid.

    The error of a C depends on y only through its moments at each r, so rows of one r are added up once and each pass is
    one aggregation over distinct r x grid; later passes refine between the neighbours of the best C. C stays above
    1.01 max(r). Output: split columns, ``log_a``, ``c``.
    """
    rows = settle(moments_at(train.where(F.col(r) > 0), [*split, F.col(r).alias("_r")], y))
    lim = rows.groupBy(*split).agg((F.max("_r") * 1.01).alias("lo"))
    lim = settle_parameters(lim.withColumn("hi", F.col("lo") * 1e4))
    best = None
    for _ in range(rounds):
        steps = F.explode(F.sequence(F.lit(0), F.lit(points))).alias("i")
        ratio = F.col("hi") / F.col("lo")
        grid = lim.select(*split, "lo", "hi", steps).withColumn(
            "c", F.col("lo") * F.pow(ratio, F.col("i") / F.lit(float(points)))
        )
        e = F.col("_mean") - F.log10(F.col("_r") / F.greatest(F.lit(1.0) - F.col("_r") / F.col("c"), F.lit(1e-6)))
        n, ne = F.sum("_n"), F.sum(F.col("_n") * e)
        sse = rows.join(grid, split).groupBy(*split, "i", "c", "lo", "hi").agg(
            (ne / n).alias("log_a"), (F.sum("_ss") + F.sum(F.col("_n") * e * e) - ne * ne / n).alias("sse")
        )
        best = sse.groupBy(*split).agg(F.min_by(F.struct("i", "c", "lo", "hi", "log_a"), F.struct("sse", "i")).alias("b"))
        best = settle_parameters(best.select(*split, "b.*"))
        step = F.pow(F.col("hi") / F.col("lo"), F.lit(1.0 / points))
        lim = best.select(
            *split,
            F.greatest(F.col("lo"), F.col("c") / step).alias("lo"),
            F.least(F.col("hi"), F.col("c") * step).alias("hi"),
        )
    return best.select(*split, "log_a", "c")


def saturating_prediction(log_a: Column, c: Column, r: Column, fallback: Column) -> Column:
    """The form inside its range 0 < r < C; other rows, and splits without a fit, get the fallback (the training median)."""
    inside = (r > 0) & (r < c)
    return with_fallback(F.when(inside, log_a + F.log10(r / (F.lit(1.0) - r / c))), inside, fallback)


# ---------------------------------------------------------------- trees
def fit_boosted(train: DataFrame, features: list[str], y: str, seed: int, trees: int = 20, depth: int = 4):
    """Gradient-boosted point model (Spark ML) on the given columns; returns a transformer."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    stages = [
        VectorAssembler(inputCols=features, outputCol="features"),
        GBTRegressor(
            featuresCol="features", labelCol=y, predictionCol="pred", maxIter=trees, maxDepth=depth, stepSize=0.1,
            subsamplingRate=0.8, featureSubsetStrategy="all", minInstancesPerNode=20, seed=seed,
        ),
    ]
    return Pipeline(stages=stages).fit(train)


def forest_leaf_quantiles(
    train: DataFrame, score: DataFrame, features: list[str], y: str, id_col: str, probs: dict[str, float], seed: int,
    trees: int = 10, depth: int = 5,
) -> DataFrame:
    """Quantile model: a regression forest cuts the feature space, each (tree, leaf) keeps its training quantiles, a
    row's quantile is the mean over its leaves. Output: id, one column per quantile."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="features"),
            RandomForestRegressor(
                featuresCol="features", labelCol=y, predictionCol="_pred", leafCol="_leaf", numTrees=trees,
                maxDepth=depth, minInstancesPerNode=20, seed=seed,
            ),
        ]
    ).fit(train)

    def leaves(df: DataFrame, keep: list[str]) -> DataFrame:
        return model.transform(df).select(*keep, F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"))

    table = settle_parameters(quantiles(leaves(train, [y]), ["tree", "leaf"], y, probs).drop("n"))  # trees x 2^depth rows
    hit = leaves(score, [id_col]).join(table, ["tree", "leaf"])
    return hit.groupBy(id_col).agg(*[F.avg(q).alias(q) for q in probs])


def fit_each_split(train: DataFrame, split_values: list[tuple], split: list[str], fit: Callable) -> dict:
    """One Spark ML fit per split. The list of splits is a parameter; the rows never leave the executors."""
    out = {}
    for values in split_values:
        cond = F.lit(True)
        for c, v in zip(split, values):
            cond = cond & (F.col(c) == v)
        out[values] = fit(train.where(cond))
    return out


# ---------------------------------------------------------------- mixtures
def mixture_summary(weights: Column, means: Column, sds: Column, members: int) -> Column:
    """Struct of mixture mean, total SD and the median over members of the top component mean.

    Arrays hold the members one after another, each with the same number of components. The total variance is the
    average within components plus the average squared distance of their means from the mixture mean.
    """
    parts = F.arrays_zip(weights.alias("w"), means.alias("m"), sds.alias("s"))
    add = lambda f: F.aggregate(parts, F.lit(0.0), lambda acc, q: acc + f(q)) / F.lit(float(members))
    mean = add(lambda q: q["w"] * q["m"])
    spread = add(lambda q: q["w"] * (q["s"] * q["s"] + (q["m"] - mean) * (q["m"] - mean)))
    size = (F.size(weights) / F.lit(members)).cast("int")
    weighed = lambda k: F.transform(F.slice(parts, k * size + 1, size), lambda q, i: F.struct(q["w"], -i, q["m"].alias("m")))
    tops = F.transform(F.sequence(F.lit(0), F.lit(members - 1)), lambda k: F.array_max(weighed(k))["m"])
    tops = F.array_sort(tops)
    middle = (F.get(tops, F.lit((members - 1) // 2)) + F.get(tops, F.lit(members // 2))) / 2
    return F.struct(mean.alias("mix_mean"), F.sqrt(F.greatest(spread, F.lit(1e-12))).alias("mix_sd"), middle.alias("point"))


def mixture_quantile(weights: Column, means: Column, sds: Column, level: float, steps: int = 40) -> Column:
    """Quantile of a row's Gaussian mixture: Newton steps on its distribution function, inside one expression.

    The root lies between the least and the greatest component quantile. A step that would leave the part still open is
    replaced by its middle, so the search can't run away where the density is flat; it ends early in effect, as later
    steps move by nothing.
    """
    parts = F.arrays_zip(weights.alias("w"), means.alias("m"), sds.alias("s"))
    z = float(NormalDist().inv_cdf(level))
    single = F.transform(parts, lambda q: q["m"] + q["s"] * z)
    density = lambda u: F.exp(-u * u / 2) * F.lit(0.3989422804014327)  # noqa: E731  1 / sqrt(2 pi)

    def newton(at: Column, _i: Column) -> Column:
        x = at["x"]
        over = F.aggregate(parts, F.lit(-level), lambda acc, q: acc + q["w"] * normal_cdf((x - q["m"]) / q["s"]))
        slope = F.aggregate(parts, F.lit(0.0), lambda acc, q: acc + q["w"] / q["s"] * density((x - q["m"]) / q["s"]))
        low, high = F.when(over < 0, x).otherwise(at["low"]), F.when(over < 0, at["high"]).otherwise(x)
        step = x - over / F.greatest(slope, F.lit(1e-300))
        inside = (step > low) & (step < high)
        return F.struct(low.alias("low"), high.alias("high"), F.when(inside, step).otherwise((low + high) / 2).alias("x"))

    low, high = F.array_min(single), F.array_max(single)
    start = F.struct(low.alias("low"), high.alias("high"), ((low + high) / 2).alias("x"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, newton, lambda at: at["x"])


# ---------------------------------------------------------------- registry
# Default model names per target kind.
DEFAULT_MODELS = {
    "pigment": ["const", "ridge", "emp_oc", "emp_ndci", "boosted"],
    "sediment": ["const", "ridge", "emp_nechad", "boosted"],
    "absorption": ["const", "ridge", "emp_ratio", "boosted"],
    "depth": ["const", "ridge", "emp_ratio", "boosted"],
}


class ModelRegistry:
    """Name to factory; a factory takes (train, score) DataFrames and returns score with ``pred``."""

    def __init__(self):
        self._make: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}

    def register(self, name: str, factory: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        self._make[name] = factory

    def run(self, names: list[str], train: DataFrame, score: DataFrame) -> DataFrame:
        """All named models on one shared row set, stacked with a ``model`` column."""
        out = None
        for name in names:
            part = self._make[name](train, score).withColumn("model", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out
