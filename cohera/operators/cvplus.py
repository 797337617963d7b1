"""CV+ bounds by selection over shifted sorted residuals, where no task holds the residuals of a split.

The bounds of a row are order statistics of {mu[f] -/+ r : r a residual of fold f}: K sorted lists, each shifted by one
number. Residuals are sorted by range partitioning and cut into cells of about the square root of a split's residuals;
cell borders and counts say between which values a wanted rank lies, and only the few cells of each fold that reach into
that interval are fetched and ordered. Rows of a split with the same fold predictions ask once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohera.functions.numeric import INF, RANK_TOL
from cohera.session import settle, settle_parameters

CELL = 64  # distinct residuals of a cell at least, where a fold has them
ROWS_PER_BLOCK = 100_000  # asked rows of one split that meet its cell borders in one task
ALPHAS = (0.05, 0.1, 0.2)


def residual_cells(residuals: DataFrame, split: list[str], cell: int | None = None) -> DataFrame:
    """split, fold, low, high, n, values, copies: sorted disjoint runs of distinct residuals with their numbers."""
    counted = residuals.where("r is not null").groupBy(*split, "fold", "r").agg(F.count(F.lit(1)).alias("copies"))
    counted = settle(counted.select(*split, F.col("fold").cast("int").alias("fold"), F.col("r").cast("double").alias("r"), "copies"))
    most = counted.groupBy(*split).count().agg(F.max("count")).first()[0] or 0
    size = cell or max(CELL, math.isqrt(most))
    key = [*split, "fold"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            new = (rows[key] != rows[key].shift()).any(axis=1).to_numpy()
            start = np.flatnonzero(new)
            begin = np.concatenate([np.arange(a, b, size) for a, b in zip(start, np.append(start[1:], len(rows)))] or [np.zeros(0, np.int64)])
            end = np.append(begin[1:], len(rows))[: len(begin)]
            r, copies = rows["r"].to_numpy(), rows["copies"].to_numpy()
            columns = [batch.column(i).take(pa.array(begin)) for i in range(len(key))]
            columns += [pa.array(r[begin]), pa.array(r[end - 1] if len(end) else r[:0]), pa.array([int(copies[a:b].sum()) for a, b in zip(begin, end)], pa.int64())]
            columns += [pa.array([x[a:b] for a, b in zip(begin, end)], pa.list_(t)) for x, t in ((r, pa.float64()), (copies, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*key, "low", "high", "n", "values", "copies"])

    types = dict(counted.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in key) + ", low double, high double, n long, values array<double>, copies array<long>"
    return settle(counted.repartitionByRange(*key, "r").sortWithinPartitions(*key, "r").mapInArrow(run, schema))


def kth_shifted(shift: np.ndarray, values: list[np.ndarray], upto: list[np.ndarray], k: int) -> np.ndarray:
    """k-th smallest of {shift[f] + v : v in values[f]} for each row of ``shift``; value i of a list counts
    ``upto[i + 1] - upto[i]`` times. Bisection on counts, then the first value above the lower end."""
    some = [f for f, v in enumerate(values) if len(v)]
    lo = np.min([shift[:, f] + values[f][0] for f in some], axis=0)
    lo = lo - np.maximum(1.0, np.abs(lo))
    hi = np.max([shift[:, f] + values[f][-1] for f in some], axis=0)
    for _ in range(80):
        mid = lo + (hi - lo) / 2
        enough = sum(upto[f][np.searchsorted(values[f], mid - shift[:, f], "right")] for f in some) >= k
        lo, hi = np.where(enough, lo, mid), np.where(enough, mid, hi)
    best = np.full(len(shift), np.inf)
    for f in some:
        v, at = values[f], np.searchsorted(values[f], lo - shift[:, f], "right")
        best = np.minimum(best, np.where(at < len(v), shift[:, f] + v[np.minimum(at, len(v) - 1)], np.inf))
    return best


def wanted_ranks(n: int, alpha: float) -> tuple[int, int, bool]:
    """Ranks of the upper bound among {mu + r} and of the lower one among {r - mu}, and whether one of them is beyond n."""
    high, low = math.ceil((1 - alpha) * (n + 1) - RANK_TOL), math.floor(alpha * (n + 1) + RANK_TOL)
    return high, n + 1 - low, high > n or low < 1


def _needs(split: list[str], alphas: tuple[float, ...], kind: str):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Asked rows and the cell borders of their split -> the cells that hold each wanted rank."""
        names = [*split, "mu", "alpha", "n_cal", "inf_flag", "upper", "rest", "fold", "low", "shift"]
        if not len(left):
            return pd.DataFrame({c: [] for c in names})
        head = {c: left[c].iloc[0] for c in split}
        mu = np.stack(left["mu"].to_numpy()).astype(float)
        low, high, upto = [], [], []
        folds = right["fold"].to_numpy()
        for f in range(mu.shape[1]):
            own = right[folds == f].sort_values("low")
            low.append(own["low"].to_numpy()), high.append(own["high"].to_numpy())
            upto.append(np.append(0, own["n"].to_numpy().cumsum()).astype(np.int64))
        n = int(sum(u[-1] for u in upto))
        parts = []
        for alpha in alphas:
            k_high, k_low, inf = wanted_ranks(n, alpha)
            base = {**head, "alpha": alpha, "n_cal": n, "inf_flag": inf}
            if inf:
                parts.append(pd.DataFrame({"mu": left["mu"].to_numpy(), "upper": True, "rest": 0, "fold": -1, "low": 0.0, "shift": 0.0}).assign(**base))
                continue
            for upper, k, shift in ((True, k_high, mu), (False, k_low, -mu)):
                least, most = kth_shifted(shift, low, upto, k), kth_shifted(shift, high, upto, k)
                first = [np.maximum(np.searchsorted(high[f], least - shift[:, f]) - 1, 0) for f in range(len(low))]  # one cell more on
                last = [np.minimum(np.searchsorted(low[f], most - shift[:, f], "right") + 1, len(low[f])) for f in range(len(low))]  # both sides
                rest = k - sum(upto[f][first[f]] for f in range(len(low)))
                for f in range(len(low)):
                    count = np.maximum(last[f] - first[f], 0)
                    row = np.repeat(np.arange(len(mu)), count)
                    at = np.repeat(first[f] - np.append(0, count.cumsum())[:-1], count) + np.arange(count.sum())
                    parts.append(pd.DataFrame({
                        "mu": left["mu"].to_numpy()[row], "upper": upper, "rest": rest[row], "fold": f, "low": low[f][at], "shift": shift[row, f]}).assign(**base))
        return pd.concat(parts, ignore_index=True)[names]

    return run, f"{kind}, mu array<double>, alpha double, n_cal long, inf_flag boolean, upper boolean, rest long, fold int, low double, shift double"


def kth_of(values: Column, k: Column) -> Column:
    """k-th smallest of an array of structs (v, c), each counting c times."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(None).cast("double").alias("v"))
    step = lambda a, e: F.struct((a["s"] + e["c"]).alias("s"), F.coalesce(a["v"], F.when(a["s"] + e["c"] >= k, e["v"])).alias("v"))
    return F.aggregate(F.sort_array(values), start, step)["v"]


def asked_cells(cells: DataFrame, test: DataFrame, split: list[str], alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """One row per asked (split, mu), level, side and cell that is needed; ``rest`` is the rank within these cells."""
    asked = settle(test.select(*split, F.col("mu").cast("array<double>").alias("mu")).distinct())
    most = asked.groupBy(*split).count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, math.ceil(most / ROWS_PER_BLOCK))
    left = asked.withColumn("_block", F.pmod(F.xxhash64("mu"), F.lit(blocks)).cast("int"))
    right = cells.select(*split, "fold", "low", "high", "n").withColumn("_block", F.explode(F.array(*[F.lit(i) for i in range(blocks)])))
    types = dict(asked.dtypes)
    run, schema = _needs(split, alphas, ", ".join(f"{c} {types[c]}" for c in split))
    key = [*split, "_block"]
    return settle(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, schema))


def cv_plus(residuals: DataFrame, test: DataFrame, split: list[str], alphas: tuple[float, ...] = ALPHAS, cell: int | None = None) -> DataFrame:
    """CV+ intervals for every test row and level: ``test``, n_cal, alpha, inf_flag, lower, upper.

    ``residuals``: split columns, ``fold`` (0 to K - 1), ``r`` (one per held-out unit). ``test``: split columns, payload and
    ``mu``, an array of the K fold models' predictions, none null. Splits without residuals have infinite intervals.
    """
    cells = residual_cells(residuals, split, cell)
    needs = asked_cells(cells, test, split, alphas)
    values = F.transform(F.arrays_zip("values", "copies"), lambda e: F.struct((F.col("shift") + e["values"]).alias("v"), e["copies"].alias("c")))
    fetched = needs.where("not inf_flag").join(cells.select(*split, "fold", "low", "values", "copies"), [*split, "fold", "low"])
    by = [*split, "mu", "alpha", "n_cal", "inf_flag"]
    sides = fetched.select(*by, "upper", "rest", values.alias("values")).groupBy(*by, "upper", "rest").agg(F.flatten(F.collect_list("values")).alias("values"))
    found = sides.select(*by, "upper", kth_of(F.col("values"), F.col("rest")).alias("v"))
    bounds = found.groupBy(*by).agg(F.max(F.when(~F.col("upper"), -F.col("v"))).alias("lower"), F.max(F.when(F.col("upper"), F.col("v"))).alias("upper"))
    inf = needs.where("inf_flag").select(*by, F.lit(-INF).alias("lower"), F.lit(INF).alias("upper"))
    bounds = settle_parameters(bounds.unionByName(inf).withColumnRenamed("mu", "_mu"))
    rows = test.withColumn("_mu", F.col("mu").cast("array<double>"))
    return rows.join(bounds, [*split, "_mu"]).select(*test.columns, "n_cal", "alpha", "inf_flag", "lower", "upper")
