"""Folds of whole units with balanced row counts, for any number of units.

The rule is greedy: units in falling size, each to the fold with the fewest rows so far. Units of one size differ only by
their place among them, so the rule depends on the histogram of sizes alone (a split of N rows has at most sqrt(2 N)
sizes): c units of size s fill the folds like c slots in merged arithmetic progressions load + j s, the r-th unit taking
the r-th smallest slot. The histogram gives every fold's load before each size; a unit finds its slot from these loads and
its rank within its size, which running counts give however many units share a size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohera.operators.selection import running_total
from cohera.session import settle, settle_parameters


def slots_upto(loads: np.ndarray, size: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Per row: the number of slots (load + j size) at or below ``value``, over all folds."""
    steps = (value[:, None] - loads) // size[:, None] + 1
    return np.maximum(steps, 0).sum(axis=1)


def slot_value(loads: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Per row: the value of the slot with a rank (from 1), by bisection on counts."""
    lo, hi = loads.min(axis=1) - 1, loads.max(axis=1) + size * rank
    while (hi - lo > 1).any():
        mid = (lo + hi) // 2
        enough = slots_upto(loads, size, mid) >= rank
        lo, hi = np.where(enough, lo, mid), np.where(enough, mid, hi)
    return hi


def slot_fold(loads: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Per row: the fold of the slot with a rank; of slots with one value the fold with the lower number comes first."""
    value = slot_value(loads, size, rank)
    place = rank - slots_upto(loads, size, value - 1)
    here = (value[:, None] >= loads) & ((value[:, None] - loads) % size[:, None] == 0)
    return (here.cumsum(axis=1) >= place[:, None]).argmax(axis=1)


def _plan(split: list[str], k: int):
    def run(sizes: pd.DataFrame) -> pd.DataFrame:
        """Sizes of one split with their numbers of units -> the folds' loads before each size."""
        sizes = sizes.sort_values("n", ascending=False)
        load, before = np.zeros(k, dtype=np.int64), []
        for n, c in zip(sizes["n"].to_numpy(np.int64), sizes["c"].to_numpy(np.int64)):
            before.append(load.tolist())
            row, size = load[None, :], np.array([n])
            last = slot_value(row, size, np.array([c]))
            taken = np.maximum((last - 1 - load) // n + 1, 0)
            here = (last >= load) & ((last - load) % n == 0)
            rest = c - taken.sum()
            taken = taken + (here & (here.cumsum() <= rest))
            load = load + taken * n
        return sizes[[*split, "n"]].assign(loads=before)

    return run


def row_balanced_folds(df: DataFrame, split: list[str], unit: str, k: int) -> DataFrame:
    """Folds of units with nearly equal row counts: split, ``unit``, n, fold. Units of one size go in their own order."""
    units = settle(df.groupBy(*split, unit).agg(F.count(F.lit(1)).alias("n")))
    types = dict(units.dtypes)
    sizes = units.groupBy(*split, "n").agg(F.count(F.lit(1)).alias("c"))
    schema = "".join(f"{c} {types[c]}, " for c in split)
    work = sizes if split else sizes.withColumn("_all", F.lit(1))
    loads = settle_parameters(work.groupBy(*(split or ["_all"])).applyInPandas(_plan(split, k), f"{schema}n long, loads array<long>"))
    ranked = running_total(units.withColumn("_one", F.lit(1)), [*split, "n"], [unit], {"_rank": "_one"}).drop("_one")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                fold = slot_fold(np.stack(rows["loads"].to_numpy()), rows["n"].to_numpy(np.int64), rows["_rank"].to_numpy(np.int64))
                yield rows[[*split, unit, "n"]].assign(fold=fold.astype(np.int32))

    return ranked.join(loads, [*split, "n"]).mapInPandas(run, f"{schema}{unit} {types[unit]}, n long, fold int")
