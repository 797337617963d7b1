"""Exact nearest training rows by pivots: cells around pivots, the triangle inequality, and a bounded second round.

Training rows lie in the cell of their nearest pivot. A test row first visits its own cell; the k-th distance found there
bounds the true one. Every other cell whose ring around its pivot (least to greatest distance of its rows) comes no nearer
to the test row than that bound can't hold a nearer neighbour and is left out of the second round; so is a cell whose
half-space, on its pivot's side, begins beyond the bound. Equal training vectors are one row with a count. A test row
travels once to a lot of ``LOT_CELLS`` cells, with the list of those that it visits there; a lot with more than
``LOT_CELLS * CELL_ROWS`` rows is cut into tiles, and its test rows are dealt in parts, so that a task holds bounded blocks
of both sides. Blocks are compared by matrix products, and exact sums decide what these leave (``distances``).

Pivots only steer the work: they are the training rows with the least hashes, at most ``PIVOTS`` a split, and any choice
gives the same distances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohera.operators.distances import Known, distances, nearest
from cohera.operators.selection import first_k_per_group
from cohera.session import settle, settle_parameters

CELL_ROWS = 4_096
LOT_CELLS = 16
GUESTS = 32_768  # test rows that meet a lot in one task
PIVOTS = 512
CHUNK = 256
SLACK = 1e-9  # relative: computed distances may be this far from the true ones


def standardised(train: DataFrame, test: DataFrame, split: list[str], id_col: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``z``, the vector in units of the training rows of its split (a constant component stays)."""
    pos = train.select(*split, F.posexplode(vec).alias("j", "v"))
    stat = pos.groupBy(*split, "j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    stat = settle_parameters(stat.groupBy(*split).agg(F.sort_array(F.collect_list(F.struct("j", "m", "s"))).alias("_st")))
    z = F.zip_with(vec, "_st", lambda v, t: (v.cast("double") - t["m"]) / F.when(t["s"] == 0, 1.0).otherwise(t["s"]))
    return tuple(df.join(stat, split).select(*split, F.col(id_col).alias("_id"), z.alias("z")) for df in (train, test))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Pivots:
    """Per split: the pivots, and of each cell the number of rows and the ring they lie in. Bounded by ``PIVOTS`` rows."""

    def __init__(self, split: list[str], rows: list, rings: list | None = None):
        self.split = split
        self.points: dict[tuple, np.ndarray] = {}
        for r in rows:
            self.points.setdefault(tuple(r[c] for c in split), []).append(r["z"])
        self.points = {k: np.array(sorted(v)) for k, v in self.points.items()}
        self.apart: dict[tuple, np.ndarray] = {}
        self.rings = {k: np.tile([np.inf, -np.inf], (len(v), 1)) for k, v in self.points.items()}
        for r in rings or []:
            self.rings[tuple(r[c] for c in split)][r["cell"]] = r["low"], r["high"]

    def keys(self, batch: pa.RecordBatch) -> list[tuple]:
        return list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in self.split))) if self.split else [()] * len(batch)

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds cell (nearest pivot) and away (distance to it)."""
        for batch in batches:
            z, keys = _matrix(batch.column("z")), np.empty(len(batch), dtype=object)
            keys[:] = self.keys(batch)
            cell, away = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch))
            for key in set(keys):
                at = np.flatnonzero([k == key for k in keys])
                for part in np.array_split(at, -(-len(at) // CHUNK)):
                    d = distances(z[part], self.points[key])
                    cell[part], away[part] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    def others(self, key: tuple, z: np.ndarray, own: np.ndarray, bound: np.ndarray) -> list[np.ndarray]:
        """Per test row: the cells besides its own that may hold a training row within ``bound``."""
        points, ring = self.points[key], self.rings[key]
        d = distances(z, points)
        apart = self.apart.get(key)
        if apart is None:
            apart = self.apart[key] = distances(points, points)
        least = np.maximum(ring[None, :, 0] - d, d - ring[None, :, 1])
        near = d.min(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):  # rows of a cell are nearer to its pivot than to any other
            half = (np.square(d) - np.square(near)[:, None]) / (2 * apart[d.argmin(axis=1)])
        least = np.maximum(least, np.where(np.isfinite(half), half, 0.0))
        may = least * (1 - SLACK) - SLACK <= bound[:, None]
        may &= np.isfinite(ring[None, :, 0])
        may[np.arange(len(z)), own] = False
        return [np.flatnonzero(m) for m in may]


def _visits(test: DataFrame, train: DataFrame, split: list[str], cells: DataFrame, k: int, types: dict[str, str], cell_rows: int) -> DataFrame:
    """split, _id, d: up to k least distances of each test row (z, lot, cells, bound) for each tile of the lot it visits;
    distances above the bound may be missing."""
    by = [*split, "lot"]
    lot = F.floor(F.col("cell") / LOT_CELLS).cast("int").alias("lot")
    tiles = settle_parameters(cells.groupBy(*split, lot).agg(F.ceil(F.sum("n") / (cell_rows * LOT_CELLS)).cast("int").alias("tiles")))
    guests = settle_parameters(test.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / GUESTS).cast("int").alias("parts")))
    lots = tiles.join(guests, by)
    tr = train.select(*split, lot, "cell", "z", "copies").join(lots, by).withColumn("tile", F.pmod(F.xxhash64("z"), "tiles").cast("int"))
    tr = tr.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("tiles", "parts")
    te = test.join(lots, by).withColumn("part", F.pmod(F.xxhash64("_id"), "parts").cast("int"))
    te = te.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles", "parts")
    key = [*by, "tile", "part"]

    def block(keys, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        head = dict(zip(split, keys))
        if left.empty or right.empty:
            return pd.DataFrame({"_id": [], "d": []}).assign(**head)[[*split, "_id", "d"]]
        left = left.sort_values("cell", kind="stable")
        asked, bound, copies = np.vstack(right["z"].to_list()), right["bound"].to_numpy(), left["copies"].to_numpy()
        known, in_cell = Known(np.vstack(left["z"].to_list())), left["cell"].to_numpy()
        visits = right["cells"].to_list()
        row, cell = np.repeat(np.arange(len(asked)), [len(c) for c in visits]), np.concatenate(visits)
        best = np.full((len(asked), k), np.inf)
        for c in np.unique(cell):
            a, b = np.searchsorted(in_cell, [c, c + 1])
            at = row[cell == c]
            best[at] = nearest(asked[at], known, copies, best[at], bound[at], a, b)
        out = pd.DataFrame({"_id": np.repeat(right["_id"].to_numpy(), k), "d": best.ravel()})
        return out[np.isfinite(out["d"])].assign(**head)[[*split, "_id", "d"]]

    schema = ", ".join(f"{c} {types[c]}" for c in split) + f", _id {types['_id']}, d double"
    return tr.groupBy(*key).cogroup(te.groupBy(*key)).applyInPandas(block, schema)


class Neighbours:
    """The two rounds over one pair of tables; ``first`` and ``second`` hold the visits, for counting."""

    def __init__(self, train: DataFrame, test: DataFrame, split: list[str], id_col: str, vec: str, k: int, cell_rows: int = CELL_ROWS, pivots: int = PIVOTS):
        self.split, self.k = split, k
        train, test = standardised(train, test, split, id_col, vec)
        types = dict(test.dtypes)
        train = settle(train.groupBy(*split, "z").agg(F.count(F.lit(1)).alias("copies")))
        counts = train.groupBy(*split).count().agg(F.max("count")).first()[0] or 0
        wanted = min(pivots, math.ceil(counts / cell_rows))
        order = F.xxhash64("z")
        if wanted > 1:
            points = first_k_per_group(train, split, [order.asc(), F.col("z").asc()], wanted).select(*split, "z").collect()
        else:  # one cell a split: any row is its pivot
            points = train.groupBy(*split).agg(F.min("z").alias("z")).collect()
        place = Pivots(split, points).place
        schema = ", ".join(f"{c} {types[c]}" for c in split)
        schema += ", " if split else ""
        placed = lambda df, more: settle(df.mapInArrow(place, f"{schema}{more}, cell int, away double"))
        self.train = placed(train.select(*split, "z", "copies"), "z array<double>, copies long")
        self.test = placed(test.select(*split, "z", "_id"), f"z array<double>, _id {types['_id']}")
        self.cells = settle_parameters(self.train.groupBy(*split, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")))
        home = self.test.select(*split, "_id", "z", F.floor(F.col("cell") / LOT_CELLS).cast("int").alias("lot"), F.array("cell").alias("cells"), F.lit(float("inf")).alias("bound"))
        near = _visits(home, self.train, split, self.cells, k, types, cell_rows)
        self.first, self.second = self.test.select(*split, "_id", "cell"), None
        if wanted > 1:
            near = settle(self._best(near))
            more = settle(self._others(near, Pivots(split, points, self.cells.collect()), f"{schema}_id {types['_id']}, z array<double>, bound double, lot int, cells array<int>"))
            self.second = more.select(*split, "_id", F.explode("cells").alias("cell"))
            near = near.unionByName(_visits(more, self.train, split, self.cells, k, types, cell_rows))
        self.distances = self._best(near)

    def _best(self, near: DataFrame) -> DataFrame:
        return first_k_per_group(near, [*self.split, "_id"], [F.col("d").asc()], self.k).select(*self.split, "_id", "d")

    def _others(self, near: DataFrame, pivots: Pivots, schema: str) -> DataFrame:
        """The visits of the second round: one row per test row and lot, with the cells to visit there."""
        split, by = self.split, [*self.split, "_id"]
        bound = near.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= self.k, F.max("d")).otherwise(F.lit(float("inf"))).alias("bound"))
        rows = self.test.join(bound, by, "left").select(*split, "_id", "z", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, len(whole), CHUNK):
                    batch = whole.slice(a, CHUNK)
                    keys, z = pivots.keys(batch), _matrix(batch.column("z"))
                    own, bound = batch.column("cell").to_numpy(), batch.column("bound").to_numpy()
                    row, lot, ends, cell = [], [], [0], [np.zeros(0, np.int32)]
                    for key in set(keys):
                        at = np.flatnonzero([k == key for k in keys])
                        for i, c in zip(at, pivots.others(key, z[at], own[at], bound[at])):
                            lots, start = np.unique(c // LOT_CELLS, return_index=True)
                            row += [i] * len(lots)
                            lot += lots.tolist()
                            ends += (ends[-1] + np.append(start[1:], len(c))).tolist() if len(c) else []
                            cell.append(c.astype(np.int32))
                    kept = [batch.column(c).take(pa.array(row, pa.int64())) for c in (*split, "_id", "z", "bound")]
                    cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(cell)))
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(lot, pa.int32()), cells], names=[*split, "_id", "z", "bound", "lot", "cells"])

        return rows.mapInArrow(run, schema)


def knn_mean_distance(train: DataFrame, test: DataFrame, split: list[str], id_col: str, vec: str, k: int = 5, cell_rows: int = CELL_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """Mean distance to the k nearest training vectors (all, if fewer), in space standardised on the training rows of the
    split: split, id, dist. ``train`` and ``test``: rows with non-null vectors of one length and ids unique in a split."""
    best = Neighbours(train, test, split, id_col, vec, k, cell_rows, pivots).distances
    return best.groupBy(*split, F.col("_id").alias(id_col)).agg(F.avg("d").alias("dist"))
