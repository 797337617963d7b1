"""Aggregations over sample, split and result tables; long ledgers with unique keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohera.functions.numeric import finite_or_null
from cohera.operators.selection import cumulative
from cohera.sources.sinks import stack


def count_matrix(df: DataFrame, cols: list[str], quality: Column) -> DataFrame:
    """Per column: non-null, at or below zero, positive, positive and of good quality."""
    long = df.select(quality.alias("_q"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_e"))
    v = F.col("_e.v")
    return long.groupBy(F.col("_e.name").alias("target")).agg(
        F.count(v).alias("non_null"), F.count_if(v <= 0).alias("le_zero"), F.count_if(v > 0).alias("positive"),
        F.count_if((v > 0) & F.col("_q")).alias("positive_quality"))


def split_sizes(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Rows and groups per role, one row per split: n_train, n_cal, n_test, groups_train, groups_cal, groups_test."""
    per = df.groupBy(*keys, "role", group).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(*keys).pivot("role", ["train", "cal", "test"]).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("groups")).select(
        *keys, *[F.col(f"{r}_{k}").alias(f"{k}_{r}") for k in ("n", "groups") for r in ("train", "cal", "test")])


def protocol_summary(sizes: DataFrame, protocol: str = "protocol") -> DataFrame:
    """Medians, extremes and split counts per protocol (one input row per split)."""
    return sizes.groupBy(protocol).agg(
        F.count(F.lit(1)).alias("n_splits"),
        *[F.percentile(f"n_{r}", 0.5).alias(f"median_{r}") for r in ("train", "cal", "test")],
        F.min("n_test").alias("min_test"), F.max("n_test").alias("max_test"),
        F.percentile("groups_test", 0.5).alias("median_test_groups"), F.min("groups_cal").alias("min_cal_groups"))


DIRECTIONS = (64, 256)  # corners of an outline polygon in the first and the second pass
FEW = 32  # rows of a group in a batch that are not worth an outline


def _outline(rows: DataFrame, group: str) -> DataFrame:
    """Points that may be corners of their group's convex hull: ``group``, x, y, z.

    ``rows``: group, unit vector x, y, z, the group's mean cx, cy, cz, and ``narrow`` (no two points of the group are more
    than 90 degrees apart). Seen from the sphere's centre onto the plane that touches it at the mean, great circles are
    straight lines, and the distance to a fixed point is convex along them, so a point inside a polygon of other points of
    a narrow group is no end of its longest distance. Each batch drops the points inside the polygon of its own extremes
    in ``DIRECTIONS`` directions, first where the rows lie, then once more by group: outlines of outlines merge, no
    task holds a group, and a group of any size sends few rows to the second pass. Wide groups pass as they are.
    """
    def corners(p: np.ndarray, c: np.ndarray, towards: np.ndarray) -> np.ndarray:
        c = c / np.linalg.norm(c)
        side = np.cross(c, np.eye(3)[np.abs(c).argmin()])
        side /= np.linalg.norm(side)
        flat = p @ np.stack([side, np.cross(c, side)], axis=1) / (p @ c)[:, None]
        ends = (flat @ towards).argmax(axis=0)
        ends = ends[ends != np.roll(ends, 1)]  # a corner that is extreme in several directions counts once
        inside = np.ones(len(p), dtype=bool)
        for i, j in zip(ends, np.roll(ends, -1)):
            edge, to = flat[j] - flat[i], flat - flat[i]
            inside &= edge[0] * to[:, 1] - edge[1] * to[:, 0] > 1e-15
        return ~inside

    def reduce_to(directions: int):
        angle = np.linspace(0, 2 * np.pi, directions, endpoint=False)
        towards = np.stack([np.cos(angle), np.sin(angle)])

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p, c = (np.stack([b.column(i).to_numpy() for i in part], axis=1) for part in ((1, 2, 3), (4, 5, 6)))
                narrow = b.column(7).to_numpy(zero_copy_only=False)
                code = b.column(0).dictionary_encode().indices.to_numpy()
                order = np.argsort(code, kind="stable")
                keep = np.ones(len(order), dtype=bool)
                for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                    if len(at) >= FEW and narrow[at[0]]:
                        keep[at] = corners(p[at], c[at[0]], towards)
                yield b.filter(pa.array(keep))

        return reduce

    once, again = (reduce_to(n) for n in DIRECTIONS)
    rows_once = rows.mapInArrow(once, rows.schema)
    return rows_once.repartition(group).sortWithinPartitions(group).mapInArrow(again, rows.schema).select(group, "x", "y", "z")


def group_extent(df: DataFrame, group: str, lat: str, lon: str) -> DataFrame:
    """Largest great-circle distance inside each group, exact, without all pairs.

    Points become unit vectors; the farthest pair of a set lies on its convex hull, so per group only points that are
    extreme in some direction are compared first to get a lower bound L. A point can belong to a longer pair only if
    its distance to the group's centre plus the group's radius reaches L. Of the points that pass, those inside an outline
    of others go (:func:`_outline`), and the corners that are left are compared. Rows without a group or a coordinate
    do not count.
    """
    pts = df.where(F.col(group).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(group, lat, lon).distinct()
    la, lo = F.radians(lat), F.radians(lon)
    pts = pts.withColumns({"x": F.cos(la) * F.cos(lo), "y": F.cos(la) * F.sin(lo), "z": F.sin(la)})
    box = pts.groupBy(group).agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    d2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 + (F.col("z") - F.col("cz")) ** 2
    near = pts.join(box, group).withColumn("r", F.sqrt(d2))
    dirs = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, -1, 0), (1, 0, -1), (0, 1, -1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1)]
    p = F.struct("x", "y", "z")
    ends = []
    for a, b, c in dirs:
        dot = F.col("x") * a + F.col("y") * b + F.col("z") * c
        ends += [F.min_by(p, dot), F.max_by(p, dot)]
    ext = near.groupBy(group).agg(F.max("r").alias("rmax"), F.array(*ends).alias("ends"))

    def dist2(u, v):
        return (u["x"] - v["x"]) ** 2 + (u["y"] - v["y"]) ** 2 + (u["z"] - v["z"]) ** 2

    low = F.array_max(F.transform("ends", lambda u: F.array_max(F.transform("ends", lambda v: dist2(u, v)))))
    ext = ext.select(group, "rmax", F.sqrt(low).alias("low"))
    cand = near.join(ext, group).where(F.col("r") + F.col("rmax") >= F.col("low") - 1e-12)
    narrow = F.col("rmax") <= F.lit(0.7)  # pairs at most 1.4 apart, less than the chord of 90 degrees
    cand = _outline(cand.select(group, "x", "y", "z", "cx", "cy", "cz", narrow.alias("narrow")), group)
    a = cand.select(group, *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = cand.select(group, *[F.col(c).alias(f"b{c}") for c in "xyz"])
    chord2 = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 + (F.col("az") - F.col("bz")) ** 2
    best = a.join(b, group).groupBy(group).agg(F.max(chord2).alias("m"))
    km = F.lit(2 * 6371.0088) * F.asin(F.sqrt(F.least(F.lit(1.0), F.col("m") / 4)))
    return best.select(group, km.alias("extent_km"))


def log_histogram(df: DataFrame, keys: list[str], value: str, per_decade: int = 8) -> DataFrame:
    b = F.floor(F.lit(float(per_decade)) * F.log10(value)).cast("int")
    return df.where(F.col(value) > 0).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def concentration(groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Group-size ECDF and Lorenz curve per distinct size: share of groups and of rows up to that size."""
    ecdf = cumulative(groups, keys, n, F.lit(1)).select(*keys, n, (F.col("upto") / F.col("total")).alias("ecdf"))
    rows = cumulative(groups, keys, n, F.col(n)).select(*keys, n, (F.col("upto") / F.col("total")).alias("row_share"))
    return ecdf.join(rows, [*keys, n])


def cell_summary(rows: DataFrame, cell: list[str], cols: list[str], probs: tuple[float, ...] = ()) -> DataFrame:
    """Mean, SD and median (and percentiles) of each column over the splits of a cell; infinite values count apart."""
    d = rows.select(*cell, "seed", "inf_flag", *[finite_or_null(F.col(c)).alias(c) for c in cols])
    aggs = [F.count(F.lit(1)).alias("n_splits"), F.count_distinct("seed").alias("n_seeds"), F.count_if("inf_flag").alias("n_splits_infinite")]
    for c in cols:  # one value per split of a cell: short lists
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.percentile(c, 0.5).alias(f"{c}_median"), F.count(c).alias(f"{c}_finite")]
        aggs += [F.percentile(c, p).alias(f"{c}_p{round(p * 1000):03d}") for p in probs]
    return d.groupBy(*cell).agg(*aggs)


def ledger(df: DataFrame, key: Column, cols: list[str]) -> DataFrame:
    """Wide summary rows to (key, value); missing values leave no row."""
    return df.select(key.alias("_k"), F.expr(stack(cols))).where(F.col("value").isNotNull()).select(
        F.concat_ws(".", "_k", "name").alias("key"), F.col("value").cast("double").alias("value"))


def completeness_status(cells: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Found against expected splits per cell: ``complete`` only when equal and planned."""
    j = cells.join(expected, keys, "full_outer").withColumns(
        {"n_splits": F.coalesce("n_splits", F.lit(0)), "n_expected": F.coalesce("n_expected", F.lit(0))})
    ok = (F.col("n_expected") > 0) & (F.col("n_splits") == F.col("n_expected"))
    return j.withColumn("status", F.when(ok, "complete").otherwise("incomplete"))


def budget_summary(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Per-seed means first, then over seeds. ``rows``: cell, seed, draw, cov, beta_mean, beta_sd, inf_flag."""
    seed = rows.groupBy(*cell, "seed").agg(
        F.avg("cov").alias("m"), F.stddev_samp("cov").alias("w"), F.max(F.when(F.col("draw") == 0, F.col("cov"))).alias("d0"),
        F.avg("beta_mean").alias("bm"), F.avg("beta_sd").alias("bs"), F.count(F.lit(1)).alias("k"), F.count_if("inf_flag").alias("inf"))
    return seed.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("k").alias("draws_per_seed"), F.avg("m").alias("mean_cov"), F.avg("bm").alias("beta_mean"),
        F.stddev_samp("d0").alias("sd_seed_draw0"), F.stddev_samp("m").alias("sd_seed_means"), F.avg("bs").alias("beta_sd"),
        F.avg("w").alias("sd_draws_within_split"), (F.sum("inf") / F.sum("k")).alias("inf_rate"))


def local_summary(rows: DataFrame, cell: list[str], group: str) -> DataFrame:
    per = rows.groupBy(*cell, "seed").agg(
        F.avg("coverage").alias("c"), F.count_distinct(group).alias("g"), F.avg(F.col("inf_flag").cast("double")).alias("i"))
    return per.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg("c").alias("mean_cov"), F.stddev_samp("c").alias("sd_cov"),
        F.avg("g").alias("mean_n_groups"), F.avg("i").alias("inf_rate"))


def largest_gap(df: DataFrame, scopes: dict[str, Column], gap: Column, where: list[str]) -> DataFrame:
    """Largest absolute gap per scope with the row that has it (ties: smallest label)."""
    label = F.concat_ws("/", *where)
    arr = F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in scopes.items()]))
    x = df.select(F.explode(arr).alias("scope"), F.abs(gap).alias("gap"), label.alias("label"))
    return x.groupBy("scope").agg(
        F.max("gap").alias("max_gap"), F.min_by("label", F.struct((-F.col("gap")).alias("g"), "label")).alias("at"), F.count(F.lit(1)).alias("n_cells"))


def coalesce_spans(spans: DataFrame, keys: list[str], start: str, end: str, slot_seconds: int = 86_400) -> DataFrame:
    """Union of overlapping or touching spans per key: block start, block end, number of spans.

    Spans are cut into slots by their start time. One row per slot carries the latest end and the latest block start of
    the earlier slots, so a window only ever holds the spans of one slot and a key with most of the rows is spread over
    its slots. Blocks are then named by their start and added up on the map side.
    """
    by = [*keys, "_slot"]
    s = spans.withColumn("_slot", F.floor(F.unix_micros(F.col(start).cast("timestamp")) / F.lit(slot_seconds * 1_000_000)))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = s.groupBy(*by).agg(F.max(end).alias("_m")).select(*by, F.max("_m").over(earlier).alias("_carry"))
    inside = Window.partitionBy(*by).orderBy(F.col(start), F.col(end))
    seen = F.greatest(F.col("_carry"), F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    m = s.join(ends, by).withColumn("_seen", seen)
    m = m.withColumn("_open", F.when(F.col("_seen").isNull() | (F.col(start) > F.col("_seen")), F.col(start)))
    opened = m.groupBy(*by).agg(F.max("_open").alias("_o")).select(*by, F.max("_o").over(earlier).alias("_from"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = m.withColumn("_here", F.max("_open").over(upto)).join(opened, by)
    named = named.withColumn("block_start", F.coalesce("_here", "_from"))
    return named.groupBy(*keys, "block_start").agg(F.max(end).alias("block_end"), F.count(F.lit(1)).alias("n_spans"))


def pivot_cells(df: DataFrame, rows: list[str], col: str, values: list[str], what: Column) -> DataFrame:
    return df.groupBy(*rows).pivot(col, values).agg(F.first(what))


def mean_or_median(mean: Column, median: Column, extrapolates: Column, ratio: float = 2.0) -> Column:
    """The median where the mean is not reportable (mean above ``ratio`` medians, or an extrapolating model)."""
    return F.when(median.isNull(), mean).when(extrapolates | (mean > F.lit(ratio) * median), median).otherwise(mean)
