"""Joins with checks, theta joins without all-pairs work, and set operations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohera.functions.numeric import EARTH_RADIUS_KM, haversine_km
from cohera.operators.distances import ROWS, Known, squares
from cohera.operators.selection import first_k_per_group
from cohera.session import settle, settle_parameters


def join_one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails the job if a key repeats on either side."""
    return _unique(a, keys, "left").join(_unique(b, keys, "right"), keys)


def join_many_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join onto a table with unique keys; a repeated key on the right fails the job."""
    return a.join(_unique(b, keys, "right"), keys, "left")


def _unique(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """The rows themselves, after a grouped check: map-side counts keep a hot key from piling up."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_r"))
    bad = F.raise_error(F.concat(F.lit(f"repeated key on the {side} side: "), F.concat_ws("|", *keys)))
    ok = F.when(F.col("_n") > 1, bad.cast("boolean")).otherwise(F.lit(True))
    return g.where(ok).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def paired(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tags: tuple[str, str]) -> DataFrame:
    """Full outer pairing with suffixes; ``pairing`` tells whether a key has both sides."""
    x = a.select(*keys, *[F.col(v).alias(f"{v}_{tags[0]}") for v in values], F.lit(True).alias("_a"))
    y = b.select(*keys, *[F.col(v).alias(f"{v}_{tags[1]}") for v in values], F.lit(True).alias("_b"))
    j = x.join(y, keys, "full_outer")
    state = F.when(F.col("_a").isNull(), f"only {tags[1]}").when(F.col("_b").isNull(), f"only {tags[0]}").otherwise("paired")
    return j.withColumn("pairing", state).drop("_a", "_b")


def drop_keys_of(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def keep_keys_of(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_semi")


# ---------------------------------------------------------------- spatial
KM_PER_DEGREE = 2 * 3.141592653589793 * EARTH_RADIUS_KM / 360


def _cells(df: DataFrame, lat: str, lon: str, km: float) -> DataFrame:
    """Latitude band and longitude cell; a cell is never narrower than ``km`` anywhere in its band and its neighbours."""
    step = km / KM_PER_DEGREE
    band = F.floor((F.col(lat) + 90) / step).cast("long")
    far = F.greatest(F.abs(F.col("_band") * step - 90), F.abs((F.col("_band") + 1) * step - 90)) + step
    width = F.when(far >= 89.0, F.lit(360.0)).otherwise(F.least(F.lit(360.0), F.lit(step) / F.cos(F.radians(far))))
    count = F.greatest(F.lit(1.0), F.floor(F.lit(360.0) / width))
    return df.withColumn("_band", band).withColumn("_count", count)


def _cell_of(lon: Column, count: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / (F.lit(360.0) / count)), count).cast("long")


def points_within(df: DataFrame, keys: list[str], lat: str, lon: str, km: float) -> DataFrame:
    """Pairs of distinct located points (``keys_a < keys_b`` in struct order) within ``km``, with their distance.

    Equal coordinates of one key are one point. A grid turns the search into an equi-join: the left point is looked up
    in its cell and the neighbouring cells of the three latitude bands (wrapping at 180 degrees), the right point sits
    in one cell.
    """
    pts = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*keys, lat, lon).distinct()
    grid = _cells(pts, lat, lon, km)
    right = grid.withColumn("_cell", _cell_of(F.col(lon), F.col("_count")))
    right = right.select("_band", "_cell", *[F.col(c).alias(f"{c}_b") for c in [*keys, lat, lon]])
    step = km / KM_PER_DEGREE
    near_band = grid.select(*keys, lat, lon, F.explode(F.array(*[F.col("_band") + i for i in (-1, 0, 1)])).alias("_band"))
    far = F.greatest(F.abs(F.col("_band") * step - 90), F.abs((F.col("_band") + 1) * step - 90)) + step
    width = F.when(far >= 89.0, F.lit(360.0)).otherwise(F.least(F.lit(360.0), F.lit(step) / F.cos(F.radians(far))))
    near_band = near_band.withColumn("_count", F.greatest(F.lit(1.0), F.floor(F.lit(360.0) / width)))
    own = _cell_of(F.col(lon), F.col("_count"))
    cells = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.pmod(own + i, F.col("_count")).cast("long")))
    left = near_band.select("_band", F.explode(cells).alias("_cell"), *[F.col(c).alias(f"{c}_a") for c in [*keys, lat, lon]])
    d = haversine_km(F.col(f"{lat}_a"), F.col(f"{lon}_a"), F.col(f"{lat}_b"), F.col(f"{lon}_b"))
    a = F.struct(*[F.col(f"{c}_a").alias(c) for c in [*keys, lat, lon]])
    b = F.struct(*[F.col(f"{c}_b").alias(c) for c in [*keys, lat, lon]])
    j = left.join(right, ["_band", "_cell"]).where(a < b).withColumn("km", d)
    return j.where(F.col("km") <= km).drop("_band", "_cell")


def nearest_between_groups(df: DataFrame, group: str, lat: str, lon: str, km: float) -> DataFrame:
    """Smallest distance between two groups, for pairs within ``km``. Output: group_a < group_b, min_km.

    Equal coordinates of a group are one point, and the minimum is combined on the map side.
    """
    pairs = points_within(df, [group], lat, lon, km).where(F.col(f"{group}_a") != F.col(f"{group}_b"))
    a = F.least(f"{group}_a", f"{group}_b").alias("group_a")
    b = F.greatest(f"{group}_a", f"{group}_b").alias("group_b")
    return pairs.groupBy(a, b).agg(F.min("km").alias("min_km"))


# ---------------------------------------------------------------- tokens
def token_links(df: DataFrame, group: str, text: Column, stop: set[str], min_len: int = 4) -> DataFrame:
    """Groups joined by shared distinctive tokens, as star links: each token links its smallest group to the others.

    Linear in the number of (group, token) rows: a token shared by m groups gives m - 1 links, not m(m-1)/2 pairs.
    Output: token, hub, group.
    """
    tok = F.explode(F.array_distinct(F.split(text, r"[\s,/()\-]+")))
    t = df.select(F.col(group).alias("_g"), tok.alias("token"))
    t = t.where((F.length("token") >= min_len) & ~F.col("token").isin(*sorted(stop))).distinct()
    hub = t.groupBy("token").agg(F.min("_g").alias("hub"), F.count(F.lit(1)).alias("n_groups"))
    return t.join(hub.where(F.col("n_groups") > 1), "token").where(F.col("_g") != F.col("hub")).select(
        "token", "hub", F.col("_g").alias("group"))


def merge_candidates(near: DataFrame, links: DataFrame) -> DataFrame:
    """Group pairs that are close or share a token, in one table: group_a, group_b, min_km, shared_tokens.

    ``near``: output of :func:`nearest_between_groups`; ``links``: output of :func:`token_links`. Nearest pairs first.
    """
    pair = links.select(F.least("hub", "group").alias("group_a"), F.greatest("hub", "group").alias("group_b"), "token")
    shared = pair.groupBy("group_a", "group_b").agg(F.array_join(F.sort_array(F.collect_set("token")), " ").alias("shared_tokens"))
    both = near.join(shared, ["group_a", "group_b"], "full_outer")
    return both.orderBy(F.col("min_km").asc_nulls_last(), "group_a", "group_b")


# ---------------------------------------------------------------- near duplicates
TILE_ROWS = 4_096  # rows of a side that meet in one task at once
BATCH_ROWS = 65_536  # pairs that leave a task at once, in round figures
HUGE = 1e150  # components from here on overflow in a matrix product
COMPONENTS = 1 << 20  # of the pairs whose exact sums lie in memory at once


def near_duplicates(df: DataFrame, id_col: str, vec: str, block: list[str], limit: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links, for grouping, between distinct complete vectors of equal block key and size whose root-mean-square difference
    is below ``limit``; rows with the same vector are one member, named by its smallest id.

    For all pairs of rows, copies included, use :func:`near_duplicate_pairs`.
    """
    finite = F.forall(vec, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    rows = df.where(finite).groupBy(*block, vec).agg(F.min(id_col).alias("_id"))
    return _near_rows(rows.withColumn("_over", F.size(vec)), "_id", vec, block, limit, tile_rows)


def near_duplicate_pairs(df: DataFrame, id_col: str, vec: str, block: list[str], limit: float, components: int,
                         tile_rows: int = TILE_ROWS) -> DataFrame:
    """Every pair of rows (a < b) of equal block key whose root-mean-square difference over ``components`` is below ``limit``.

    Copies of a vector are rows like any other. A component that a side lacks (null, or beyond its size) adds nothing; a
    pair needs one that both have.
    """
    return _near_rows(df.withColumn("_over", F.lit(components)), id_col, vec, block, limit, tile_rows)


def _near_rows(df: DataFrame, id_col: str, vec: str, block: list[str], limit: float, tile_rows: int) -> DataFrame:
    """Pairs of rows of equal block key and ``_over`` (what the squares are divided by) below the limit: block, a, b, rms.

    A difference below the limit implies a first-component difference below ``limit * sqrt(_over)``, so a block of more
    than ``tile_rows`` rows is cut into cells of at least that width, and only the own and the next cell can hold a
    partner; a cell with more rows is cut into tiles, and a block with a row that lacks the first component is one cell.
    Tiles meet in pairs, in tasks of bounded memory, whose pairs leave in batches; small blocks share a task. Inside, rows
    lie in the order of the first component, a matrix product leaves out most pairs in reach, and the rest is summed
    exactly. Where all vectors of a block are in reach (no structure, wide limit), every pair of its tiles is visited.
    """
    rows = df.where((F.size(vec) > 0) & F.col(id_col).isNotNull())
    for c in block:
        rows = rows.where(F.col(c).isNotNull())
    rows = settle(rows.select(*block, "_over", F.col(id_col).alias("_id"), F.transform(vec, lambda v: v.cast("double")).alias("_v")))
    own = [*block, "_over"]
    first = F.get("_v", F.lit(0))
    known = F.when(F.abs(first) < F.lit(float("inf")), first)
    sizes = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.min(known).alias("_low"), F.max(known).alias("_high"),
                                   F.bool_or(first.isNull()).alias("_open"))
    sizes = settle_parameters(sizes.where("_n > 1"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    big = F.col("_n") > tile_rows
    width = F.greatest(F.lit(limit * (1 + 1e-9)) * F.sqrt("_over"), (F.col("_high") - F.col("_low")) / F.ceil(F.col("_n") / tile_rows))
    lot = F.when(big, F.xxhash64(*own).bitwiseOR(F.lit(-(2**63)))).otherwise(F.pmod(F.xxhash64(*own), F.lit(-(-total // tile_rows) or 1)))
    cell = F.when(big & ~F.col("_open"), F.floor((first - F.col("_low")) / width)).otherwise(F.lit(0)).cast("long")
    rows = rows.join(sizes, own).where(F.col("_open") | known.isNotNull())
    rows = rows.withColumn("_lot", lot).withColumn("_cell", cell).drop("_n", "_low", "_high", "_open")
    tiles = rows.groupBy("_lot", "_cell").agg(F.when(F.col("_lot") >= 0, 1).otherwise(F.ceil(F.count(F.lit(1)) / tile_rows)).cast("int").alias("_tiles"))
    tiles = settle_parameters(tiles)
    rows = rows.join(tiles, ["_lot", "_cell"]).withColumn("_tile", F.pmod(F.xxhash64("_id"), "_tiles").cast("int")).drop("_tiles")
    each = tiles.select("_lot", "_cell", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_tile"))
    a, b = (each.select("_lot", F.col("_cell").alias(f"_cell_{s}"), F.col("_tile").alias(f"_tile_{s}")) for s in "ab")
    meet = a.join(b, "_lot").where("_cell_b = _cell_a + 1 OR _cell_b = _cell_a AND _tile_a <= _tile_b")
    meet = settle_parameters(meet)
    key = ["_lot", "_cell_a", "_tile_a", "_cell_b", "_tile_b"]
    place = lambda s: rows.withColumnsRenamed({"_cell": f"_cell_{s}", "_tile": f"_tile_{s}"}).join(
        meet, ["_lot", f"_cell_{s}", f"_tile_{s}"]).withColumn("_right", F.lit(s == "b"))
    right = place("b").where("_cell_a <> _cell_b OR _tile_a <> _tile_b")  # a tile that meets itself comes once
    types = dict(rows.dtypes)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pa.Table.from_batches(list(batches)).combine_chunks()
        side, ids = tile["_right"].to_numpy(), tile["_id"]
        rank = pd.factorize(ids.to_pandas(), sort=True)[0]
        alone, vectors = not side.any(), tile["_v"].combine_chunks()
        found, n = [], 0

        def batch() -> pa.RecordBatch:
            i, j, rms = (np.concatenate(c) for c in zip(*found))
            swap = rank[i] > rank[j]
            columns = [tile[c].take(i) for c in block] + [ids.take(np.where(swap, j, i)), ids.take(np.where(swap, i, j)), pa.array(rms)]
            return pa.table(columns, names=[*block, "a", "b", "rms"]).combine_chunks().to_batches()[0]

        keys = tile.select(own).to_pandas()
        code = keys.groupby(own, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(code, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
            one, two = at[~side[at]], at if alone else at[side[at]]
            if not len(one) or not len(two):
                continue
            for i, j, rms in near_pairs(*_matrices(vectors, one, two), limit, alone, int(keys["_over"][at[0]])):
                i, j = one[i], two[j]
                other = rank[i] != rank[j]
                found.append((i[other], j[other], rms[other]))
                n += len(found[-1][0])
                if n >= BATCH_ROWS:
                    yield batch()
                    found, n = [], 0
        if n:
            yield batch()

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in block), f"a {types['_id']}", f"b {types['_id']}", "rms double"])
    return place("a").unionByName(right).groupBy(*key).applyInArrow(links, schema)


def _matrices(vectors: pa.ListArray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """Vectors at two lists of places as matrices of equal width, and which of their components are there."""
    size = vectors.value_lengths().to_numpy()
    width, out = max(size[one].max(), size[two].max()), []
    for at in (one, two):
        flat, there = vectors.take(pa.array(at)).flatten(), np.arange(width) < size[at][:, None]
        x, has = np.zeros(there.shape), np.zeros(there.shape, bool)
        x[there], has[there] = flat.to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
        out += [x, has]
    return out[0], out[2], out[1], out[3]


def near_pairs(x: np.ndarray, y: np.ndarray, has_x: np.ndarray, has_y: np.ndarray, limit: float, same: bool,
               over: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and root-mean-square differences of the pairs below ``limit``; of one block with itself, each pair once.

    Rows with all components, whose squares are finite, go by matrix products; any other meets each row of the other side.
    """
    full_x, full_y = ((has & (np.abs(v) < HUGE)).all(axis=1) for v, has in ((x, has_x), (y, has_y)))
    at, to = np.flatnonzero(full_x), np.flatnonzero(full_y)
    for i, j, rms in _full_pairs(x[at], y[to], limit, same, over):
        yield at[i], to[j], rms
    for i in np.flatnonzero(~full_x):
        j = np.flatnonzero(full_y | (np.arange(len(y)) > i)) if same else np.arange(len(y))
        rms = _part_rms(x[i], has_x[i], y[j], has_y[j], over)
        j, rms = j[rms < limit], rms[rms < limit]
        yield np.full(len(j), i), j, rms
    for j in np.flatnonzero(~full_y) if not same else ():
        rms = _part_rms(y[j], has_y[j], x[at], has_x[at], over)
        i, rms = at[rms < limit], rms[rms < limit]
        yield i, np.full(len(i), j), rms


def _part_rms(one: np.ndarray, has_one: np.ndarray, y: np.ndarray, has_y: np.ndarray, over: int) -> np.ndarray:
    """Differences over the components that both sides have, summed in order; NaN where there is none."""
    square = np.where((has_one & has_y).any(axis=1), 0.0, np.nan)
    with np.errstate(invalid="ignore", over="ignore"):
        for j in np.flatnonzero(has_one):
            square += np.where(has_y[:, j], np.square(one[j] - y[:, j]), 0.0)
    return np.sqrt(square / over)


def _full_pairs(x: np.ndarray, y: np.ndarray, limit: float, same: bool, over: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if not len(x) or not len(y):
        return
    reach = limit * math.sqrt(over)
    at, to = np.argsort(x[:, 0], kind="stable"), np.argsort(y[:, 0], kind="stable")
    x, y = x[at], y[to]
    known, wide = Known(y), reach * (1 + 1e-9)
    low, high = np.searchsorted(y[:, 0], x[:, 0] - wide), np.searchsorted(y[:, 0], x[:, 0] + wide, side="right")
    for r in range(0, len(x), ROWS):
        some = x[r : r + ROWS]
        start, end = low[r], high[min(r + ROWS, len(x)) - 1]
        if same:
            start = max(start, r)
        if start >= end:
            continue
        i, j = known.within(some, np.full(len(some), reach), start, end)
        if same:
            i, j = i[r + i < j], j[r + i < j]
        pairs = max(1, COMPONENTS // x.shape[1])
        for k in range(0, len(i), pairs):
            m, n = i[k : k + pairs], j[k : k + pairs]
            rms = np.sqrt(squares(some[m], y[n]) / over)
            yield at[r + m[rms < limit]], to[n[rms < limit]], rms[rms < limit]


# ---------------------------------------------------------------- set operations
def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in a total order."""
    return first_k_per_group(df, keys, order, 1, "_r").drop("_r")


def replace_slice(base: DataFrame, other: DataFrame, in_slice: Column) -> DataFrame:
    """Rows of one slice come from another run, all other rows from the base run."""
    return base.where(~F.coalesce(in_slice, F.lit(False))).unionByName(other.where(in_slice), allowMissingColumns=True)


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All copies of rows whose key repeats: counts per key first, then a semi join with the repeated keys."""
    rep = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*keys)
    return df.join(rep, keys, "left_semi")


CLAIM_DIGITS = 6


def check_claims(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """Printed text against the recomputed ledger value under its rounding rule. ``claims``: key, printed, rule.

    Every rule of :func:`round_by_rule` up to ``CLAIM_DIGITS`` digits is known; any other stops the job, so that it can't
    pass for a disagreement.
    """
    from cohera.functions.numeric import round_by_rule

    rules = ["i0", "i1", "h0", *[f"{kind}{n}" for kind in "dspuf" for n in range(CLAIM_DIGITS + 1) if n or kind != "s"]]
    text = F.raise_error(F.concat(F.lit("unknown rounding rule "), F.coalesce("rule", F.lit("null")))).cast("string")
    for r in rules:
        text = F.when(F.col("rule") == r, round_by_rule(F.col("value"), r)).otherwise(text)
    return claims.join(ledger, "key", "left").withColumn("recomputed", text).withColumn(
        "agrees", F.coalesce(F.col("printed") == F.col("recomputed"), F.lit(False)))
