"""Grouped splits and folds.

Roles depend only on a keyed hash of the group and on two cut values per (protocol, seed), so assigning them to rows
needs no shuffle of the rows: the cuts (one row per split) are broadcast and each row is labelled where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohera.functions.keys import hash52, uniform
from cohera.operators.selection import one_per_group, order_statistics, running_total
from cohera.session import settle, settle_parameters

ROLES = ("train", "cal", "test")
SPLIT = ["protocol", "seed", "fold"]


def _seeded(df: DataFrame, protocol: str, seeds: list[int]) -> DataFrame:
    return df.select("*", F.lit(protocol).alias("protocol"), F.explode(F.array(*map(F.lit, seeds))).alias("seed"))


def split_cuts(
    df: DataFrame, keys: dict[str, str], seeds: list[int], test: float = 0.2, cal: float = 0.25
) -> DataFrame:
    """Hash cuts per (protocol, seed): the first ceil(test G) groups are test, the next ceil(cal rest) calibration.

    ``keys`` maps each protocol to its grouping column. Output: protocol, seed, test_cut, cal_cut.
    """
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("protocol"), F.col(k).cast("string").alias("key")) for p, k in keys.items()]))
    groups = df.select(each.alias("_e")).select("_e.*").where(F.col("key").isNotNull()).distinct()
    groups = groups.select("*", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    hashed = groups.select("protocol", "seed", hash52(F.col("protocol"), F.col("seed"), F.col("key")).alias("_h"))

    def n_test(n: Column) -> Column:
        return F.ceil(F.lit(test) * n - F.lit(1e-9))

    def n_cal(n: Column) -> Column:
        return F.ceil(F.lit(cal) * (n - n_test(n)) - F.lit(1e-9))

    ranks = {"test_cut": n_test, "cal_cut": lambda n: n_test(n) + n_cal(n)}
    cuts = order_statistics(hashed, ["protocol", "seed"], "_h", ranks, [test, test + cal * (1 - test)])
    return settle_parameters(cuts.select("protocol", "seed", "test_cut", "cal_cut"))


def label_roles(df: DataFrame, keys: dict[str, str], cuts: DataFrame, seeds: list[int]) -> DataFrame:
    """Rows repeated once per (protocol, seed) with their role. ``cuts`` has one row per split, so it is broadcast."""
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("protocol"), F.lit(s).alias("seed"), hash52(p, F.lit(s), F.col(k)).alias("h"))
                for p, k in keys.items()
                for s in seeds
            ]
        )
    )
    role = F.when(F.col("_e.h") <= F.col("test_cut"), "test").when(F.col("_e.h") <= F.col("cal_cut"), "cal")
    rows = df.select("*", each.alias("_e")).select("*", "_e.protocol", "_e.seed")
    return (
        rows.join(cuts, ["protocol", "seed"])
        .withColumn("role", role.otherwise("train"))
        .drop("_e", "test_cut", "cal_cut")
    )


def group_split(
    df: DataFrame, keys: dict[str, str], seeds: list[int], test: float = 0.2, cal: float = 0.25
) -> DataFrame:
    """Grouped shuffle splits by number of groups: one per protocol (grouping column) and seed."""
    out = label_roles(df, keys, split_cuts(df, keys, seeds, test, cal), seeds)
    return out.withColumns({"fold": F.lit(0), "test_unit": F.col("protocol"), "descriptive_only": F.lit(False)})


MAX_UNITS = 1000  # leave-one-out repeats every row once per unit, so the unit list must stay short


def unit_list(df: DataFrame, unit: str) -> list[str]:
    """Sorted unit names; refuses more than ``MAX_UNITS`` of them."""
    got = df.where(F.col(unit).isNotNull()).select(F.col(unit).cast("string").alias("u")).distinct()
    names = sorted(r.u for r in got.limit(MAX_UNITS + 1).collect())
    if len(names) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} units in {unit}: leave-one-unit-out would repeat the table as often")
    return names


def leave_unit_out(
    df: DataFrame,
    unit: str,
    group: str,
    seeds: list[int],
    protocol: str,
    min_groups: int = 10,
    always_descriptive: tuple[str, ...] = (),
    cal: float = 0.25,
    units: list[str] | None = None,
) -> DataFrame:
    """Each unit is the test set once; the other groups become train / calibration by a grouped cut."""
    names = units if units is not None else unit_list(df, unit)
    folds = F.explode(
        F.array(
            *[
                F.struct(F.lit(u).alias("test_unit"), F.lit(i).alias("fold"), F.lit(s).alias("seed"))
                for i, u in enumerate(names)
                for s in seeds
            ]
        )
    )
    pairs = df.select(F.col(unit).alias("_u"), F.col(group).alias("_g")).distinct()
    h = hash52(protocol, F.col("seed"), F.col("test_unit"), F.col("_g"))
    outside = pairs.select("*", folds.alias("_f")).select("_u", "_g", "_f.*")
    outside = outside.where(~F.col("_u").eqNullSafe(F.col("test_unit"))).select(
        "test_unit", "seed", "_g", h.alias("_h")
    ).distinct()
    cuts = order_statistics(
        outside, ["test_unit", "seed"], "_h", {"cal_cut": lambda n: F.ceil(F.lit(cal) * n - F.lit(1e-9))}, [cal]
    ).select("test_unit", "seed", "cal_cut")
    sizes = pairs.where(F.col("_u").isNotNull()).groupBy(F.col("_u").alias("test_unit")).agg(
        F.count(F.lit(1)).alias("n_test_groups")
    )
    small = (F.col("n_test_groups") < min_groups) | F.col("test_unit").isin(*always_descriptive)
    plan = settle_parameters(cuts.join(sizes, "test_unit").withColumn("descriptive_only", small))  # units x seeds rows
    rows = df.select("*", folds.alias("_f")).select(*df.columns, "_f.*").join(plan, ["test_unit", "seed"])
    h = hash52(protocol, F.col("seed"), F.col("test_unit"), F.col(group))
    in_unit = F.col(unit).eqNullSafe(F.col("test_unit"))
    role = F.when(in_unit, "test").when(h <= F.col("cal_cut"), "cal").otherwise("train")
    return rows.withColumn("role", role).withColumn("protocol", F.lit(protocol)).drop("cal_cut")


def _stream_by_split(df: DataFrame, split: list[str], order: list[Column], step, schema: str) -> DataFrame:
    """Run a sequential rule over the ordered unit table of each split.

    Units of one split share a partition and arrive sorted, so the rule sees them as a stream and keeps only its own
    small state; no unit list is ever built. ``step(state, row) -> (state, out)`` starts from ``state = None``.
    """
    cols = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, s) for s in split)
                if key != current:
                    current, state = key, None
                state, res = step(state, row)
                out.append(res)
            yield pd.DataFrame(out, columns=cols)

    return df.repartition(*split).sortWithinPartitions(*split, *order).mapInPandas(run, schema)


def balanced_folds(sizes: DataFrame, unit: str, seeds: list[int], k: int = 5, jitter: bool = True) -> DataFrame:
    """Greedy balanced folds: units in falling (jittered) size, each to the lightest fold. Output: seed, unit, n, fold.

    ``sizes`` has one row per unit with its row count ``n``. Only this unit table is streamed, never the rows.
    """
    s = _seeded(sizes.select(F.col(unit).cast("string").alias("unit"), F.col("n").cast("long")), "balanced", seeds)
    weight = F.col("n") * (F.lit(0.5) + uniform("balanced", F.col("seed"), F.col("unit"))) if jitter else F.col("n") * 1.0
    s = s.select("seed", "unit", "n", weight.alias("weight"))

    def step(load, row):
        load = np.zeros(k) if load is None else load
        f = int(np.argmin(load))
        load[f] += row.n
        return load, (row.seed, row.unit, row.n, f)

    order = [F.col("weight").desc(), F.col("unit").asc()]
    return _stream_by_split(s, ["seed"], order, step, "seed int, unit string, n long, fold int")


def fill_calibration(
    units: DataFrame, split: list[str], lo: float = 0.25, hi: float = 0.35, purpose: str = "fill"
) -> DataFrame:
    """Calibration units in keyed random order until ``lo`` of the pool is reached; a unit that would pass ``hi`` of
    the pool is skipped. When none fits, the smallest unit (ties: first in random order) is taken.

    Below ``lo`` only a unit of more than ``hi - lo`` of the pool can pass ``hi``, so at most a few units a split (nine at
    the defaults) can be skipped at all. The others are taken while the running total of their kind, with the large units
    taken before, is below ``lo``: running totals are dealt over tasks, and only the few large ones go one by one.

    ``units``: split columns, ``unit``, ``n``. Output adds ``is_cal``.
    """
    pool = settle_parameters(units.groupBy(*split).agg(F.sum("n").alias("pool"), F.min("n").alias("n_min")))
    u = units.select(*split, F.col("unit").cast("string").alias("unit"), F.col("n").cast("long").alias("n"), hash52(purpose, *[F.col(s) for s in split], F.col("unit")).alias("_h"))
    u = u.join(pool, split).withColumn("_large", F.col("n") > (hi - lo) * F.col("pool") - 1)
    u = u.withColumn("_part_n", F.when(F.col("_large"), F.lit(0)).otherwise(F.col("n")))
    u = settle(running_total(u, split, ["_h", "unit"], {"_upto": "_part_n"}))
    place = F.struct("_h", "unit")
    few = u.groupBy(*split, "pool").agg(
        F.sort_array(F.collect_list(F.when(F.col("_large"), F.struct("_h", "unit", "n", "_upto")))).alias("large"),  # below 1 / (hi - lo) + 1 units
        F.min(F.when(F.col("n") == F.col("n_min"), place)).alias("smallest"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<_h:bigint,unit:string,n:bigint>>").alias("taken"))

    def step(acc: Column, e: Column) -> Column:
        before = e["_upto"] + acc["sum"]
        take = (before < lo * F.col("pool")) & (before + e["n"] <= hi * F.col("pool"))
        one = F.array(F.struct(e["_h"].alias("_h"), e["unit"].alias("unit"), e["n"].alias("n")))
        return F.struct((acc["sum"] + F.when(take, e["n"]).otherwise(0)).alias("sum"), F.when(take, F.concat(acc["taken"], one)).otherwise(acc["taken"]).alias("taken"))

    few = settle_parameters(few.select(*split, "smallest", F.aggregate("large", start, step)["taken"].alias("large")))
    rows = u.join(few, split)
    earlier = F.filter("large", lambda e: F.struct(e["_h"], e["unit"]) < place)
    before = F.col("_upto") - F.col("_part_n") + F.aggregate(earlier, F.lit(0).cast("long"), lambda a, e: a + e["n"])
    taken = F.when(F.col("_large"), F.exists("large", lambda e: e["unit"] == F.col("unit"))).otherwise(before < lo * F.col("pool"))
    rows = rows.withColumn("_taken", taken)
    some = settle_parameters(rows.groupBy(*split).agg(F.bool_or("_taken").alias("_some")))
    is_cal = F.col("_taken") | (~F.col("_some") & (F.col("smallest") == place))
    return rows.join(some, split).select(*split, "unit", "n", is_cal.alias("is_cal"))


def contributor_folds(
    df: DataFrame,
    unit: str,
    group: str,
    seeds: list[int],
    protocol: str,
    k: int = 5,
    min_test: int = 10,
    drop_leaks: bool = False,
) -> DataFrame:
    """K folds over whole units with disjoint calibration units.

    Units with fewer than ``min_test`` rows are never tested. With ``drop_leaks`` (units not nested in groups), train
    and calibration rows whose group is in test are dropped, then calibration rows whose group is in train; role
    ``dropped`` marks them so that the loss can be counted.
    """
    sizes = df.groupBy(F.col(unit).cast("string").alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    test_fold = balanced_folds(sizes.where(F.col("n") >= min_test), "unit", seeds, k).select("seed", "unit", "fold")
    base = sizes.select("*", F.explode(F.array(*map(F.lit, seeds))).alias("seed")).withColumn("seed", F.col("seed").cast("int"))
    own = base.join(test_fold.withColumnRenamed("fold", "own_fold"), ["seed", "unit"], "left")
    per_fold = own.select("*", F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("fold"))
    is_test = F.coalesce(F.col("own_fold") == F.col("fold"), F.lit(False))
    pool = per_fold.where(~is_test).select("seed", "fold", "unit", "n")
    cal = fill_calibration(pool, ["seed", "fold"], purpose=protocol).select("seed", "fold", "unit", "is_cal")
    tests = per_fold.where(is_test).select("seed", "fold", "unit", F.lit("test").alias("role"))
    rest = cal.select("seed", "fold", "unit", F.when(F.col("is_cal"), "cal").otherwise("train").alias("role"))
    roles = tests.unionByName(rest).withColumnRenamed("unit", "_unit")
    if drop_leaks:
        rows = _leak_free(df, unit, group, roles)
    else:
        rows = df.join(roles, F.col(unit).cast("string") == F.col("_unit")).drop("_unit")
    return rows.withColumn("protocol", F.lit(protocol)).withColumn(
        "test_unit", F.concat(F.lit("fold"), F.col("fold").cast("string"))
    )


def _leak_free(df: DataFrame, unit: str, group: str, roles: DataFrame) -> DataFrame:
    """Rows with the roles that leaks leave them. A role depends on unit and group alone, so leaks are found on the distinct
    pairs of them; a row is shuffled once and meets the roles of its pair, of all seeds and folds, where it lies."""
    pairs = df.select(F.col(unit).cast("string").alias("_unit"), F.col(group).alias("_group")).distinct()
    marked = _drop_leaks(pairs.join(roles, "_unit"), "_group")
    plan = marked.groupBy("_unit", "_group").agg(F.collect_list(F.struct("seed", "fold", "role")).alias("_roles"))
    rows = df.join(plan, (F.col(unit).cast("string") == F.col("_unit")) & (F.col(group) == F.col("_group")))
    return rows.select(*df.columns, F.explode("_roles").alias("_r")).select(*df.columns, "_r.*")


def _drop_leaks(rows: DataFrame, group: str) -> DataFrame:
    keys = ["seed", "fold", group]
    seen = rows.groupBy(*keys).agg(
        F.max(F.col("role") == "test").alias("_in_test"), F.max(F.col("role") == "train").alias("_in_train")
    )
    role = (
        F.when(F.col("role") == "test", "test")
        .when(F.col("_in_test"), "dropped")
        .when((F.col("role") == "cal") & F.col("_in_train"), "dropped")
        .otherwise(F.col("role"))
    )
    return rows.join(seen, keys).withColumn("role", role).drop("_in_test", "_in_train")


def unit_folds(df: DataFrame, split: list[str], group: str, k: int, purpose: str = "unitfold", exact: bool = False):
    """Folds of groups whose unit counts differ by at most one: keyed random rank modulo k.

    ``exact`` first drops n mod k random groups so that the folds are equal. The rank over groups comes from hash
    buckets and a prefix sum of the bucket counts, so no split's groups pass through one task.
    """
    groups = df.select(*split, group).distinct()
    h = hash52(purpose, *[F.col(s) for s in split], F.col(group))
    ranked = dense_rank_by_hash(groups.withColumn("_h", h), split, "_h", group)
    n_groups = F.col("_n")
    if exact:
        ranked = ranked.where(F.col("_rank") <= n_groups - F.pmod(n_groups, F.lit(k)))
    return ranked.select(*split, group, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int").alias("fold"))


def dense_rank_by_hash(df: DataFrame, split: list[str], h: str, tie: str, buckets: int = 1024) -> DataFrame:
    """Row number over (split order by hash) for any number of rows: uniform hash buckets, bucket offsets, local ranks.

    A uniform hash spreads the rows evenly over the buckets, so each window partition holds about n / buckets rows.
    Adds ``_rank`` and ``_n``.
    """
    width = 2**52 // buckets
    b = df.withColumn("_b", F.floor(F.col(h) / F.lit(width)).cast("int"))
    counts = b.groupBy(*split, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*split).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *split,
        "_b",
        F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_before"),
        F.sum("_c").over(Window.partitionBy(*split)).alias("_n"),
    )
    local = F.row_number().over(Window.partitionBy(*split, "_b").orderBy(h, tie))
    return b.withColumn("_local", local).join(offsets, [*split, "_b"]).withColumn(
        "_rank", F.col("_before") + F.col("_local")
    ).drop("_b", "_local", "_before", h)


def random_holdout(df: DataFrame, split: list[str], id_col: str, share: float = 0.2, purpose: str = "holdout"):
    """Adds ``held``: the round(share n) rows of each split with the smallest keyed hash."""
    h = hash52(purpose, *[F.col(s) for s in split], F.col(id_col))
    rows = df.withColumn("_h", h)
    cut = order_statistics(
        rows, split, "_h", {"_cut": lambda n: F.bround(F.lit(float(share)) * n)}, [share]
    ).select(*split, "_cut")
    cut = settle_parameters(cut)
    held = F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False))
    return rows.join(cut, split).withColumn("held", held).drop("_h", "_cut")


def group_draws(groups: DataFrame, split: list[str], group: str, grid: list[int], draws: int, purpose: str = "draw"):
    """n random groups per (split, n, draw), plus draw 0 of ``all``. ``groups``: one row per (split, group).

    Works on the group table only. Output: split, n_target, draw, group.
    """
    plan = [(str(n), r, n) for n in grid for r in range(draws)]
    tries = F.explode(
        F.array(*[F.struct(F.lit(t).alias("n_target"), F.lit(r).alias("draw"), F.lit(n).alias("n_draw")) for t, r, n in plan])
    )
    wide = groups.select(*split, group, tries.alias("_p")).select(*split, group, "_p.*")
    wide = wide.withColumn("_h", hash52(purpose, *[F.col(s) for s in split], F.col("n_target"), F.col("draw"), F.col(group)))
    keys = [*split, "n_target", "draw"]
    # a budget above the number of groups has no cut and drops out
    cut = order_statistics(wide, [*keys, "n_draw"], "_h", {"_cut": lambda _n: F.col("n_draw")}, [0.1, 0.5, 0.9])
    cut = cut.select(*keys, "_cut").where(F.col("_cut").isNotNull())
    chosen = wide.join(cut, keys).where(F.col("_h") <= F.col("_cut")).select(*keys, group)
    everything = groups.select(*split, F.lit("all").alias("n_target"), F.lit(0).alias("draw"), group)
    return chosen.unionByName(everything)


def sample_one_per_group(df: DataFrame, split: list[str], group: str, id_col: str, payload: list[str], purpose="gsub"):
    """One uniformly drawn row per (split, group), whatever the row order."""
    h = hash52(purpose, *[F.col(s) for s in split], F.col(id_col))
    return one_per_group(df, [*split, group], h, payload)


def split_iterator(df: DataFrame, seeds: list[int] | None = None) -> DataFrame:
    """Distinct splits, optionally of some seeds only."""
    d = df.select(*SPLIT, "test_unit", "descriptive_only").distinct()
    return d if seeds is None else d.where(F.col("seed").isin(*seeds))


def parse_seed_range(text: str | None) -> list[int] | None:
    """``0-3,7`` to a list; ``all`` or nothing means every seed."""
    if text in (None, "", "all"):
        return None
    seeds: list[int] = []
    for part in text.split(","):
        first, _, last = part.partition("-")
        seeds += range(int(first), int(last or first) + 1)
    return seeds


def emit_long(df: DataFrame, id_col: str) -> DataFrame:
    """The long split table: id, protocol, seed, fold, test_unit, descriptive_only, role."""
    return df.select(
        F.col(id_col).alias("id"), "protocol", F.col("seed").cast("smallint").alias("seed"),
        F.col("fold").cast("smallint").alias("fold"), "test_unit", "descriptive_only", "role",
    )


def leakage(df: DataFrame, key: str, split: list[str] = SPLIT) -> DataFrame:
    """Violations: values of ``key`` seen in more than one role of a split (empty when the split is clean)."""
    roles = df.where(F.col("role").isin(*ROLES)).groupBy(*split, key).agg(
        F.min("role").alias("role_a"), F.max("role").alias("role_b")
    )
    return roles.where(F.col("role_a") != F.col("role_b"))


def split_checks(df: DataFrame, id_col: str, keys: list[str], unit: str | None = None) -> DataFrame:
    """Violation counts per split: repeated ids, keys in two roles, test unit purity, missing roles."""
    ids = df.groupBy(*SPLIT, id_col).agg(F.count(F.lit(1)).alias("c")).groupBy(*SPLIT).agg(
        F.count_if(F.col("c") > 1).alias("repeated_ids")
    )
    agg = [(F.lit(3) - F.count_distinct("role")).alias("missing_roles")]
    if unit:
        inside = F.col(unit) == F.col("test_unit")
        agg.append(F.count_if((F.col("role") == "test") & ~inside).alias("test_outside_unit"))
        agg.append(F.count_if((F.col("role") != "test") & inside).alias("unit_outside_test"))
    out = ids.join(df.groupBy(*SPLIT).agg(*agg), SPLIT)
    for key in keys:
        bad = leakage(df, key).groupBy(*SPLIT).agg(F.count(F.lit(1)).alias(f"leaks_{key}"))
        out = out.join(bad, SPLIT, "left").withColumn(f"leaks_{key}", F.coalesce(f"leaks_{key}", F.lit(0)))
    return out
