"""Exact order statistics over groups of any size.

A window or a list over a group puts the whole group into one task. Here a mergeable quantile sketch gives a bracket
that holds the wanted rank; the brackets, one row per key and rank, are settled, so every task reads them and drops the
rows above its bracket and counts those below before anything is shuffled. Values inside are counted by value, brackets
are cut into pieces, and only the piece that holds the rank is ordered. A sketch outside its guarantee raises an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohera.session import settle, settle_parameters

ACCURACY = 10_000  # sketch rank error is at most n / ACCURACY
PIECES = 1024  # equal value ranges that a bracket is cut into


def _edge_grid(near: list[float]) -> list[float]:
    grid = {i / 16 for i in range(17)}
    for p in near:
        for d in (3 / ACCURACY, 20 / ACCURACY, 0.01):
            grid |= {round(max(0.0, p - d), 6), round(min(1.0, p + d), 6)}
    return sorted(grid)


def order_statistics(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    near: list[float],
) -> DataFrame:
    """k-th smallest value per key for several ranks at once.

    ``ranks`` maps an output column to a function of the group size giving a 1-based rank; ranks outside 1..n give
    null. ``near`` lists the probabilities the ranks lie close to on large groups. Output: keys, ``n``, one column per
    rank. Missing values are ignored.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    if not keys:
        rows = rows.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    grid = _edge_grid(near)
    sketch = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
        F.percentile_approx("_v", grid, ACCURACY).alias("_edges"),
    )
    targets = F.array(
        *[F.struct(F.lit(name).alias("name"), fn(F.col("n")).cast("long").alias("k")) for name, fn in ranks.items()]
    )
    levels = F.array(*[F.lit(g) for g in grid])
    share = F.col("_t.k") / F.col("n")
    margin = F.lit(2.0 / ACCURACY)
    below = F.size(F.filter(levels, lambda g: g <= share - margin))
    inside = F.size(F.filter(levels, lambda g: g < share + margin))
    bracket = settle_parameters(
        sketch.select(*by, "n", "_least", "_most", "_edges", F.explode(targets).alias("_t")).select(
            *by,
            "n",
            F.col("_t.name").alias("_name"),
            F.col("_t.k").alias("_k"),
            F.coalesce(F.when(below > 0, F.get("_edges", below - 1)), "_least").alias("_lo"),
            F.coalesce(F.when(inside < F.lit(len(grid)), F.get("_edges", inside)), "_most").alias("_hi"),
        )
    )
    span = F.col("_hi").cast("double") - F.col("_lo").cast("double")
    place = F.floor((F.col("_v").cast("double") - F.col("_lo").cast("double")) / span * PIECES)
    piece = F.when(F.col("_v") < F.col("_lo"), -1).when(span > 0, F.least(place, F.lit(PIECES - 1))).otherwise(0).cast("int")
    held = (
        rows.join(bracket.select(*by, "_name", "_k", "_lo", "_hi"), by)
        .where(F.col("_v") <= F.col("_hi"))
        .select(*by, "_name", "_k", piece.alias("_piece"), F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v"))
        .groupBy(*by, "_name", "_k", "_piece", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = Window.partitionBy(*by, "_name").orderBy("_piece")  # PIECES + 1 rows
    pieces = held.groupBy(*by, "_name", "_k", "_piece").agg(F.sum("_c").alias("_s")).withColumn("_end", F.sum("_s").over(upto))
    chosen = pieces.where((F.col("_end") >= F.col("_k")) & (F.col("_end") - F.col("_s") < F.col("_k")) & (F.col("_piece") >= 0))
    chosen = chosen.select(*by, "_name", "_piece", (F.col("_end") - F.col("_s")).alias("_before"))
    inner = Window.partitionBy(*by, "_name").orderBy("_v")
    found = held.join(chosen, [*by, "_name", "_piece"]).withColumn("_cum", F.col("_before") + F.sum("_c").over(inner))
    found = found.where(F.col("_cum") >= F.col("_k")).groupBy(*by, "_name").agg(F.min("_v").alias("_v"))
    got = bracket.join(found, [*by, "_name"], "left")
    missed = F.col("_v").isNull() & F.col("_k").between(1, F.col("n"))
    error = F.raise_error(F.lit("a quantile sketch missed its bracket")).cast(got.schema["_v"].dataType)
    got = got.withColumn("_v", F.when(missed, error).otherwise(F.col("_v")))
    out = got.groupBy(*by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])
    return out if keys else out.drop("_all")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per key (the NumPy default). Output: keys, ``n``, one column per name."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        ranks[f"{name}__lo"] = lambda n, p=p: F.floor(F.lit(float(p)) * (n - 1)) + 1
        ranks[f"{name}__hi"] = lambda n, p=p: F.ceil(F.lit(float(p)) * (n - 1)) + 1
    got = order_statistics(df, keys, value, ranks, list(probs.values()))

    def interp(name: str, p: float) -> Column:
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"{name}__lo").cast("double"), F.col(f"{name}__hi").cast("double")
        return F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (pos - F.floor(pos)))

    return got.select(*keys, "n", *[interp(name, p).alias(name) for name, p in probs.items()])


def median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5})


CROWD = 100_000  # rows of a bucket of groups that meet in one task
BUCKETS = 1 << 16


def aggregates_with_median(df: DataFrame, keys: list[str], value: str, name: str, aggs: dict[str, Column], crowd: int = CROWD) -> DataFrame:
    """``aggs`` and the median of ``value`` of many groups that are mostly small: keys, the aggregates, ``name``.

    Rows of small groups are ordered in their group and meet their aggregates there: one shuffle, no sketch per group.
    Groups are counted by hash buckets, a few numbers a task; those of a bucket with more than ``crowd`` rows go by the
    exact order statistics, so no large group is ordered in one task. Missing values count in the aggregates only.
    """
    rows = df.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    large = settle_parameters(rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > crowd).select("_b"))
    some = not large.isEmpty()
    small = (rows.join(large, "_b", "left_anti") if some else rows).drop("_b")
    group = Window.partitionBy(*keys)
    small = small.withColumn("_i", F.row_number().over(group.orderBy(F.col(value).asc_nulls_last()))).withColumn("_m", F.count(value).over(group))
    at = F.col("_i") * 2 - F.col("_m")  # 1 for the middle of an odd number, 0 and 2 around the middle of an even one
    middle = {"_lo": F.min(F.when(at.isin(0, 1), F.col(value))), "_hi": F.min(F.when(at.isin(1, 2), F.col(value)))}
    lo, hi = F.col("_lo").cast("double"), F.col("_hi").cast("double")
    got = small.groupBy(*keys).agg(*[c.alias(n) for n, c in {**aggs, **middle}.items()])
    got = got.select(*keys, *aggs, F.when(lo == hi, lo).otherwise(lo + (hi - lo) * F.lit(0.5)).alias(name))
    if not some:
        return got
    rest = rows.join(large, "_b", "left_semi").drop("_b")
    exact = median(rest, keys, value, name).drop("n")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    exact = exact.select(*[F.col(k).alias(f"_k_{k}") for k in keys], name)
    whole = rest.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]).join(exact, same, "left")
    return got.unionByName(whole.select(*keys, *aggs, name))


def one_per_group(df: DataFrame, keys: list[str], order: Column, payload: list[str]) -> DataFrame:
    """The row with the smallest order value per group, combined on the map side (no window over the group)."""
    rows = df.withColumn("_o", order)
    return rows.groupBy(*keys).agg(*[F.min_by(c, "_o").alias(c) for c in payload])


def first_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows per group with their rank; Spark trims each map task to k rows per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def running_total(df: DataFrame, keys: list[str], order: list[str], amounts: dict[str, str]) -> DataFrame:
    """``df`` with running totals (new column -> summed column) in ``order`` within ``keys``.

    Rows are dealt by ranges of (keys, order), so a large key lies in several tasks; a task sums its own rows, and one row
    per task and key gives what came before. Rows equal in keys and order come in any order.
    """
    dealt = settle(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    by = ["_part", *keys]
    sums = dealt.groupBy(*by).agg(*[F.sum(c).alias(f"_b_{name}") for name, c in amounts.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(c).alias(f"_k_{c}") for c in by], *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in amounts])
    offsets = settle_parameters(offsets)
    local = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.withColumns({f"_l_{n}": F.sum(c).over(local) for n, c in amounts.items()})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    return rows.join(offsets, same).select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_l_{n}")).alias(n) for n in amounts])


def cumulative(df: DataFrame, split: list[str], value: str, amount: Column) -> DataFrame:
    """Running total of ``amount`` in value order per split, ties taken together: split, value, ``amount``, ``upto``, ``total``."""
    v = df.where(F.col(value).isNotNull()).groupBy(*split, value).agg(F.sum(amount).alias("amount"))
    out = running_total(v, split, [value], {"upto": "amount"})
    if not split:
        return out.crossJoin(out.agg(F.max("upto").alias("total")))  # one row
    total = settle_parameters(out.groupBy(*split).agg(F.max("upto").alias("total")))
    return out.join(total, split)
