"""Local calibration: the k earliest rows of each test group join calibration, later rows are evaluated."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from cohera.functions.numeric import INF, conformal_rank
from cohera.operators.selection import first_k_per_group, order_statistics, running_total
from cohera.session import settle, settle_parameters

VARIANTS = ("global", "augment", "local", "hybrid")


def local_budget(
    pooled: DataFrame, test: DataFrame, split: list[str], group: str, id_col: str, time: str, ks: list[int],
    alpha: float = 0.1, min_eval: int = 5,
) -> DataFrame:
    """Coverage per (split, group, k, variant, evaluation set).

    ``pooled``: split columns and the score ``s`` of one calibration row per group. ``test``: group, id, time, score.
    The k-th smallest of (pooled scores + k local scores) is found from ranks: local scores are at most max(ks) per
    group, so only the pooled scores near the wanted rank matter. They are ranked once per split and joined on the few
    ranks asked for, never repeated per group. Coverage comes from counts of scores at or below each quantile, so a test
    row is visited once for all k, variants and evaluation sets; a missing score is not covered.
    """
    k_max = max(ks)
    own = [*split, group]
    order = [F.col(time).asc(), F.col(id_col).asc()]
    first = settle(first_k_per_group(test, own, order, k_max, "rk").select(*own, "rk", time, id_col, "s"))
    quant = _quantiles(pooled, first, test.groupBy(*own).agg(F.count(F.lit(1)).alias("n_rows")), split, group, ks, alpha)

    plan = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e).alias("eval_set"), F.lit(k_max if e == "common" else k).alias("start"))
                               for k in ks for e in ("common", "per_k")]))
    q = quant.select("*", plan.alias("_p")).where(F.col("_p.k") == F.col("k")).select(
        *quant.columns, F.col("_p.eval_set").alias("eval_set"), F.col("_p.start").alias("start"))
    q = settle(q.where(F.col("n_rows") >= F.col("start") + min_eval))
    # rows after the k-th that are covered: those of the whole group less those among its first k
    upto = counts_at_cuts(test, q.where("not inf_flag").select(*own, F.col("qhat").alias("s")), own, "s")
    loc = first.groupBy(*own).agg(F.collect_list(F.struct("rk", "s")).alias("loc"))  # at most max(ks) entries
    ev = q.join(upto.withColumnRenamed("s", "qhat"), [*own, "qhat"], "left").join(loc, own, "left")
    early = F.size(F.filter("loc", lambda e: (e["rk"] <= F.col("start")) & (e["s"] <= F.col("qhat"))))
    n_eval = F.col("n_rows") - F.col("start")
    hits = F.when(F.col("inf_flag"), n_eval).otherwise(F.col("upto") - early)
    return ev.select(*split, "eval_set", group, "k", "variant", "n_cal", "inf_flag", n_eval.alias("n_eval"), (hits / n_eval).alias("coverage"))


def counts_at_cuts(rows: DataFrame, cuts: DataFrame, by: list[str], value: str) -> DataFrame:
    """For each cut the number of rows of its key at or below it: ``by``, ``value``, upto.

    Rows and cuts form one ordered stream with running counts, so a row is met once however many cuts there are. Rows of
    one value are counted first, and a large key is dealt over several tasks.
    """
    scores = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c")).withColumn("cut", F.lit(False))
    marks = cuts.select(*by, value).distinct().withColumn("c", F.lit(0).cast("long")).withColumn("cut", F.lit(True))
    stream = scores.unionByName(marks).groupBy(*by, value).agg(F.sum("c").alias("c"), F.max("cut").alias("cut"))
    return running_total(stream, by, [value], {"upto": "c"}).where("cut").select(*by, value, "upto")


def _quantiles(pooled, first, groups, split, group, ks, alpha):
    """Quantile per (split, group, k, variant)."""
    own = [*split, group]
    switch = math.ceil(1 / alpha) - 1
    # pooled scores between the lowest and the highest rank that any k can ask for: a few dozen distinct values
    span = max(ks)
    ranks = {
        "_lo": lambda m: F.greatest(F.lit(1), conformal_rank(m, alpha) - F.lit(span)),
        "_hi": lambda m: F.least(m, conformal_rank(m, alpha) + F.lit(span)),
    }
    ends = settle_parameters(order_statistics(pooled, split, "s", ranks, [1 - alpha]).withColumnRenamed("n", "n_pool"))
    inside = pooled.join(ends, split).where(F.col("s") <= F.col("_hi"))
    inside = inside.withColumn("v", F.when(F.col("s") >= F.col("_lo"), F.col("s")))  # lower scores only count
    steps = inside.groupBy(*split, "n_pool", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*split).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("r", F.sum("c").over(upto)).where(F.col("v").isNotNull())
    window = settle_parameters(
        steps.groupBy(*split, "n_pool").agg(F.sort_array(F.collect_list(F.struct("r", "v"))).alias("near")))
    kk = F.explode(F.array(*map(F.lit, ks)))
    loc = first.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("rk", "s"))).alias("loc"))  # at most max(ks) entries
    g = groups.join(loc, own, "left").join(window, split).withColumn("k", kk)
    g = g.withColumn("mine", F.transform(F.filter(F.coalesce("loc", F.array().cast("array<struct<rk:int,s:double>>")), lambda e: e["rk"] <= F.col("k")), lambda e: e["s"]))
    g = g.where(F.size("mine") == F.col("k"))
    g = g.withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    uses_pool = (F.col("variant").isin("global", "augment")) | ((F.col("variant") == "hybrid") & (F.col("k") < switch))
    uses_own = F.col("variant") != "global"
    g = g.withColumn("_own", F.when(uses_own, F.col("mine")).otherwise(F.array().cast("array<double>")))
    n_cal = F.when(uses_pool, F.col("n_pool")).otherwise(0) + F.size("_own")
    rank = conformal_rank(n_cal, alpha)
    # value with exactly `rank` scores at or below it, merging the local scores into the pooled ranks nearby
    pool_vals = F.col("near")  # (pooled scores at or below v, v)

    def below_own(v):
        return F.size(F.filter("_own", lambda s: s <= v))

    own_cand = F.transform("_own", lambda v: F.struct(
        (F.when(uses_pool, F.coalesce(F.array_max(F.transform(F.filter(pool_vals, lambda e: e["v"] <= v), lambda e: e["r"])), F.array_min(F.transform(pool_vals, lambda e: e["r"])) - 1)).otherwise(0) + below_own(v)).alias("r"),
        v.alias("v")))
    pool_cand = F.when(uses_pool, F.transform(pool_vals, lambda e: F.struct((e["r"] + below_own(e["v"])).alias("r"), e["v"].alias("v"))))
    cand = F.concat(own_cand, F.coalesce(pool_cand, F.array().cast("array<struct<r:bigint,v:double>>")))
    cand = F.transform(F.filter(cand, lambda e: e["r"] >= rank), lambda e: e["v"])
    q = F.when(rank <= n_cal, F.array_min(cand))
    return g.select(*own, "n_rows", "k", "variant", n_cal.cast("long").alias("n_cal"), F.coalesce(q, F.lit(INF)).alias("qhat"), q.isNull().alias("inf_flag"))
