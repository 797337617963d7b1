"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Every source is cut into blocks. With a share of ``a`` slots in a period of ``Q``, block j (from 0) of a source may not
run before slot floor(j Q / a) and must have run by slot ceil((j + 1) Q / a). In each slot the released block with the
earliest deadline runs. One processor and integer shares that fill the period keep every deadline, so after any number
of slots each source deviates from its target by less than one block. The schedule repeats after a period: it is
computed once for the period, and block j of a source runs in slot Q floor(j / a) + slot(j mod a).

By default the shares are the weights themselves and the period is their sum, so the target is exact for any number of
sources. With a ``period`` the weights are first rounded to shares of it (:func:`shares`), and those are the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DecimalType, FractionalType

from cohera.llm.registry import query, table
from cohera.llm.shared import Stored

PERIOD = 1000  # slots of a period; shares are multiples of 1 / PERIOD
BLOCK = 16  # documents of a block
BUCKET = 4096  # documents that are ranked together
STRETCH = 1024  # slots that are folded into one array


def shares(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """Integer shares of the period by largest remainders: source, share. Sources are few (one row each).

    Ties go to the source that sorts first; every source with a positive weight gets a slot at least, taken from the
    largest share. Weights must be non-negative integers (or exact decimals), so that two engines agree.
    """
    w = weights.where(F.col("weight") > 0).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    total = F.sum("weight").over(Window.partitionBy())
    free = F.lit(period) - F.col("n")  # one slot is everyone's
    w = w.withColumn("total", total).withColumn("base", F.floor(F.col("weight") * free / F.col("total")).cast("long"))
    w = w.withColumn("rest", (F.col("weight") * free - F.col("base") * F.col("total")))
    left = F.lit(period) - F.col("n") - F.sum("base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.col("rest").desc(), F.col("source").asc_nulls_first()))
    return w.select("source", (1 + F.col("base") + F.when(rank <= left, 1).otherwise(0)).cast("int").alias("share"))


def period_schedule(share: DataFrame, period: int = PERIOD) -> DataFrame:
    """Earliest deadline first over one period: source, share, k (block in the period), slot. ``period`` rows.

    One row with the shares as an array is folded over the slots; ties go to the source that sorts first.
    """
    order = F.sort_array(F.collect_list(F.struct(F.col("source").isNotNull().alias("named"), "source", "share")))
    one = share.agg(order.alias("s")).where(F.size("s") > 0)
    late = F.lit(2 * period)

    def deadline(used: Column, a: Column) -> Column:
        return F.ceil((used + 1) * F.lit(period) / a).cast("int")

    def step(state: Column, slot: Column) -> Column:
        due = F.zip_with(state["used"], F.col("s.share"), lambda u, a: F.when((u < a) & (F.floor(u * F.lit(period) / a) <= slot), deadline(u, a)).otherwise(late))
        pick = F.array_position(due, F.array_min(due)).cast("int")
        return F.struct(
            F.transform(state["used"], lambda u, i: F.when(i + 1 == pick, u + 1).otherwise(u)).alias("used"),
            F.array_append(state["picks"], pick).alias("picks"),
        )

    start = F.struct(F.transform("s", lambda x: F.lit(0)).alias("used"), F.array().cast("array<int>").alias("picks"))
    run = one.select("s", F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), start, step, lambda st: st["picks"]).alias("picks"))
    slots = run.select("s", F.posexplode("picks").alias("slot", "pick")).select("slot", F.element_at("s", F.col("pick")).alias("e"))
    k = F.row_number().over(Window.partitionBy("e.named", "e.source").orderBy("slot")) - 1
    return slots.select(F.col("e.source").alias("source"), F.col("e.share").alias("share"), k.alias("k"), "slot")


def whole_weights(weights: DataFrame) -> DataFrame:
    """Positive weights as whole numbers without a common factor: source, share. Floats are taken to nine decimals."""
    kind = weights.schema["weight"].dataType
    digits = kind.scale if isinstance(kind, DecimalType) else 9 if isinstance(kind, FractionalType) else 0
    exact = F.col("weight").cast(f"decimal(38,{digits})") if digits else F.col("weight")
    w = weights.where("weight > 0").select("source", F.greatest((exact * F.lit(10**digits)).cast("long"), F.lit(1)).alias("share"))
    euclid = lambda x, y: F.aggregate(
        F.sequence(F.lit(1), F.lit(94)), F.struct(x.alias("a"), y.alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b"))))["a"]
    factor = w.agg(F.aggregate(F.collect_set("share"), F.lit(0).cast("long"), euclid).alias("_g"))
    return w.crossJoin(F.broadcast(factor)).select("source", F.expr("share div _g").alias("share"))  # one row


def exact_schedule(share: DataFrame, blocks: DataFrame) -> DataFrame:
    """Earliest deadline first over a period of the sum of all shares: source, share, period, k, slot.

    ``share``: source, share (whole numbers); ``blocks``: source, blocks (how many it has). Slots after the deadline of
    everybody's last block are left out. Windows are carried on by quotient and remainder, so no product can overflow.
    The fold keeps one row and takes sources x slots steps: with root weights the slots grow with the root of the rows.
    """
    total = F.sum("share").over(Window.partitionBy())
    w = share.withColumn("period", total).join(F.broadcast(blocks.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")), "left")
    last = F.ceil(F.coalesce("blocks", F.lit(0)) * (F.col("period").cast("double") / F.col("share"))) + 1
    quotient, remainder = F.expr("period div share"), F.col("period") % F.col("share")
    entry = F.struct(
        F.col("source").isNotNull().alias("named"), "source", F.col("share").alias("w"), quotient.alias("q"), remainder.alias("m"), F.lit(0).cast("long").alias("free"),
        quotient.alias("ahead"), remainder.alias("rest"), (quotient + F.when(remainder > 0, 1).otherwise(0)).alias("due"))
    one = w.withColumn("_last", last).agg(
        F.sort_array(F.collect_list(entry)).alias("s"), F.max("period").alias("period"), F.least(F.max("period"), F.max("_last").cast("long")).alias("n"))
    one = one.where("n > 0").select("s", "period", "n", F.expr("transform(s, x -> struct(x.w, x.q, x.m, x.free, x.ahead, x.rest, x.due))").alias("t"))
    late = (1 << 63) - 1
    carry = "CASE WHEN x.rest + x.m >= x.w THEN 1L ELSE 0L END"
    moved = (f"named_struct('w', x.w, 'q', x.q, 'm', x.m, 'free', x.ahead, 'ahead', x.ahead + x.q + {carry}, 'rest', x.rest + x.m - x.w * {carry}, "
             f"'due', x.ahead + x.q + {carry} + CASE WHEN x.rest + x.m - x.w * {carry} > 0 THEN 1L ELSE 0L END)")
    step = f"""transform(array(transform(st.t, x -> CASE WHEN x.free <= slot THEN x.due ELSE {late}L END)), d -> CAST(array_position(d, array_min(d)) AS INT))[0]"""
    inner = f"""aggregate(sequence(c * {STRETCH}L, least(c * {STRETCH}L + {STRETCH - 1}L, n - 1)), named_struct('t', run.t, 'picks', CAST(array() AS ARRAY<INT>)),
        (st, slot) -> transform(array({step}), p -> named_struct('t', transform(st.t, (x, i) -> CASE WHEN i + 1 = p THEN {moved} ELSE x END), 'picks', array_append(st.picks, p)))[0])"""
    outer = f"""aggregate(sequence(0L, (n - 1) div {STRETCH}L), named_struct('t', t, 'all', CAST(array() AS ARRAY<ARRAY<INT>>)),
        (run, c) -> transform(array({inner}), e -> named_struct('t', e.t, 'all', array_append(run.all, e.picks)))[0], run -> flatten(run.all))"""
    slots = one.select("s", "period", F.expr(outer).alias("picks")).select("s", "period", F.posexplode("picks").alias("slot", "pick"))
    slots = slots.select("period", "slot", F.element_at("s", F.col("pick")).alias("e"))
    k = F.row_number().over(Window.partitionBy("e.named", "e.source").orderBy("slot")) - 1
    return slots.select(F.col("e.source").alias("source"), F.col("e.w").alias("share"), "period", k.cast("long").alias("k"), F.col("slot").cast("long").alias("slot"))


def ranked(docs: DataFrame, id_col: str, source_col: str, prefix: str, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with ``{prefix}rank``: the place (from 0) of each row in its source in the order of md5(id), id.

    Sources are split into ranges of md5 of about ``bucket`` rows; counts of ranges before come from a table of ranges,
    so the rows of a source, whatever its share, are ranked in many tasks.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    part = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    sizes = docs.groupBy(F.col(source_col).alias("_s")).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(bucket))).cast("long").alias("_b"))
    keyed = docs.withColumns({f"{prefix}key": key}).join(F.broadcast(sizes), F.col(source_col).eqNullSafe(F.col("_s")))  # one row a source
    keyed = keyed.withColumn(f"{prefix}range", F.floor(part * F.col("_b") / F.lit(float(1 << 32))).cast("long")).drop("_s", "_b")
    named = F.col(source_col).isNotNull()
    ranges = keyed.groupBy(F.col(source_col).alias("_s"), F.col(f"{prefix}range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("_s", "_r", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(named, F.col(source_col), f"{prefix}range").orderBy(f"{prefix}key", F.col(id_col).asc_nulls_first()))
    out = keyed.withColumn(f"{prefix}in", inner).join(ranges, F.col(source_col).eqNullSafe(F.col("_s")) & (F.col(f"{prefix}range") == F.col("_r")))
    return out.withColumn(f"{prefix}rank", F.col("_before") + F.col(f"{prefix}in") - 1).drop("_s", "_r", "_before", f"{prefix}in", f"{prefix}range", f"{prefix}key")


def root_weights(docs: DataFrame, source_col: str) -> DataFrame:
    """Default target: the whole square root of a source's size, so small sources are drawn on more than their size says."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.floor(F.sqrt(F.count(F.lit(1)).cast("double"))).cast("long").alias("weight"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, period: int | None = None, prefix: str = "mix_") -> DataFrame:
    """Every row of ``docs`` with ``{prefix}block`` (of its source, from 0), ``{prefix}slot`` (in which the block is read) and
    ``{prefix}place`` (its place in the block).

    Reading by slot and place gives the mixture; slots of a source that has run out stay empty. ``weights``: source,
    weight (null source allowed); rows of sources without a positive weight come after all scheduled ones, in slots of
    their own past the last period. No row is dropped or repeated; null sources are a source; rows that repeat an id
    take neighbouring places; an empty table gives no rows. Existing columns of the three names are replaced. Without
    ``period`` the weights are kept exactly; with it they are rounded to at most ``period`` sources' shares of it.
    """
    docs = docs.drop(f"{prefix}block", f"{prefix}slot", f"{prefix}place")
    weights = root_weights(docs, source_col) if weights is None else weights.select("source", "weight")
    weights = Stored(weights.where("weight > 0"), "mix-weights").df
    if period is None:
        sizes = Stored(docs.groupBy(F.col(source_col).alias("source")).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("long").alias("blocks")), "mix-sizes").df
        share = Stored(whole_weights(weights), "mix-whole").df
        has = share.select(F.col("source").alias("_src"), F.col("share").alias("_share"), F.sum("share").over(Window.partitionBy()).alias("_period"))
        plan = Stored(exact_schedule(share, sizes), "mix-period").df
    else:
        if weights.limit(period + 1).count() > period:
            raise ValueError(f"more sources than the {period} slots of a period")
        plan = Stored(period_schedule(shares(weights, period), period), "mix-period").df
        has = plan.groupBy(F.col("source").alias("_src")).agg(F.max("share").cast("long").alias("_share"), F.lit(period).alias("_period"))
    rows = ranked(docs, id_col, source_col, "_mix_")
    number = F.floor(F.col("_mix_rank") / F.lit(block)).cast("long")
    rows = rows.withColumns({f"{prefix}block": number, f"{prefix}place": (F.col("_mix_rank") % F.lit(block)).cast("int")}).drop("_mix_rank")
    has = Stored(has, "mix-shares").df
    rows = rows.join(F.broadcast(has), F.col(source_col).eqNullSafe(F.col("_src")), "left")  # one row a source
    rows = rows.withColumn("_k", F.pmod(F.col(f"{prefix}block"), F.col("_share")))
    slots = plan.select(F.col("source").alias("_s2"), F.col("k").alias("_k2"), F.col("slot").alias("_slot"))
    slots = slots if period is None else F.broadcast(slots)  # ``period`` rows
    rows = rows.join(slots, F.col(source_col).eqNullSafe(F.col("_s2")) & (F.col("_k") == F.col("_k2")), "left")
    slot = F.floor(F.col(f"{prefix}block") / F.col("_share")).cast("long") * F.col("_period") + F.col("_slot")
    unplanned = F.lit(1 << 60) + F.col(f"{prefix}block")
    return rows.withColumn(f"{prefix}slot", F.coalesce(slot, unplanned)).drop("_src", "_share", "_period", "_k", "_s2", "_k2", "_slot")


SQL = f"""
WITH RECURSIVE w AS (SELECT source, floor(sqrt(count(*)::DOUBLE))::BIGINT AS weight FROM documents GROUP BY 1),
f AS (SELECT list_reduce(list(weight), lambda x, y: gcd(x, y)) AS g FROM w),
sh AS (SELECT source, (weight // g)::BIGINT AS share FROM w, f),
arr AS (SELECT list(share ORDER BY source ASC NULLS FIRST) AS a, list(source ORDER BY source ASC NULLS FIRST) AS s, sum(share)::BIGINT AS q FROM sh),
edf(slot, pick, used) AS (
  SELECT -1::BIGINT, 0::BIGINT, list_transform(a, lambda x: 0::BIGINT) FROM arr
  UNION ALL
  SELECT slot + 1, p, list_transform(used, lambda u, i: CASE WHEN i = p THEN u + 1 ELSE u END)
  FROM (SELECT slot, used, list_position(due, list_min(due))::BIGINT AS p
        FROM (SELECT slot, used, list_transform(used, lambda u, i: CASE WHEN (u * q) // a[i] <= slot + 1 THEN ((u + 1) * q + a[i] - 1) // a[i] ELSE 4 * q END) AS due
              FROM edf, arr WHERE slot < q - 1))),
plan AS (SELECT s[pick] AS source, a[pick] AS share, q, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS k FROM edf, arr WHERE slot >= 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) - 1 AS rank FROM documents)
SELECT doc_id, d.source, (rank // {BLOCK})::BIGINT AS mix_block, (rank % {BLOCK})::INT AS mix_place,
       (((rank // {BLOCK}) // share) * q + slot)::BIGINT AS mix_slot
FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source AND (rank // {BLOCK}) % share = k
"""


@query("op1_source_mixing", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))  # the weights themselves, not rounded
    return out.select("doc_id", "source", "mix_block", "mix_place", "mix_slot")
