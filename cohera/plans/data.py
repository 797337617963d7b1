"""The driver tables seen as a grouped sample table, and the base run (splits, models, intervals, metrics).

Group = ``events.user_id`` (a customer), unit = its nation, region = its region, target = ``log10(value)`` rounded to
nine decimals so that two engines compare bit-equal numbers. The same steps are registered as SQL parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohera.functions.keys import HASH_BITS
from cohera.operators.evaluate import interval_metrics
from cohera.operators.intervals import absolute_score, apply_quantile, conformal_quantile
from cohera.operators.models import fit_line, fit_median, with_fallback
from cohera.operators.splits import group_split, sample_one_per_group
from cohera.plans.base import part, table
from cohera.session import settle, settle_parameters

SEEDS = [0, 1, 2]
ALPHAS = (0.1, 0.2)
SPLIT2 = ["protocol", "seed"]
CELL = ["protocol", "seed", "model", "method", "alpha"]
MODELS = ("const", "ratio")


def h(*parts: str) -> str:
    """SQL text of :func:`cohera.functions.keys.hash52`; plain words are quoted by the caller."""
    return f"('0x'||substr(md5(concat_ws('|',{','.join(parts)})),1,{HASH_BITS // 4}))::BIGINT"


def r(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE,{digits})+0.0::DOUBLE)"


# ---------------------------------------------------------------- samples
def events(spark, sf) -> DataFrame:
    """Samples without their place: a plain scan."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", "value", "props")
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).try_cast("int")
    e = e.where(F.col("value") > 0).withColumn("k", k).withColumn("hr", F.hour("ts"))
    x = F.when((F.col("k") > 0) & (F.col("hr") > 0), F.round(F.log10(F.col("k") / F.col("hr")), 9))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("grp"), F.col("event_type").alias("kind"), "ts", "value",
        F.round(F.log10("value"), 9).alias("y"), "k", "hr", x.alias("x"),
    )


def places(spark, sf) -> DataFrame:
    """grp, unit, region per customer. Nations and regions have 25 and 5 rows by design."""
    n, g = table(spark, sf, "nation"), table(spark, sf, "region")
    dim = n.join(g, n.n_regionkey == g.r_regionkey)
    c = table(spark, sf, "customer").join(dim, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("grp"), F.col("n_name").alias("unit"), F.col("r_name").alias("region"))


def samples(spark, sf) -> DataFrame:
    return events(spark, sf).join(places(spark, sf), "grp")


part(
    "samples",
    r"""
SELECT e.event_id AS id, e.user_id AS grp, n.n_name AS unit, r.r_name AS region, e.event_type AS kind, e.ts, e.value,
  round(log10(e.value),9) AS y, k, hr,
  CASE WHEN k > 0 AND hr > 0 THEN round(log10(k::DOUBLE/hr::DOUBLE),9) END AS x
FROM (SELECT *, TRY_CAST(regexp_extract(props,'"k": *([0-9]+)',1) AS INTEGER) AS k, hour(ts)::INTEGER AS hr
      FROM events WHERE value > 0) e
JOIN customer c ON c.c_custkey = e.user_id JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
""",
)


# ---------------------------------------------------------------- splits
def job(spark, sf, seeds=SEEDS, protocols=("group",), keep=True) -> DataFrame:
    """Samples with their roles. Models, cuts and scores read them many times, so they are written once (``keep``)."""
    keys = {"group": "grp", "random": "id"}
    rows = group_split(events(spark, sf), {p: keys[p] for p in protocols}, seeds)
    return settle(rows) if keep else rows


def roles_sql(protocol: str, key: str, seeds=SEEDS, source: str = "samples") -> str:
    hh = h(f"'{protocol}'", "seed", key)
    return f"""
SELECT '{protocol}' AS protocol, seed, {key}, CASE WHEN rk <= nt THEN 'test'
  WHEN rk <= nt + ceil(0.25*(n-nt)-1e-9) THEN 'cal' ELSE 'train' END AS role
FROM (SELECT *, ceil(0.2*n-1e-9) AS nt FROM (
  SELECT seed, {key}, row_number() OVER (PARTITION BY seed ORDER BY {hh}, {key}) AS rk,
         count(*) OVER (PARTITION BY seed) AS n
  FROM (SELECT DISTINCT {key} FROM {source}), (SELECT unnest({seeds})::INTEGER AS seed)))"""


part("roles_group", roles_sql("group", "grp"), "samples")
part("roles_random", roles_sql("random", "id"), "samples")
part(
    "job",
    """
SELECT r.protocol, r.seed, 0 AS fold, r.role, s.* FROM samples s JOIN roles_group r USING (grp)
""",
    "samples", "roles_group",
)


# ---------------------------------------------------------------- models: training median and one log-ratio line
def fits(j: DataFrame, split=SPLIT2) -> DataFrame:
    tr = j.where(F.col("role") == "train")
    med = fit_median(tr, split).withColumnRenamed("pred", "med")
    return settle_parameters(med.join(fit_line(tr, split, "x"), split, "left"))


def scored_wide(j: DataFrame, split=SPLIT2, roles=("cal", "test")) -> DataFrame:
    """Scored rows with one column per model; the fits table has one row per split and is broadcast."""
    rows = j.where(F.col("role").isin(*roles)).join(fits(j, split), split)
    med = F.round("med", 9)
    line = F.round(F.col("intercept") + F.col("slope") * F.col("x"), 9)
    return rows.withColumn("p_const", med).withColumn("p_ratio", with_fallback(line, F.col("x").isNotNull(), med)).drop(
        "med", "slope", "intercept"
    )


def models_long(w: DataFrame) -> DataFrame:
    keep = [c for c in w.columns if not c.startswith("p_")]
    arr = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"p_{m}").alias("pred")) for m in MODELS]))
    return w.select(*keep, arr.alias("_m")).select(*keep, "_m.model", "_m.pred")


part(
    "fits",
    """
SELECT protocol, seed, quantile_cont(y, 0.5) AS med,
  regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept
FROM job WHERE role = 'train' GROUP BY protocol, seed
""",
    "job",
)
part(
    "scored_wide",
    """
SELECT j.*, round(med,9) AS p_const, CASE WHEN x IS NULL THEN round(med,9) ELSE round(intercept+slope*x,9) END AS p_ratio
FROM job j JOIN fits USING (protocol, seed) WHERE role IN ('cal','test')
""",
    "job", "fits",
)
part(
    "gsub_wide",
    f"""
SELECT * FROM scored_wide WHERE role='cal'
QUALIFY row_number() OVER (PARTITION BY protocol, seed, grp ORDER BY {h("'gsub'", "protocol", "seed", "id")}, id) = 1
""",
    "scored_wide",
)


def _long(src: str, where: str = "TRUE") -> str:
    return " UNION ALL BY NAME ".join(
        f"SELECT * EXCLUDE (p_const, p_ratio), '{m}' AS model, p_{m} AS pred FROM {src} WHERE {where}" for m in MODELS
    )


part("cal_long", _long("scored_wide", "role='cal'"), "scored_wide")
part("gsub_long", _long("gsub_wide"), "gsub_wide")
part("test_long", _long("scored_wide", "role='test'"), "scored_wide")


def gsub(cal_wide: DataFrame, payload=("y", "p_const", "p_ratio")) -> DataFrame:
    return sample_one_per_group(cal_wide, SPLIT2, "grp", "id", list(payload))


# ---------------------------------------------------------------- intervals
def scp_qhat(w: DataFrame, alphas=ALPHAS) -> DataFrame:
    cal = w.where(F.col("role") == "cal")
    score = absolute_score(F.col("y"), F.col("pred"))
    scores = models_long(cal).select(*SPLIT2, "model", F.lit("scp_pool").alias("method"), score.alias("s")).unionByName(
        models_long(gsub(cal)).select(*SPLIT2, "model", F.lit("scp_gsub").alias("method"), score.alias("s"))
    )
    return settle_parameters(conformal_quantile(scores, [*SPLIT2, "model", "method"], "s", alphas))


def rank_sql(n: str, a: str) -> str:
    return f"ceil((1.0::DOUBLE-{a})*({n}+1)-1e-9)::BIGINT"


def alpha_rel(alphas=ALPHAS) -> str:
    return f"(SELECT unnest({list(alphas)}::DOUBLE[]) AS alpha)"


part(
    "scp_scores",
    """
SELECT protocol, seed, model, 'scp_pool' AS method, abs(y-pred) AS s FROM cal_long
UNION ALL SELECT protocol, seed, model, 'scp_gsub', abs(y-pred) FROM gsub_long
""",
    "cal_long", "gsub_long",
)
part(
    "scp_qhat",
    f"""
SELECT protocol, seed, model, method, alpha, max(n) AS n_cal,
  coalesce(min(CASE WHEN rk = {rank_sql('n', 'alpha')} THEN s END), 'inf'::DOUBLE) AS qhat,
  min(CASE WHEN rk = {rank_sql('n', 'alpha')} THEN s END) IS NULL AS inf_flag
FROM (SELECT *, row_number() OVER (PARTITION BY protocol, seed, model, method ORDER BY s) AS rk,
       count(*) OVER (PARTITION BY protocol, seed, model, method) AS n FROM scp_scores), {alpha_rel()}
GROUP BY ALL
""",
    "scp_scores",
)


def scp_intervals(w: DataFrame, alphas=ALPHAS) -> DataFrame:
    test = models_long(w.where(F.col("role") == "test"))
    return apply_quantile(test, scp_qhat(w, alphas), [*SPLIT2, "model"], F.col("pred"), F.col("pred"))


part(
    "ivals",
    """
SELECT t.*, method, alpha, n_cal, qhat, inf_flag,
  CASE WHEN inf_flag THEN '-inf'::DOUBLE ELSE pred - qhat END AS lower,
  CASE WHEN inf_flag THEN 'inf'::DOUBLE ELSE pred + qhat END AS upper
FROM test_long t JOIN scp_qhat USING (protocol, seed, model)
""",
    "test_long", "scp_qhat",
)


def iv_rows_sql(src: str = "ivals") -> str:
    return f"""
SELECT *, (y >= lower AND y <= upper)::INTEGER::DOUBLE AS hit,
  CASE WHEN isinf(lower) OR isinf(upper) THEN 'inf'::DOUBLE ELSE pow(10.0::DOUBLE, upper-lower) END AS width,
  CASE WHEN isinf(lower) OR isinf(upper) THEN 'inf'::DOUBLE ELSE (upper-lower)
    + CASE WHEN y < lower THEN 2.0::DOUBLE/alpha*(lower-y) ELSE 0 END
    + CASE WHEN y > upper THEN 2.0::DOUBLE/alpha*(y-upper) ELSE 0 END END AS score,
  (isinf(lower) OR isinf(upper))::INTEGER::DOUBLE AS is_inf
FROM {src}"""


def metrics_sql(src: str, keys: str) -> str:
    """Interval metrics per key list from interval rows (hit, width, score, is_inf)."""
    return f"""
SELECT * FROM (
  SELECT {keys}, avg(cov) AS cov_group, sum(hits)/sum(n) AS cov_pooled, min(CASE WHEN n >= 10 THEN cov END) AS cov_worst,
    count(*) FILTER (n >= 10) AS n_big_groups, avg(med_w) AS width_group, avg(log10(med_w)) AS width_group_log10,
    avg(scores/n) AS score_group, sum(scores)/sum(n) AS score_pooled, sum(infs)/sum(n) AS inf_rate,
    count(*) AS n_groups, sum(n)::BIGINT AS n_rows
  FROM (SELECT {keys}, grp, count(*) AS n, sum(hit) AS hits, avg(hit) AS cov, quantile_cont(width, 0.5) AS med_w,
          sum(score) AS scores, sum(is_inf) AS infs FROM {src} GROUP BY {keys}, grp) GROUP BY {keys})
JOIN (SELECT {keys}, quantile_cont(width, 0.5) AS width_pooled_median FROM {src} GROUP BY {keys}) USING ({keys})"""


part("ivrows", iv_rows_sql(), "ivals")
part("imetrics", metrics_sql("ivrows", "protocol, seed, model, method, alpha"), "ivrows")
part(
    "sizes",
    """
SELECT protocol, seed, count(*) FILTER (role='train') AS n_train, count(*) FILTER (role='cal') AS n_cal_rows,
  count(*) FILTER (role='test') AS n_test, count(DISTINCT grp) FILTER (role='train') AS n_train_g,
  count(DISTINCT grp) FILTER (role='cal') AS n_cal_g, count(DISTINCT grp) FILTER (role='test') AS n_test_g
FROM job GROUP BY protocol, seed
""",
    "job",
)
part(
    "cells",
    """
SELECT m.*, s.* EXCLUDE (protocol, seed), q.n_cal, q.qhat, q.inf_flag FROM imetrics m JOIN sizes s USING (protocol, seed)
JOIN scp_qhat q USING (protocol, seed, model, method, alpha)
""",
    "imetrics", "sizes", "scp_qhat",
)


def sizes(j: DataFrame) -> DataFrame:
    """Rows and groups per role; groups first, so that the distinct counts add up on the map side."""
    per = j.groupBy(*SPLIT2, "role", "grp").agg(F.count(F.lit(1)).alias("c"))
    aggs = []
    for role, rows_name in (("train", "n_train"), ("cal", "n_cal_rows"), ("test", "n_test")):
        is_role = F.col("role") == role
        aggs.append(F.sum(F.when(is_role, F.col("c")).otherwise(0)).alias(rows_name))
        aggs.append(F.count_if(is_role).alias({"train": "n_train_g", "cal": "n_cal_g", "test": "n_test_g"}[role]))
    return per.groupBy(*SPLIT2).agg(*aggs)


def cells(spark, sf, seeds=SEEDS, protocols=("group",), alphas=ALPHAS) -> DataFrame:
    """Per-split metric rows of the base run: (protocol, seed, model, method, alpha)."""
    j = job(spark, sf, seeds, protocols)
    w = scored_wide(j)
    q = scp_qhat(w, alphas)
    test = models_long(w.where(F.col("role") == "test"))
    iv = apply_quantile(test, q, [*SPLIT2, "model"], F.col("pred"), F.col("pred"))
    return (
        interval_metrics(iv, CELL, "grp")
        .join(sizes(j), SPLIT2)
        .join(q, CELL)
    )


# ---------------------------------------------------------------- result rows straight from the line items
RESULT_KEYS = ["target", "protocol", "model", "method", "alpha", "seed"]


def results(spark, sf) -> DataFrame:
    """A result table in the shape of the metric rows of many runs, from one aggregation over all line items.

    target = return flag, protocol = line status, seed = line number, model / method / alpha from supplier, part and
    discount; "coverage" is a share of lines, "width" a mean factor. Cells with an extreme line get an infinite width.
    """
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_partkey", "l_discount", "l_quantity", "l_tax",
        "l_orderkey",
    )
    c = F.col
    keyed = li.select(
        c("l_returnflag").alias("target"),
        F.when(c("l_linestatus") == "O", "group").otherwise("random").alias("protocol"),
        F.when(c("l_suppkey") % 2 == 0, "const").otherwise("ratio").alias("model"),
        F.when(c("l_partkey") % 3 == 0, "scp_pool").when(c("l_partkey") % 3 == 1, "scp_gsub").otherwise("cqr_gsub").alias("method"),
        F.when(c("l_discount") < 0.05, 0.1).otherwise(0.2).alias("alpha"),
        (c("l_linenumber") - 1).alias("seed"),
        "l_quantity", "l_tax", "l_orderkey",
    )
    share = F.avg((c("l_quantity") <= 45).cast("double"))
    by = keyed.groupBy(*RESULT_KEYS).agg(
        F.count(F.lit(1)).alias("n_test"),
        share.alias("cov_group"),
        F.avg(((c("l_quantity") <= 45) & (c("l_tax") < 0.08)).cast("double")).alias("cov_pooled"),
        F.avg(c("l_quantity") / 10 + c("l_tax")).alias("width0"),
        F.min("l_orderkey").alias("_o"),
    )
    inf = c("_o") % 29 == 0
    return by.select(
        *RESULT_KEYS, F.lit(0).alias("fold"), (c("seed") == 6).alias("descriptive_only"), "n_test",
        (c("n_test") * 3).alias("n_train"), c("n_test").alias("n_cal"),
        F.lit(40).alias("n_cal_units"), "cov_group", "cov_pooled",
        F.when(inf, F.lit(float("inf"))).otherwise(c("width0")).alias("width"), inf.alias("inf_flag"),
        F.when(inf, F.lit(float("inf"))).otherwise(F.log10("width0")).alias("width_log10"),
    )


part(
    "results",
    """
SELECT target, protocol, model, method, alpha, seed, 0 AS fold, seed = 6 AS descriptive_only, n_test,
  n_test*3 AS n_train, n_test AS n_cal, 40 AS n_cal_units, cov_group, cov_pooled,
  CASE WHEN o % 29 = 0 THEN 'inf'::DOUBLE ELSE width0 END AS width, o % 29 = 0 AS inf_flag,
  CASE WHEN o % 29 = 0 THEN 'inf'::DOUBLE ELSE log10(width0) END AS width_log10
FROM (SELECT l_returnflag AS target, CASE WHEN l_linestatus='O' THEN 'group' ELSE 'random' END AS protocol,
  CASE WHEN l_suppkey % 2 = 0 THEN 'const' ELSE 'ratio' END AS model,
  CASE l_partkey % 3 WHEN 0 THEN 'scp_pool' WHEN 1 THEN 'scp_gsub' ELSE 'cqr_gsub' END AS method,
  CASE WHEN l_discount < 0.05::DOUBLE THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END AS alpha, l_linenumber-1 AS seed,
  count(*) AS n_test, avg((l_quantity <= 45)::INTEGER::DOUBLE) AS cov_group,
  avg((l_quantity <= 45 AND l_tax < 0.08::DOUBLE)::INTEGER::DOUBLE) AS cov_pooled,
  avg(l_quantity/10+l_tax) AS width0, min(l_orderkey) AS o
FROM lineitem GROUP BY ALL)
""",
)
