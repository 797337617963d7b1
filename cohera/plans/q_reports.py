"""Aggregations, pivots and ledgers (A rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohera.operators import evaluate as E, reports as R, selection as S
from cohera.plans import data as d, q_models as QM
from cohera.plans.base import part, query, rnd, rounded, sql, table
from cohera.plans.data import SPLIT2, r, rank_sql
from cohera.plans.q_tables import COORD, LABELLED, coords, labelled

CELL = ["target", "protocol", "model", "method", "alpha"]
CELL_T = ", ".join(CELL)


@query(
    "count_matrix__A1",
    " UNION ALL ".join(
        f"SELECT '{c}' AS target, count({c}) AS non_null, count(*) FILTER ({c}<=0) AS le_zero, count(*) FILTER ({c}>0) AS positive, count(*) FILTER ({c}>0 AND NOT coalesce(toxic,0)=1) AS positive_quality FROM {LABELLED}"
        for c in ("n_chars", "quality")),
)
def count_matrix(spark, sf):
    return R.count_matrix(labelled(spark, sf), ["n_chars", "quality"], ~(F.coalesce("toxic", F.lit(0)) == 1))


@query("group_count__A2", f"SELECT quality, count(*) AS n FROM {LABELLED} GROUP BY 1 ORDER BY n DESC")
def group_count(spark, sf):
    return labelled(spark, sf).groupBy("quality").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc())


@query(
    "group_table__A3",
    sql(f"SELECT grp, count(*) AS n_samples, min(region) AS region, min(unit) AS unit, count(DISTINCT kind) AS n_kinds, {r('avg(value)', 10)} AS value_mean, "
        "count(DISTINCT date_trunc('day', ts)) AS n_days FROM samples GROUP BY grp", "samples"),
)
def group_table(spark, sf):
    return d.samples(spark, sf).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_samples"), F.min("region").alias("region"), F.min("unit").alias("unit"),
        F.count_distinct("kind").alias("n_kinds"), rnd(F.avg("value"), 10).alias("value_mean"),
        F.count_distinct(F.to_date("ts")).alias("n_days"))


@query(
    "size_distribution__A4",
    "SELECT min(n) AS min_n, quantile_cont(n,0.5) AS median_n, max(n) AS max_n, count(*) FILTER (n>=20) AS n_ge20, count(*) AS n_groups FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)",
)
def size_distribution(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))
    m = S.median(g, [], "n_rows", "median_n").drop("n")
    a = g.agg(F.min("n_rows").alias("min_n"), F.max("n_rows").alias("max_n"), F.count_if(F.col("n_rows") >= 20).alias("n_ge20"), F.count(F.lit(1)).alias("n_groups"))
    return a.withColumn("_j", F.lit(1)).join(m.withColumn("_j", F.lit(1)), "_j").drop("_j")


SIZES = "SELECT protocol, seed, count(*) FILTER (role='train') AS n_train, count(*) FILTER (role='cal') AS n_cal, count(*) FILTER (role='test') AS n_test, " + ", ".join(
    f"count(DISTINCT grp) FILTER (role='{x}') AS groups_{x}" for x in ("train", "cal", "test")) + " FROM job GROUP BY ALL"
part("ssizes", SIZES, "job")


@query(
    "split_size_pivot__A5",
    sql("SELECT protocol, count(*) AS n_splits, quantile_cont(n_train,0.5) AS median_train, quantile_cont(n_cal,0.5) AS median_cal, quantile_cont(n_test,0.5) AS median_test, "
        "min(n_test) AS min_test, max(n_test) AS max_test, quantile_cont(groups_test,0.5) AS median_test_groups, min(groups_cal) AS min_cal_groups FROM ssizes GROUP BY protocol", "ssizes"),
)
def split_size_pivot(spark, sf):
    return R.protocol_summary(R.split_sizes(d.job(spark, sf, keep=False), SPLIT2, "grp"))


@query(
    "dataset_summary__A6",
    sql(f"SELECT kind, count(*) AS n_rows, count(DISTINCT grp) AS n_groups, count(DISTINCT region) AS n_regions, {r('quantile_cont(value,0.05)', 8)} AS p05, {r('quantile_cont(value,0.5)', 8)} AS median, "
        f"{r('quantile_cont(value,0.95)', 8)} AS p95, count(x) AS complete, count(*) FILTER (k<=0) AS nonpositive FROM samples GROUP BY kind", "samples"),
)
def dataset_summary(spark, sf):
    s = d.samples(spark, sf)
    a = s.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("grp").alias("n_groups"), F.count_distinct("region").alias("n_regions"),
        F.count("x").alias("complete"), F.count_if(F.col("k") <= 0).alias("nonpositive"))
    q = S.quantiles(d.events(spark, sf), ["kind"], "value", {"p05": 0.05, "median": 0.5, "p95": 0.95}).drop("n")
    return rounded(a.join(q, "kind"), "p05", "median", "p95", digits=8)


@query(
    "realised_sizes__A7",
    sql("""SELECT protocol, role, quantile_cont(n,0.5) AS rows_median, quantile_cont(g,0.5) AS groups_median, count(*) AS n_splits FROM (SELECT protocol, seed, role, count(*) AS n, count(DISTINCT grp) AS g FROM job GROUP BY ALL) GROUP BY ALL""", "job"),
)
def realised_sizes(spark, sf):
    per = d.job(spark, sf, keep=False).groupBy(*SPLIT2, "role", "grp").agg(F.count(F.lit(1)).alias("c"))
    per = per.groupBy(*SPLIT2, "role").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("g"))
    return per.groupBy("protocol", "role").agg(
        F.percentile("n", 0.5).alias("rows_median"), F.percentile("g", 0.5).alias("groups_median"), F.count(F.lit(1)).alias("n_splits"))


HAVAB = "2*6371.0088::DOUBLE*asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2))))"


@query("group_extent__A8", f"SELECT a.label, {r(f'max({HAVAB})', 3)} AS extent_km FROM {COORD} a JOIN {COORD} b ON a.label=b.label GROUP BY 1")
def group_extent(spark, sf):
    return R.group_extent(coords(spark, sf), "label", "lat", "lon").withColumn("extent_km", rnd("extent_km", 3))


@query(
    "map_aggregates__A9",
    f"SELECT label, count(*) AS n, {r('avg(lat)', 7)} AS lat, {r('avg(lon)', 7)} AS lon, count(*) FILTER (lat IS NULL) AS no_coord FROM {COORD} GROUP BY 1",
)
def map_aggregates(spark, sf):
    return coords(spark, sf).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("lat"), 7).alias("lat"), rnd(F.avg("lon"), 7).alias("lon"), F.count_if(F.col("lat").isNull()).alias("no_coord"))


@query("log_histogram__A10", "SELECT event_type, floor(8*log10(value))::INTEGER AS bin, count(*) AS n FROM events WHERE value>0 GROUP BY 1,2")
def log_histogram(spark, sf):
    return R.log_histogram(table(spark, sf, "events"), ["event_type"], "value")


@query(
    "concentration_curve__A11",
    f"""WITH g AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1,2), v AS (SELECT event_type, n, count(*) AS c, sum(n) AS s FROM g GROUP BY 1,2)
SELECT event_type, n, {r('sum(c) OVER w/sum(c) OVER (PARTITION BY event_type)', 9)} AS ecdf, {r('sum(s) OVER w/sum(s) OVER (PARTITION BY event_type)', 9)} AS row_share FROM v WINDOW w AS (PARTITION BY event_type ORDER BY n)""",
)
def concentration_curve(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(R.concentration(g, ["event_type"], "n"), "ecdf", "row_share", digits=9)


@query(
    "key_figures__A12",
    """WITH k AS (SELECT 'rows' AS key, count(*)::DOUBLE AS value FROM events UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events UNION ALL SELECT 'max_value', max(value) FROM events
UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'labelled', count(*) FROM labels),
i AS (SELECT 'rows' AS key, sum(n)::DOUBLE AS expected FROM (SELECT count(*) AS n FROM events GROUP BY event_type) UNION ALL SELECT 'labelled', count(*) FROM documents JOIN labels USING (doc_id))
SELECT key, value, expected, expected IS NOT NULL AND value<>expected AS mismatch FROM k LEFT JOIN i USING (key)""",
)
def key_figures(spark, sf):
    ev, docs, lab = table(spark, sf, "events"), table(spark, sf, "documents"), table(spark, sf, "labels")

    def fig(df, key, c):
        return df.agg(F.lit(key).alias("key"), c.cast("double").alias("value"))

    k = fig(ev, "rows", F.count(F.lit(1))).unionByName(fig(ev, "users", F.count_distinct("user_id"))).unionByName(
        fig(ev, "max_value", F.max("value"))).unionByName(fig(docs, "documents", F.count(F.lit(1)))).unionByName(fig(lab, "labelled", F.count(F.lit(1))))
    by_type = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    i = fig(by_type, "rows", F.sum("n")).unionByName(fig(docs.join(lab, "doc_id"), "labelled", F.count(F.lit(1)))).withColumnRenamed("value", "expected")
    return k.join(i, "key", "left").withColumn("mismatch", F.col("expected").isNotNull() & (F.col("value") != F.coalesce("expected", "value")))


FIN = "CASE WHEN NOT isinf({c}) THEN {c} END"
part("fin", f"SELECT * REPLACE ({FIN.format(c='width')} AS width) FROM results WHERE NOT descriptive_only", "results")


def finite_results(spark, sf):
    return d.results(spark, sf).where(~F.col("descriptive_only"))


@query(
    "cell_summary__A13",
    sql(f"SELECT {CELL_T}, count(*) AS n_splits, count(DISTINCT seed) AS n_seeds, count(*) FILTER (inf_flag) AS n_splits_infinite, " + ", ".join(
        f"{r(f'avg({c})', 8)} AS {c}_mean, {r(f'stddev_samp({c})', 8)} AS {c}_std, {r(f'quantile_cont({c},0.5)', 8)} AS {c}_median, count({c}) AS {c}_finite" for c in ("cov_group", "width")) + " FROM fin GROUP BY ALL", "fin"),
)
def cell_summary(spark, sf):
    s = R.cell_summary(finite_results(spark, sf), CELL, ["cov_group", "width"])
    return rounded(s, *[f"{c}_{k}" for c in ("cov_group", "width") for k in ("mean", "std", "median")], digits=8)


@query(
    "cell_distribution__A14",
    sql(f"SELECT concat_ws('.','cell',target,protocol,model,method,'a'||lpad(round(alpha*1000)::INTEGER::VARCHAR,3,'0'),name) AS key, {r('v', 8)} AS value FROM (SELECT {CELL_T}, unnest(['cov_group_mean','cov_group_p025','cov_group_p975','cov_group_median','n_splits']) AS name, unnest(l) AS v FROM "
        f"(SELECT {CELL_T}, [avg(cov_group), quantile_cont(cov_group,0.025), quantile_cont(cov_group,0.975), quantile_cont(cov_group,0.5), count(*)::DOUBLE] AS l FROM fin GROUP BY {CELL_T}))", "fin"),
)
def cell_distribution(spark, sf):
    s = R.cell_summary(finite_results(spark, sf), CELL, ["cov_group"], (0.025, 0.975)).withColumn("n_splits", F.col("n_splits").cast("double"))
    from cohera.functions.keys import cell_key

    c = F.col
    key = cell_key(c("target"), c("protocol"), c("model"), c("method"), alpha=c("alpha"))
    led = R.ledger(s, key, ["cov_group_mean", "cov_group_p025", "cov_group_p975", "cov_group_median", "n_splits"])
    return led.withColumn("value", rnd("value", 8))


@query(
    "completeness_status__A15",
    sql("""WITH f AS (SELECT target, protocol, method, count(DISTINCT seed) AS n_splits FROM results WHERE NOT inf_flag GROUP BY ALL), e AS (SELECT target, protocol, count(DISTINCT seed) AS n_expected FROM results GROUP BY ALL)
SELECT f.target, f.protocol, method, n_splits, n_expected, CASE WHEN n_splits=n_expected THEN 'complete' ELSE 'incomplete' END AS status FROM f JOIN e USING (target, protocol)""", "results"),
)
def completeness_status(spark, sf):
    m = d.results(spark, sf)
    found = m.where(~F.col("inf_flag")).groupBy("target", "protocol", "method").agg(F.count_distinct("seed").alias("n_splits"))
    plan = m.groupBy("target", "protocol").agg(F.count_distinct("seed").alias("n_expected"))
    return R.completeness_status(found, plan, ["target", "protocol"])


BUD = ["target", "protocol", "method"]
part("budget_rows", "SELECT target, protocol, method, seed, row_number() OVER (PARTITION BY target, protocol, method, seed ORDER BY model, alpha)-1 AS draw, cov_group AS cov, inf_flag, "
     f"{rank_sql('n_cal_units','alpha')}/(n_cal_units+1) AS beta_mean, sqrt({rank_sql('n_cal_units','alpha')}*(n_cal_units+1-{rank_sql('n_cal_units','alpha')})::DOUBLE/(41.0*41.0*42.0)) AS beta_sd FROM results", "results")


def budget_rows(spark, sf):
    from pyspark.sql import Window

    law = E.beta_law(F.col("n_cal_units"), F.col("alpha"))
    w = Window.partitionBy(*BUD, "seed").orderBy("model", "alpha")  # a handful of draws per split
    m = d.results(spark, sf).withColumn("draw", F.row_number().over(w) - 1).withColumn("cov", F.col("cov_group"))
    return m.withColumn("beta_mean", law["beta_mean"]).withColumn("beta_sd", law["beta_sd"])


BS = ["mean_cov", "beta_mean", "sd_seed_draw0", "sd_seed_means", "beta_sd", "sd_draws_within_split", "inf_rate", "draws_per_seed"]
BUDGET_SQL = f"""SELECT target, protocol, method, count(*) AS n_seeds, {r('avg(k)', 8)} AS draws_per_seed, {r('avg(m)', 8)} AS mean_cov, {r('avg(bm)', 8)} AS beta_mean, {r('stddev_samp(d0)', 8)} AS sd_seed_draw0, {r('stddev_samp(m)', 8)} AS sd_seed_means,
{r('avg(bs)', 8)} AS beta_sd, {r('avg(w)', 8)} AS sd_draws_within_split, {r('sum(i)/sum(k)', 8)} AS inf_rate FROM (SELECT target, protocol, method, seed, avg(cov) AS m, stddev_samp(cov) AS w, max(CASE WHEN draw=0 THEN cov END) AS d0, avg(beta_mean) AS bm, avg(beta_sd) AS bs,
count(*) AS k, count(*) FILTER (inf_flag) AS i FROM budget_rows GROUP BY ALL) GROUP BY ALL"""
part("budget_sum", BUDGET_SQL, "budget_rows")


def budget_sum(spark, sf):
    return rounded(R.budget_summary(budget_rows(spark, sf), BUD), *BS, digits=8)


query("budget_group_summary__A16", sql("SELECT * FROM budget_sum", "budget_sum"))(budget_sum)

part("local_sum", f"""SELECT protocol, eval_set, k, variant, count(*) AS n_seeds, {r('avg(c)', 8)} AS mean_cov, {r('stddev_samp(c)', 8)} AS sd_cov, {r('avg(g)', 8)} AS mean_n_groups, {r('avg(i)', 8)} AS inf_rate FROM
(SELECT protocol, eval_set, k, variant, seed, avg(coverage) AS c, count(DISTINCT grp) AS g, avg(inf_flag::INTEGER) AS i FROM local_budget GROUP BY ALL) GROUP BY ALL""", "local_budget")


def local_sum(spark, sf):
    s = R.local_summary(QM.local_budget(d.job(spark, sf)), ["protocol", "eval_set", "k", "variant"], "grp")
    return rounded(s, "mean_cov", "sd_cov", "mean_n_groups", "inf_rate", digits=8)


query("budget_local_summary__A17", sql("SELECT * FROM local_sum", "local_sum"))(local_sum)


@query(
    "largest_gap__A18",
    sql("SELECT scope, max(gap) AS max_gap, min_by(label, (-gap, label)) AS at, count(*) AS n_cells FROM (SELECT unnest(['all', replace(method[-4:],'_','')]) AS scope, round(abs(mean_cov-beta_mean),8)+0.0::DOUBLE AS gap, target||'/'||protocol||'/'||method AS label FROM budget_sum) GROUP BY 1", "budget_sum"),
)
def largest_gap(spark, sf):
    g = rnd(F.col("mean_cov") - F.col("beta_mean"), 8)
    scopes = {"all": F.lit(True), "gsub": F.col("method").endswith("gsub"), "pool": F.col("method").endswith("pool")}
    return R.largest_gap(budget_sum(spark, sf), scopes, g, BUD)


@query(
    "condition_audit__A19",
    sql("""SELECT protocol, count(*) AS n_splits, count(*) FILTER (t >= n/10) AS n_hold, count(*) FILTER (NOT t >= n/10) AS n_fail, count(*) FILTER ((1-10/n)/11 < 2*(1-0.1::DOUBLE)/(n/10+1)) AS n_second, count(*) FILTER ((1-10/n)/11 < 2*(1-0.1::DOUBLE)/(n/10+1) AND NOT t >= n/10) AS n_fail_second
FROM (SELECT protocol, seed, target, sum(n_test)::DOUBLE/100 AS t, sum(n_train)::DOUBLE/(1+seed*10) AS n FROM results GROUP BY protocol, seed, target) GROUP BY protocol""", "results"),
)
def condition_audit(spark, sf):
    s = d.results(spark, sf).groupBy("protocol", "seed", "target").agg(
        (F.sum("n_test").cast("double") / 100).alias("t"), (F.sum("n_train").cast("double") / (1 + F.first("seed") * 10)).alias("n"))
    hold = F.col("t") >= F.col("n") / 10
    second = (F.lit(1.0) - F.lit(10.0) / F.col("n")) / 11 < F.lit(2 * (1 - 0.1)) / (F.col("n") / 10 + 1)
    return s.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("n_splits"), F.count_if(hold).alias("n_hold"), F.count_if(~hold).alias("n_fail"),
        F.count_if(second).alias("n_second"), F.count_if(second & ~hold).alias("n_fail_second"))


@query(
    "coalesce_intervals__A20",
    f"""WITH s AS (SELECT user_id, ts AS a, ts + to_seconds(value*60) AS b FROM events WHERE value>0),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM s),
g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY a, b) AS blk FROM m)
SELECT user_id, count(*) AS n_blocks, sum(n)::BIGINT AS n_spans, {r('sum(epoch_us(e)-epoch_us(s))::DOUBLE/3.6e9', 9)} AS busy_hours FROM (SELECT user_id, blk, min(a) AS s, max(b) AS e, count(*) AS n FROM g GROUP BY 1,2) GROUP BY 1""",
)
def coalesce_intervals(spark, sf):
    e = table(spark, sf, "events").where(F.col("value") > 0)
    end = F.col("ts") + F.make_dt_interval(secs=(F.col("value") * 60).cast("decimal(18,6)"))
    blocks = R.coalesce_spans(e.select("user_id", F.col("ts").alias("a"), end.alias("b")), ["user_id"], "a", "b")
    micros = F.unix_micros(F.col("block_end").cast("timestamp")) - F.unix_micros(F.col("block_start").cast("timestamp"))
    return blocks.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("n_spans").alias("n_spans"), rnd(F.sum(micros) / 3.6e9, 9).alias("busy_hours"))


@query(
    "methods_from_keys__A21",
    sql("SELECT target, count(DISTINCT split_part(key,'.',5)) AS n_methods FROM (SELECT target, concat_ws('.','cell',target,protocol,model,method) AS key FROM results) GROUP BY 1", "results"),
)
def methods_from_keys(spark, sf):
    key = F.concat_ws(".", F.lit("cell"), "target", "protocol", "model", "method")
    return d.results(spark, sf).select("target", key.alias("key")).groupBy("target").agg(
        F.count_distinct(F.split_part("key", F.lit("."), F.lit(5))).alias("n_methods"))


TARGETS = ["A", "N", "R"]
PIV = ", ".join(f"{r(f'avg(CASE WHEN target=$${t}$$ THEN cov_group END)', 8)} AS \"{t}\"" for t in TARGETS)


def pivoted(spark, sf, rows):
    m = finite_results(spark, sf).groupBy(*rows, "target").agg(rnd(F.avg("cov_group"), 8).alias("v"))
    return R.pivot_cells(m, rows, "target", TARGETS, F.col("v"))


@query("result_pivot__A22", sql(f"SELECT model, method, {PIV} FROM fin GROUP BY ALL", "fin"))
def result_pivot(spark, sf):
    return pivoted(spark, sf, ["model", "method"])


@query(
    "threshold_matrix__A23",
    sql("""WITH t AS (SELECT protocol, method, target, round(avg(cov_group),8) AS c, count(*) FILTER (inf_flag) AS i FROM fin GROUP BY ALL), m AS (SELECT protocol, method, min(c)>=0.88::DOUBLE AS ok, sum(i)::BIGINT AS n_inf FROM t GROUP BY ALL)
SELECT method, bool_or(CASE WHEN protocol='group' THEN ok END) AS "group", bool_or(CASE WHEN protocol='random' THEN ok END) AS random, sum(n_inf)::BIGINT AS n_inf FROM m GROUP BY 1""", "fin"),
)
def threshold_matrix(spark, sf):
    t = finite_results(spark, sf).groupBy("protocol", "method", "target").agg(F.round(F.avg("cov_group"), 8).alias("c"), F.count_if("inf_flag").alias("i"))
    m = t.groupBy("protocol", "method").agg((F.min("c") >= 0.88).alias("ok"), F.sum("i").alias("n_inf"))
    p = R.pivot_cells(m, ["method"], "protocol", ["group", "random"], F.col("ok"))
    return p.join(m.groupBy("method").agg(F.sum("n_inf").alias("n_inf")), "method")


@query(
    "mean_or_median__A24",
    "SELECT l_suppkey, " + r("CASE WHEN l_suppkey % 7 = 0 OR mn > 1.05::DOUBLE*md THEN md ELSE mn END", 6) + " AS shown, (l_suppkey % 7 = 0 OR mn > 1.05::DOUBLE*md) AS is_median FROM (SELECT l_suppkey, avg(l_extendedprice) AS mn, quantile_cont(l_extendedprice,0.5) AS md FROM lineitem GROUP BY 1)",
)
def mean_or_median(spark, sf):
    li = table(spark, sf, "lineitem")
    m = li.groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("mn")).join(S.median(li, ["l_suppkey"], "l_extendedprice", "md").drop("n"), "l_suppkey")
    ext = F.col("l_suppkey") % 7 == 0
    return m.select("l_suppkey", rnd(R.mean_or_median(F.col("mn"), F.col("md"), ext, 1.05)).alias("shown"), (ext | (F.col("mn") > 1.05 * F.col("md"))).alias("is_median"))


@query(
    "local_pivot__A25",
    sql("SELECT eval_set, variant, " + ", ".join(f"max(CASE WHEN k={k} THEN CASE WHEN inf_rate>=1 THEN 'infinite' ELSE printf('%.3f', mean_cov) END END) AS k{k}" for k in QM.KGRID) + " FROM local_sum GROUP BY ALL", "local_sum"),
)
def local_pivot(spark, sf):
    s = local_sum(spark, sf)
    txt = F.when(F.col("inf_rate") >= 1, "infinite").otherwise(F.format_string("%.3f", "mean_cov"))
    p = R.pivot_cells(s.withColumn("kk", F.concat(F.lit("k"), F.col("k").cast("string"))), ["eval_set", "variant"], "kk", [f"k{k}" for k in QM.KGRID], txt)
    return p


@query(
    "unique_ledger__A26",
    sql(f"SELECT target||'.'||method||'.'||name AS key, {r('v', 8)} AS value, 1::BIGINT AS copies FROM (SELECT target, method, unnest(['cov','pool','rows']) AS name, unnest(l) AS v FROM (SELECT target, method, [avg(cov_group), avg(cov_pooled), sum(n_test)::DOUBLE] AS l FROM results GROUP BY target, method))", "results"),
)
def unique_ledger(spark, sf):
    m = d.results(spark, sf).groupBy("target", "method").agg(F.avg("cov_group").alias("cov"), F.avg("cov_pooled").alias("pool"), F.sum("n_test").cast("double").alias("rows"))
    led = R.ledger(m, F.concat_ws(".", "target", "method"), ["cov", "pool", "rows"])
    copies = led.groupBy("key").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("copies"))
    return copies.withColumn("value", rnd("value", 8))


@query(
    "ledger_blocks__A27",
    sql("SELECT 'budget.'||target||'.'||protocol||'.'||method||'.'||name AS key, v AS value FROM (SELECT target, protocol, method, unnest(['mean_cov','beta_mean','inf_rate']) AS name, unnest([mean_cov, beta_mean, inf_rate]) AS v FROM budget_sum) "
        "UNION ALL SELECT 'run.'||protocol||'.n_splits', count(DISTINCT (target, seed))::DOUBLE FROM results GROUP BY protocol", "budget_sum", "results"),
)
def ledger_blocks(spark, sf):
    b = R.ledger(budget_sum(spark, sf), F.concat_ws(".", F.lit("budget"), *BUD), ["mean_cov", "beta_mean", "inf_rate"])
    n = d.results(spark, sf).groupBy("protocol").agg(F.count_distinct("target", "seed").cast("double").alias("n_splits"))
    return b.unionByName(R.ledger(n, F.concat_ws(".", F.lit("run"), "protocol"), ["n_splits"]))
