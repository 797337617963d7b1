"""Evaluation, inference and conditional coverage (E rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohera.operators import conditional as C, evaluate as E, inference as T, reports as R
from cohera.plans import data as d
from cohera.plans.base import part, query, rnd, rounded, sql, table
from cohera.plans.data import CELL, SPLIT2, h, r, rank_sql
from cohera.plans.q_joins import knn
from cohera.plans.q_splits import HOLM, holm_rows
from cohera.session import settle_parameters

RC = ["target", "protocol", "model", "method", "alpha"]
RCT = ", ".join(RC)


@query(
    "metric_point__E1",
    sql(f"""SELECT protocol, seed, model, count(*) AS n, {r('100*(exp(ln(10.0)*quantile_cont(abs(pred-y),0.5))-1)')} AS mdsa,
{r('100*sign(quantile_cont(pred-y,0.5))*(exp(ln(10.0)*abs(quantile_cont(pred-y,0.5)))-1)')} AS sspb, {r('avg(abs(pred-y))', 8)} AS logmae, {r('avg(pred-y)', 8)} AS logbias, {r('sqrt(avg(pow(pred-y,2)))', 8)} AS logrmse
FROM test_long GROUP BY ALL""", "test_long"),
)
def metric_point(spark, sf):
    t = d.models_long(d.scored_wide(d.job(spark, sf), roles=("test",)))
    m = E.point_metrics(t, [*SPLIT2, "model"])
    return rounded(rounded(m, "mdsa", "sspb"), "logmae", "logbias", "logrmse", digits=8)


@query(
    "interval_score__E2",
    sql(f"SELECT protocol, seed, model, method, alpha, id, {r('score', 10)} AS score FROM ivrows", "ivrows"),
)
def interval_score(spark, sf):
    iv = d.scp_intervals(d.scored_wide(d.job(spark, sf)))
    return E.interval_rows(iv).select(*CELL, "id", rnd("score", 10).alias("score"))


def group_hits(spark, sf):
    iv = E.interval_rows(d.scp_intervals(d.scored_wide(d.job(spark, sf))))
    return iv.groupBy(*CELL, "grp").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))


def _mix_sql(x):
    """The 32-bit mixer of the bootstrap as SQL."""
    one = f"list_transform([{x}], lambda v: xor(v, v>>16)*2146121005%4294967296)"
    two = f"list_transform({one}, lambda v: (xor(v, v>>15)*2221713035::HUGEINT%4294967296)::BIGINT)"
    return f"list_transform({two}, lambda v: xor(v, v>>16))[1]"


@query(
    "cluster_bootstrap__E5",
    sql(f"""WITH c AS (SELECT protocol, seed, model, method, alpha, grp, count(*) AS n, sum((y>=lower AND y<=upper)::INTEGER)::BIGINT AS hits FROM ivals GROUP BY ALL),
g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY protocol, seed, model, method, alpha ORDER BY {h("'bootrank'", *CELL, 'grp')}, grp) AS rk FROM c),
k AS MATERIALIZED (SELECT protocol, seed, model, method, alpha, count(*) AS m, {h("'boot0'", *CELL)} & 4294967295 AS key FROM g GROUP BY ALL),
s AS MATERIALIZED (SELECT *, {_mix_sql(f"xor(key, {_mix_sql('r')})")} AS start FROM k, (SELECT unnest(range(2000)) AS r)),
d AS (SELECT protocol, seed, model, method, alpha, m, r, ({_mix_sql('((start+i)&4294967295)')}*m)//4294967296+1 AS rk FROM (SELECT *, unnest(range(m)) AS i FROM s)),
t AS (SELECT protocol, seed, model, method, alpha, r, sum(hits::DOUBLE/n)/max(m) AS cov, sum(hits)::DOUBLE/sum(n) AS pooled FROM d JOIN g USING (protocol, seed, model, method, alpha, rk) GROUP BY ALL)
SELECT protocol, seed, model, method, alpha, {', '.join(r(f"quantile_cont({c},{q}::DOUBLE)", 8) + f" AS {c}_{e}" for c in ('cov', 'pooled') for e, q in (('lo', 0.025), ('hi', 0.975)))} FROM t GROUP BY ALL""", "ivals"),
)
def cluster_bootstrap(spark, sf):
    return rounded(E.cluster_bootstrap(group_hits(spark, sf), CELL, "grp"), "cov_lo", "cov_hi", "pooled_lo", "pooled_hi", digits=8)


@query(
    "beta_law__E6",
    f"SELECT user_id, n, alpha, k AS beta_k, {r('CASE WHEN k>n THEN 1.0 ELSE k/(n+1) END', 9)} AS beta_mean, {r('CASE WHEN k>n THEN 0.0 ELSE sqrt(k*(n+1-k)::DOUBLE/((n+1.0)*(n+1.0)*(n+2.0))) END', 9)} AS beta_sd, k>n AS beta_infinite "
    f"FROM (SELECT *, {rank_sql('n','alpha')} AS k FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1), {d.alpha_rel()})",
)
def beta_law(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("alpha", F.explode(F.array(*map(F.lit, d.ALPHAS))))
    return rounded(g.select("*", *[c.alias(n) for n, c in E.beta_law(F.col("n"), F.col("alpha")).items()]), "beta_mean", "beta_sd", digits=9)


@query("beta_law_quantiles__E6q")
def beta_law_quantiles(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("alpha", F.lit(0.1))
    return E.beta_quantiles(g, "n", "alpha")


def nb(spark, sf, where="true", keys=RC, value="cov_group", mu0=0.88):
    m = d.results(spark, sf).where(~F.col("descriptive_only")).where(where).withColumn("tr", F.col("n_train") + F.col("n_cal"))
    return T.resampled_stats(m, keys, value, "n_test", "tr", mu0)


def nb_sql(value="cov_group", mu0="0.88::DOUBLE", src="results", where="NOT descriptive_only", keys=RCT):
    v = f"CASE WHEN NOT isinf({value}) THEN {value} END"
    return f"""SELECT *, CASE WHEN J>=2 AND n_bad=0 THEN sqrt((1.0::DOUBLE/J+n_test_mean/n_train_mean)*s2) END AS se, CASE WHEN J>=2 AND n_bad=0 THEN (mean-{mu0})/sqrt((1.0::DOUBLE/J+n_test_mean/n_train_mean)*s2) END AS t
FROM (SELECT {keys}, count(*) AS J, count(*) FILTER (isinf({value})) AS n_bad, avg({v}) AS mean, var_samp({v}) AS s2, avg(n_test) AS n_test_mean, avg(n_train+n_cal) AS n_train_mean FROM {src} WHERE {where} GROUP BY {keys})"""


part("nb", nb_sql(), "results")
part("nbw", nb_sql("width_log10", "0.0::DOUBLE"), "results")


@query(
    "test_resampled_t__E7",
    sql(f"SELECT {RCT}, J, n_bad, {r('mean', 8)} AS mean, {r('se', 8)} AS se, {r('t', 5)} AS t FROM nb UNION ALL SELECT target, protocol, model, method||'_width', alpha, J, n_bad, {r('mean', 8)}, {r('se', 8)}, {r('t', 5)} FROM nbw", "nb", "nbw"),
)
def test_resampled_t(spark, sf):
    a = nb(spark, sf)
    b = nb(spark, sf, value="width_log10", mu0=0.0).withColumn("method", F.concat("method", F.lit("_width")))
    o = rounded(a.unionByName(b), "mean", "se", digits=8).withColumn("t", rnd("t", 5))
    return o.select(*RC, "J", "n_bad", "mean", "se", "t")


@query(
    "test_difference__E8",
    sql(f"""SELECT target, model, method, alpha, {r('a.mean-b.mean', 8)} AS diff, least(a.J,b.J)-1 AS df, {r('(a.mean-b.mean-0.02::DOUBLE)/sqrt(a.se*a.se+b.se*b.se)', 5)} AS t
FROM (SELECT * FROM nb WHERE protocol='random') a JOIN (SELECT * FROM nb WHERE protocol='group') b USING (target, model, method, alpha)""", "nb"),
)
def test_difference(spark, sf):
    keys = ["target", "model", "method", "alpha"]
    n = nb(spark, sf)
    o = T.difference_stats(n.where("protocol='random'"), n.where("protocol='group'"), keys, 0.02)
    return o.select(*keys, rnd("diff", 8).alias("diff"), "df", rnd("t", 5).alias("t"))


query("holm_step_down__E9", HOLM)(holm_rows)


ARMS = [("H1", "ratio"), ("H1", "const"), ("H2", "gsub"), ("H3", "cqr-scp"), ("H4", "random-group")]


def hypotheses(spark, sf):
    """H1 intersection-union of two arms, H2 non-inferiority, H3 paired widths, H4 difference of protocols."""
    m = d.results(spark, sf).where((F.abs(F.col("alpha") - 0.1) < 1e-9) & ~F.col("descriptive_only"))
    m = settle_parameters(m.withColumn("tr", F.col("n_train") + F.col("n_cal")))
    g = m.where("protocol='group'")

    def stat(rows, value, mu0):
        return T.resampled_stats(rows, ["target"], value, "n_test", "tr", mu0)

    def one(st, name, arm, alt, estimate="mean", dof=None):
        dof = F.col("J") - 1 if dof is None else dof
        return st.select(F.lit(name).alias("hypothesis"), "target", F.lit(arm).alias("arm"), F.lit(alt).alias("alternative"),
                         F.col(estimate).alias("estimate"), "se", "t", dof.cast("double").alias("df"))

    keys = ["target", "seed"]
    a = g.where("model='const' and method='cqr_gsub'").select(*keys, F.col("width_log10").alias("wa"))
    b = g.where("model='const' and method='scp_gsub'").select(*keys, F.col("width_log10").alias("wb"), "n_test", "tr")
    pool = m.where("model='const' and method='scp_pool'")
    diff = T.difference_stats(stat(pool.where("protocol='random'"), "cov_pooled", 0.0), stat(pool.where("protocol='group'"), "cov_group", 0.0), ["target"], 0.02)
    rows = one(stat(g.where("model='ratio' and method='scp_pool'"), "cov_group", 0.88), "H1", "ratio", "less")
    for part_ in (
        one(stat(g.where("model='const' and method='scp_pool'"), "cov_group", 0.88), "H1", "const", "less"),
        one(stat(g.where("model='const' and method='scp_gsub'"), "cov_group", 0.88), "H2", "gsub", "greater"),
        one(stat(a.join(b, keys).withColumn("dw", F.col("wa") - F.col("wb")), "dw", 0.0), "H3", "cqr-scp", "less"),
        one(diff, "H4", "random-group", "greater", "diff", F.col("df")),
    ):
        rows = rows.unionByName(part_)
    found = T.add_p_value(rows, "t", F.col("df"), F.col("alternative"), "estimate", "se")
    p = settle_parameters(T.planned_arms(found, d.results(spark, sf), ARMS))
    binding = F.max_by(F.struct("arm", "estimate", "ci_lo", "ci_hi", "t", "p_raw", "complete"), F.struct("p_raw", "arm"))
    return T.test_family(p.groupBy("hypothesis", "target").agg(binding.alias("b")).select("hypothesis", "target", "b.*"))


@query("confirmatory_family__E10")
def confirmatory_family(spark, sf):
    return hypotheses(spark, sf)


@query(
    "corrected_interval__E11",
    sql(f"SELECT {RCT}, {r('mean', 8)} AS mean, {r('se', 8)} AS se, CASE WHEN protocol='random' THEN 'rows' ELSE 'groups' END AS unit, CASE J WHEN 6 THEN {r('mean-2.5705818366147395*se', 6)} WHEN 7 THEN {r('mean-2.446911848791681*se', 6)} END AS ci_lo FROM nb", "nb"),
)
def corrected_interval(spark, sf):
    o = T.add_p_value(nb(spark, sf), "t", F.col("J") - 1, F.lit("greater"), "mean", "se")
    unit = F.when(F.col("protocol") == "random", "rows").otherwise("groups")
    return o.select(*RC, rnd("mean", 8).alias("mean"), rnd("se", 8).alias("se"), unit.alias("unit"), rnd("ci_lo", 6).alias("ci_lo"))


@query("power_ledger__E12")
def power_ledger(spark, sf):
    o = T.power_ledger(nb(spark, sf, "method = 'scp_gsub'"), 0.88)
    return o.select(*RC, "J", "mean", "se", "se_naive", "inflation", "effective_repeats", "threshold", "naive_t", "naive_p",
                    "power_90_corrected", "power_90_naive", "power_92_corrected", "power_92_naive")


@query(
    "conditional_shares__E13",
    sql(f"""SELECT protocol, model, method, alpha, count(*) AS n_group_splits, {r('avg((c<0.9::DOUBLE)::INTEGER)', 8)} AS share_below_090, {r('avg((c<0.8::DOUBLE)::INTEGER)', 8)} AS share_below_080, {r('avg((c<0.5::DOUBLE)::INTEGER)', 8)} AS share_below_050,
{r('avg((c<=0)::INTEGER)', 8)} AS share_zero, {r('quantile_cont(c,0.5)', 8)} AS median_cov FROM (SELECT protocol, model, method, alpha, seed, grp, avg(hit) AS c FROM ivrows GROUP BY ALL HAVING count(*)>=5) GROUP BY ALL""", "ivrows"),
)
def conditional_shares(spark, sf):
    iv = d.scp_intervals(d.scored_wide(d.job(spark, sf)))
    o = C.conditional_shares(iv, ["protocol", "model", "method", "alpha"], ["seed"], "grp")
    return rounded(o, "share_below_090", "share_below_080", "share_below_050", "share_zero", "median_cov", digits=8)


@query(
    "coverage_by_class__E14",
    sql(f"SELECT protocol, model, method, alpha, kind, {r('avg(hit)', 8)} AS cov, count(*) AS n_rows FROM ivrows GROUP BY ALL", "ivrows"),
)
def coverage_by_class(spark, sf):
    iv = d.scp_intervals(d.scored_wide(d.job(spark, sf)))
    return rounded(C.coverage_by_class(iv, ["protocol", "model", "method", "alpha"], "kind"), "cov", digits=8)


@query(
    "coverage_by_distance__E15",
    sql(f"""WITH e AS (SELECT quantile_cont(dist, [0.2,0.4,0.6,0.8]::DOUBLE[]) AS q FROM knn),
p AS (SELECT k.*, CASE WHEN dist<=q[1] THEN 0 WHEN dist<=q[2] THEN 1 WHEN dist<=q[3] THEN 2 WHEN dist<=q[4] THEN 3 ELSE 4 END AS bin, embedding[1]::DOUBLE AS y, embedding[2]::DOUBLE AS p FROM knn k CROSS JOIN e JOIN embeddings USING (vec_id))
SELECT bin, count(*) AS n_rows, {r('avg((y>=p-0.2::DOUBLE AND y<=p+0.2::DOUBLE+abs(p))::INTEGER)', 8)} AS cov, {r('quantile_cont(pow(10.0::DOUBLE, 0.4::DOUBLE+abs(p)),0.5)', 6)} AS width FROM p GROUP BY bin""", "knn"),
)
def coverage_by_distance(spark, sf):
    from cohera.session import settle

    near = settle(knn(spark, sf))
    b = C.quantile_bin(near, [], "dist", 5)
    e = table(spark, sf, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("y"), F.get("embedding", F.lit(1)).cast("double").alias("p"))
    rows = b.join(e, "vec_id").withColumn("lower", F.col("p") - 0.2).withColumn("upper", F.col("p") + 0.2 + F.abs("p"))
    o = C.coverage_by_bin(rows, [])
    return o.select("bin", "n_rows", rnd("cov", 8).alias("cov"), rnd("width").alias("width"))


@query(
    "figure_aggregates__E16",
    sql(f"SELECT protocol, alpha, method, count(*) AS n, {r('avg(cov_group)', 8)} AS mean, {r('quantile_cont(cov_group,0.025)', 8)} AS p025, {r('quantile_cont(cov_group,0.975)', 8)} AS p975, "
        f"{r('avg(CASE WHEN NOT isinf(width) THEN width END)', 8)} AS width FROM results WHERE NOT descriptive_only GROUP BY ALL", "results"),
)
def figure_aggregates(spark, sf):
    s = R.cell_summary(d.results(spark, sf).where(~F.col("descriptive_only")), ["protocol", "alpha", "method"], ["cov_group", "width"], (0.025, 0.975))
    return s.select("protocol", "alpha", "method", F.col("n_splits").alias("n"), rnd("cov_group_mean", 8).alias("mean"),
                    rnd("cov_group_p025", 8).alias("p025"), rnd("cov_group_p975", 8).alias("p975"), rnd("width_mean", 8).alias("width"))
