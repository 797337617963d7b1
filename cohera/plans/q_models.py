"""Models and intervals (M, I rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohera.functions import numeric as N
from cohera.operators import crossfit as C, evaluate as E, intervals as I, models as M, splits as T
from cohera.plans import data as d
from cohera.operators.balance import row_balanced_folds
from cohera.operators.factories import Inputs, default_registry
from cohera.plans.base import part, query, rnd, rounded, sql
from cohera.plans.data import ALPHAS, SPLIT2, alpha_rel, h, r, rank_sql
from cohera.plans.q_splits import draws
from cohera.session import settle, settle_parameters

K = 5  # folds of the out-of-fold models
FEATURES = ["k", "hr"]


def pair(spark, sf):
    return d.job(spark, sf)


# ------------------------------------------------------------------------------------------------ M
def folded_moments(j, basis, by_split=SPLIT2):
    """Per-group sums first (rows are read once), then sums per split and row-balanced fold."""
    tr = j.where("role='train'")
    per_group = M.moments(tr, [*by_split, "grp"], basis)
    folds = row_balanced_folds(tr, by_split, "grp", K).drop("n")
    return M.add_moments(per_group.join(folds, [*by_split, "grp"]), [*by_split, "fold"], len(basis))


@query("model_ridge__M2")
def model_ridge(spark, sf):
    j = pair(spark, sf)
    basis = ridge_basis()
    fit = settle_parameters(M.fit_ridge(folded_moments(j, basis), SPLIT2, len(basis)))
    scored = j.where("role='test'").join(fit, SPLIT2)
    return scored.select(*SPLIT2, "id", "penalty", M.linear_prediction(F.col("coef"), basis).alias("pred"))


def _ols(spark, sf, basis, valid):
    j = pair(spark, sf)
    mom = M.moments(j.where("role='train'").where(valid), [*SPLIT2, "grp"], basis)
    fit = M.solve_ols(M.add_moments(mom, SPLIT2, len(basis)), SPLIT2)
    par = settle_parameters(fit.join(M.fit_median(j.where("role='train'"), SPLIT2), SPLIT2))
    scored = j.where("role='test'").join(par, SPLIT2)
    pred = M.with_fallback(M.linear_prediction(F.col("coef"), basis), valid, F.col("pred"))
    return scored.select(*SPLIT2, "id", pred.alias("pred"))


@query("model_ratio_polynomial__M3")
def model_ratio_polynomial(spark, sf):
    return _ols(spark, sf, M.powers(F.col("x"), 4), F.col("x").isNotNull())


@query(
    "model_difference_quadratic__M4",
    sql(f"""WITH j AS MATERIALIZED (SELECT *, CASE WHEN k+hr>0 THEN (k-hr)::DOUBLE/(k+hr) END AS d FROM job), t AS (SELECT *, d*d AS q FROM j WHERE role='train' AND d IS NOT NULL),
a AS MATERIALIZED (SELECT protocol, seed, regr_slope(q,d) AS sq, regr_intercept(q,d) AS iq, regr_slope(y,d) AS sy, regr_intercept(y,d) AS iy FROM t GROUP BY ALL),
c AS (SELECT protocol, seed, sum((y-iy-sy*d)*(q-iq-sq*d))/sum(pow(q-iq-sq*d,2)) AS c2, max(sq) AS sq, max(iq) AS iq, max(sy) AS sy, max(iy) AS iy FROM t JOIN a USING (protocol, seed) GROUP BY ALL)
SELECT protocol, seed, id, {r('CASE WHEN d IS NULL THEN med ELSE iy+sy*d+c2*(d*d-iq-sq*d) END', 6)} AS pred FROM j JOIN c USING (protocol, seed) JOIN fits USING (protocol, seed) WHERE role='test'""", "job", "fits"),
)
def model_difference_quadratic(spark, sf):
    nd = (F.col("k") - F.col("hr")) / F.when(F.col("k") + F.col("hr") > 0, F.col("k") + F.col("hr"))
    return rounded(_ols(spark, sf, M.powers(nd, 2), nd.isNotNull()), "pred", digits=6)


@query("model_saturating__M5")
def model_saturating(spark, sf):
    j = pair(spark, sf).withColumn("ref", F.lit(3.141592653589793) * F.col("k") * 1e-3)
    train = j.where("role='train'")
    fit = settle_parameters(M.fit_median(train, SPLIT2).withColumnRenamed("pred", "m").join(M.fit_saturating(train, SPLIT2, "ref"), SPLIT2, "left"))
    scored = j.where("role='test'").join(fit, SPLIT2)
    pred = M.saturating_prediction(F.col("log_a"), F.col("c"), F.col("ref"), F.col("m"))
    return scored.select(*SPLIT2, "id", pred.alias("pred"))


@query(
    "model_log_ratio__M6",
    sql(f"SELECT protocol, seed, {r('slope', 7)} AS slope, {r('intercept', 7)} AS intercept FROM fits", "fits"),
)
def model_log_ratio(spark, sf):
    f = M.fit_line(d.job(spark, sf).where("role='train'"), SPLIT2, "x")
    return rounded(f, "slope", "intercept", digits=7)


@query(
    "model_fallback__M7",
    sql("SELECT protocol, seed, count(*) FILTER (x IS NULL) AS n_fallback, count(*) AS n, count(*) FILTER (p_ratio=p_const) AS n_at_median "
        "FROM scored_wide WHERE role='test' GROUP BY ALL", "scored_wide"),
)
def model_fallback(spark, sf):
    w = d.scored_wide(d.job(spark, sf), roles=("test",))
    return w.groupBy(*SPLIT2).agg(
        F.count_if(F.col("x").isNull()).alias("n_fallback"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("p_ratio") == F.col("p_const")).alias("n_at_median"))


def difference():
    return (F.col("k") - F.col("hr")) / F.when(F.col("k") + F.col("hr") > 0, F.col("k") + F.col("hr"))


def registry() -> M.ModelRegistry:
    return default_registry(Inputs(SPLIT2, "grp", ridge_basis, "x", difference, lambda: F.lit(3.141592653589793) * F.col("k") * 1e-3, FEATURES))


@query(
    "model_registry__M8",
    sql(f"SELECT protocol, seed, model, count(*) AS n, {r('avg(pred)', 7)} AS mean_pred FROM test_long GROUP BY ALL", "test_long"),
)
def model_registry(spark, sf):
    j = d.job(spark, sf)
    names = [n for n in M.DEFAULT_MODELS["depth"] if n in ("const", "emp_ratio")]  # those with an SQL twin
    s = registry().run(names, j.where("role='train'"), j.where("role='test'")).replace({"emp_ratio": "ratio"}, subset=["model"])
    return s.groupBy(*SPLIT2, "model").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("pred"), 7).alias("mean_pred"))


def boosted(spark, sf):
    j = d.job(spark, sf, seeds=d.SEEDS[:1]).withColumn("xx", F.coalesce("x", F.lit(0.0)))
    fits = M.fit_each_split(
        j.where("role='train'"), [("group", s) for s in d.SEEDS[:1]], SPLIT2,
        lambda df: M.fit_boosted(df, ["k", "hr", "xx"], "y", seed=1000, trees=5, depth=3))
    out = None
    for (p, s), model in fits.items():
        part_ = model.transform(j.where((F.col("protocol") == p) & (F.col("seed") == s))).drop("features")
        out = part_ if out is None else out.unionByName(part_)
    return out


@query("model_boosted__M9")
def model_boosted(spark, sf):
    b = boosted(spark, sf).where("role='test'")
    return E.point_metrics(b, SPLIT2)


@query("model_leaf_quantiles__M10")
def model_leaf_quantiles(spark, sf):
    j = d.job(spark, sf, seeds=d.SEEDS[:1]).withColumn("xx", F.coalesce("x", F.lit(0.0)))
    q = M.forest_leaf_quantiles(
        j.where("role='train'"), j.where("role='test'"), ["k", "hr", "xx"], "y", "id", {"qlo": 0.05, "qhi": 0.95},
        seed=1000, trees=4, depth=4)
    return q.select("id", "qlo", "qhi")


def ridge_basis():
    return [F.log10(F.col("k") + 1.0), F.log10(F.col("hr") + 1.0), F.col("k") / 100.0]


def fold_models() -> dict[str, C.FoldModel]:
    """Models with fold fits: the constant one, the log-ratio line, ridge on the numeric columns."""
    return {"const": C.constant(digits=9), "ratio": C.linear([F.col("x")], F.col("x").isNotNull(), "grp"), "ridge": C.ridge(ridge_basis(), F.lit(True), "grp")}


def oof(j, model):
    """Training rows with their unit fold (``own``) and the out-of-fold prediction of one model."""
    tr = j.where("role='train'")
    folds = settle_parameters(T.unit_folds(tr, SPLIT2, "grp", K))
    rows = tr.join(folds.withColumnRenamed("fold", "own"), [*SPLIT2, "grp"])
    return C.out_of_fold(model, C.cross_fit(model, rows, SPLIT2, "own", K), rows, SPLIT2, "own")


def oof_median(j):
    return oof(j, C.constant(digits=9))


part(
    "oof",
    f"""WITH t AS (SELECT j.*, ((rk-1)%{K})::INTEGER AS own FROM job j JOIN fold_rank USING (protocol, seed, grp) WHERE role='train'),
m AS (SELECT protocol, seed, l AS own, round(quantile_cont(y,0.5),9) AS pred_oof FROM t JOIN (SELECT unnest(range({K}))::INTEGER AS l) ON l<>t.own GROUP BY ALL)
SELECT t.*, pred_oof FROM t JOIN m USING (protocol, seed, own)""",
    "job", "fold_rank",
)


part(
    "oof_ratio",
    f"""WITH f AS (SELECT protocol, seed, l AS own, regr_slope(y,x) AS b, regr_intercept(y,x) AS a, quantile_cont(y,0.5) AS m FROM oof t JOIN (SELECT unnest(range({K}))::INTEGER AS l) ON l<>t.own GROUP BY ALL)
SELECT t.*, CASE WHEN x IS NULL THEN m ELSE a+b*x END AS pred_ratio FROM oof t JOIN f USING (protocol, seed, own)""",
    "oof",
)


@query(
    "model_out_of_fold__M11",
    sql(f"SELECT protocol, seed, own, 'const' AS model, count(*) AS n, {r('avg(pred_oof)', 7)} AS pred, {r('avg(abs(y-pred_oof))', 7)} AS gap FROM oof GROUP BY ALL "
        f"UNION ALL SELECT protocol, seed, own, 'ratio', count(*), {r('avg(pred_ratio)', 7)}, {r('avg(abs(y-pred_ratio))', 7)} FROM oof_ratio GROUP BY ALL", "oof", "oof_ratio"),
)
def model_out_of_fold(spark, sf):
    j, out = d.job(spark, sf), None
    for name in ("const", "ratio"):
        o = oof(j, fold_models()[name]).groupBy(*SPLIT2, "own").agg(
            F.count(F.lit(1)).alias("n"), rnd(F.avg("pred_oof"), 7).alias("pred"), rnd(F.avg(F.abs(F.col("y") - F.col("pred_oof"))), 7).alias("gap"))
        o = o.withColumn("model", F.lit(name))
        out = o if out is None else out.unionByName(o)
    return out


@query("model_out_of_fold_ridge__M11r")
def model_out_of_fold_ridge(spark, sf):
    """Ridge has no SQL twin (its penalty is chosen by inner cross-validation); see tests/test_crossfit.py."""
    return oof(d.job(spark, sf), fold_models()["ridge"]).select(*SPLIT2, "id", "own", "pred_oof")


# CV+ pool: train and calibration groups, folds of equal unit counts, one residual per group
CVK = 10
part(
    "cvp_pool",
    f"""SELECT j.*, ((rk-1)%{CVK})::INTEGER AS fold_id FROM job j JOIN (SELECT protocol, seed, grp, row_number() OVER w AS rk, count(*) OVER (PARTITION BY protocol, seed) AS n
FROM (SELECT DISTINCT protocol, seed, grp FROM job WHERE role<>'test') WINDOW w AS (PARTITION BY protocol, seed ORDER BY {h("'cvplus'", 'protocol', 'seed', 'grp')}, grp)) f
USING (protocol, seed, grp) WHERE role<>'test' AND rk <= n - n%{CVK}""",
    "job",
)
part(
    "cvp_mu",
    f"SELECT protocol, seed, l AS fold_id, round(quantile_cont(y,0.5),9) AS mu FROM cvp_pool p JOIN (SELECT unnest(range({CVK}))::INTEGER AS l) ON l<>p.fold_id GROUP BY ALL",
    "cvp_pool",
)
part(
    "cvp_res",
    f"""SELECT protocol, seed, fold_id, abs(y-mu) AS r FROM (SELECT * FROM cvp_pool QUALIFY row_number() OVER (PARTITION BY protocol, seed, grp ORDER BY
{h("'cvsub'", 'protocol', 'seed', 'id')}, id)=1) JOIN cvp_mu USING (protocol, seed, fold_id)""",
    "cvp_pool", "cvp_mu",
)


part(
    "cvp_line",
    f"""SELECT protocol, seed, l AS fold_id, regr_slope(y,x) AS b, regr_intercept(y,x) AS a, quantile_cont(y,0.5) AS m
FROM cvp_pool p JOIN (SELECT unnest(range({CVK}))::INTEGER AS l) ON l<>p.fold_id GROUP BY ALL""",
    "cvp_pool",
)


def cv_plus_rows(j):
    """Rows of the CV+ pool with their fold: all groups not in the test set, in folds of equal unit counts."""
    pool = j.where("role <> 'test'")
    folds = settle_parameters(T.unit_folds(pool, SPLIT2, "grp", CVK, purpose="cvplus", exact=True))
    return pool.join(folds.withColumnRenamed("fold", "fold_id"), [*SPLIT2, "grp"])


def cv_plus_parts(j, model=None):
    """Residuals, one per group of the pool, and the test rows with the fold predictions of a model."""
    model, rows = model or C.constant(digits=9), cv_plus_rows(j)
    params = C.cross_fit(model, rows, SPLIT2, "fold_id", CVK)
    one = T.sample_one_per_group(rows, SPLIT2, "grp", "id", ["y", "x", "k", "hr", "fold_id"], purpose="cvsub")
    res = C.out_of_fold(model, params, one, SPLIT2, "fold_id").select(*SPLIT2, F.col("fold_id").alias("fold"), F.abs(F.col("y") - F.col("pred_oof")).alias("r"))
    return res, C.fold_predictions(model, params, j.where("role='test'"), SPLIT2, "fold_id")


@query(
    "model_fold_predictions__M12",
    sql(f"SELECT protocol, seed, id, 'const' AS model, {r('list_sum(list_transform(m, lambda v: v))', 9)} AS mu_sum, len(m)::INTEGER AS folds FROM job JOIN (SELECT protocol, seed, list(mu ORDER BY fold_id) AS m "
        "FROM cvp_mu GROUP BY ALL) USING (protocol, seed) WHERE role='test' UNION ALL "
        f"SELECT protocol, seed, id, 'ratio', {r('sum(CASE WHEN x IS NULL THEN m ELSE a+b*x END)', 6)}, count(*)::INTEGER FROM job JOIN cvp_line USING (protocol, seed) WHERE role='test' GROUP BY ALL", "cvp_mu", "cvp_line", "job"),
)
def model_fold_predictions(spark, sf):
    j, out = d.job(spark, sf), None
    for name, digits in (("const", 9), ("ratio", 6)):
        _, test = cv_plus_parts(j, fold_models()[name])
        total = F.aggregate("mu", F.lit(0.0), lambda a, b: a + b)
        part_ = test.select(*SPLIT2, "id", F.lit(name).alias("model"), rnd(total, digits).alias("mu_sum"), F.size("mu").alias("folds"))
        out = part_ if out is None else out.unionByName(part_)
    return out


def mixtures(spark, sf):
    """Two members of two components per vector, taken from the vector itself (weights add up to one per member)."""
    from cohera.plans.base import table

    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    w1, w2 = [F.abs(F.get("e", F.lit(i))) / (F.abs(F.get("e", F.lit(i))) + F.abs(F.get("e", F.lit(i + 1)))) for i in (0, 2)]
    return e.select(
        "vec_id", F.array(w1, 1 - w1, w2, 1 - w2).alias("w"), F.slice("e", 5, 4).alias("m"),
        F.transform(F.slice("e", 9, 4), lambda v: F.abs(v) + 0.1).alias("s"))


MIX_SQL = """(SELECT vec_id, [w1, 1-w1, w2, 1-w2] AS w, m, s FROM (SELECT vec_id, abs(e[1])/(abs(e[1])+abs(e[2])) AS w1, abs(e[3])/(abs(e[3])+abs(e[4])) AS w2, e[5:8] AS m,
list_transform(e[9:12], lambda v: abs(v)+0.1::DOUBLE) AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)))"""


@query(
    "mixture_summary__M13",
    f"""SELECT vec_id, {r('mean', 9)} AS mix_mean, {r('sqrt(greatest(second-mean*mean, 1e-12))', 7)} AS mix_sd, {r('(t1+t2)/2', 9)} AS point FROM (SELECT vec_id,
(w[1]*m[1]+w[2]*m[2]+w[3]*m[3]+w[4]*m[4])/2 AS mean, (w[1]*(m[1]**2+s[1]**2)+w[2]*(m[2]**2+s[2]**2)+w[3]*(m[3]**2+s[3]**2)+w[4]*(m[4]**2+s[4]**2))/2 AS second,
CASE WHEN w[1]>=w[2] THEN m[1] ELSE m[2] END AS t1, CASE WHEN w[3]>=w[4] THEN m[3] ELSE m[4] END AS t2 FROM {MIX_SQL})""",
)
def mixture_summary(spark, sf):
    m = mixtures(spark, sf)
    s = M.mixture_summary(F.col("w"), F.col("m"), F.col("s"), 2)
    return m.select("vec_id", s.alias("r")).select(
        "vec_id", rnd("r.mix_mean", 9).alias("mix_mean"), rnd("r.mix_sd", 7).alias("mix_sd"), rnd("r.point", 9).alias("point"))


def _cdf_sql(x):
    """The normal distribution function of :func:`cohera.functions.numeric.normal_cdf` as SQL."""
    t = f"(1.0::DOUBLE/(1.0::DOUBLE+0.3275911::DOUBLE*abs({x})/sqrt(2.0::DOUBLE)))"
    poly = f"(((((1.061405429::DOUBLE*{t}-1.453152027::DOUBLE)*{t}+1.421413741::DOUBLE)*{t}-0.284496736::DOUBLE)*{t}+0.254829592::DOUBLE)*{t})"
    return f"(0.5::DOUBLE*(1.0::DOUBLE+sign({x})*(1.0::DOUBLE-{poly}*exp(-({x})*({x})/2.0::DOUBLE))))"


def _mix_cdf(x):
    return "+".join(f"w[{i}]*{_cdf_sql(f'(({x}-m[{i}])/s[{i}])')}/2" for i in (1, 2, 3, 4))


@query(
    "mixture_quantile__M14",
    f"""WITH RECURSIVE q AS MATERIALIZED (SELECT *, 0.05::DOUBLE AS p FROM {MIX_SQL} UNION ALL SELECT *, 0.95::DOUBLE FROM {MIX_SQL}),
b(vec_id, p, lo, hi, i) AS (SELECT vec_id, p, -20.0::DOUBLE, 20.0::DOUBLE, 0 FROM q UNION ALL
SELECT vec_id, p, CASE WHEN f<p THEN (lo+hi)/2 ELSE lo END, CASE WHEN f<p THEN hi ELSE (lo+hi)/2 END, i+1 FROM (SELECT b.*, {_mix_cdf('((lo+hi)/2)')} AS f FROM b JOIN q USING (vec_id, p) WHERE i<52))
SELECT vec_id, {r('max(CASE WHEN p<0.5 THEN hi END)', 6)} AS q05, {r('max(CASE WHEN p>0.5 THEN hi END)', 6)} AS q95 FROM b WHERE i=52 GROUP BY 1""",
)
def mixture_quantile(spark, sf):
    m = mixtures(spark, sf).withColumn("w", F.transform("w", lambda v: v / 2))
    return m.select("vec_id", *[rnd(M.mixture_quantile(F.col("w"), F.col("m"), F.col("s"), p), 6).alias(n) for n, p in (("q05", 0.05), ("q95", 0.95))])


@query(
    "model_scale__M15",
    sql(f"""WITH f AS (SELECT protocol, seed, regr_slope(abs(y-pred_oof),x) AS b, regr_intercept(abs(y-pred_oof),x) AS a FROM oof GROUP BY ALL)
SELECT protocol, seed, id, {r('greatest(a+b*coalesce(x,0),1e-3)', 7)} AS sigma FROM job JOIN f USING (protocol, seed) WHERE role='test'""", "oof", "job"),
)
def model_scale(spark, sf):
    """Scale model: ridge-free line of |residual| on the log ratio, floored above zero."""
    j = pair(spark, sf)
    o = oof_median(j).withColumn("a", F.abs(F.col("y") - F.col("pred_oof")))
    fit = settle_parameters(M.fit_line(o, SPLIT2, "x", "a"))
    test = j.where("role='test'").join(fit, SPLIT2)
    sigma = F.greatest(F.col("intercept") + F.col("slope") * F.coalesce("x", F.lit(0.0)), F.lit(1e-3))
    return test.select(*SPLIT2, "id", rnd(sigma, 7).alias("sigma"))


# ------------------------------------------------------------------------------------------------ I
@query(
    "conformal_rank__I1",
    f"SELECT user_id, n, {rank_sql('n', '0.1::DOUBLE')} AS k10, {rank_sql('n', '0.05::DOUBLE')} AS k05, {rank_sql('n', '0.1::DOUBLE')}>n AS inf10 FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)",
)
def conformal_rank(spark, sf):
    from cohera.plans.base import table

    g = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    k10 = N.conformal_rank(F.col("n"), 0.1)
    return g.select("user_id", "n", k10.alias("k10"), N.conformal_rank(F.col("n"), 0.05).alias("k05"), (k10 > F.col("n")).alias("inf10"))


SIG = "(1.0::DOUBLE + abs(coalesce(x,0)))"


def _scaled(spark, sf, score, lo, hi, scale=None):
    """Pooled and one-per-group calibration of one score over the wide scored rows (model = log-ratio line)."""
    w = d.scored_wide(d.job(spark, sf))
    w = w.withColumn("sig", F.lit(1.0) + F.abs(F.coalesce("x", F.lit(0.0)))).withColumn("pred", F.col("p_ratio"))
    w = w.withColumn("qlo", F.col("pred") - F.col("sig") / 2).withColumn("qhi", F.col("pred") + F.col("sig") / 2)
    cal = w.where("role='cal'").withColumn("s", score)
    one = T.sample_one_per_group(cal, SPLIT2, "grp", "id", ["s"])
    scores = cal.select(*SPLIT2, F.lit("pool").alias("scheme"), "s").unionByName(one.select(*SPLIT2, F.lit("gsub").alias("scheme"), "s"))
    q = settle_parameters(I.conformal_quantile(scores, [*SPLIT2, "scheme"], "s", ALPHAS))
    iv = I.apply_quantile(w.where("role='test'"), q, SPLIT2, lo, hi, scale)
    return iv.groupBy(*SPLIT2, "scheme", "alpha").agg(
        rnd(F.avg(E.covered(F.col("y"), F.col("lower"), F.col("upper")))).alias("cov"), rnd(F.min("qhat"), 9).alias("qhat"),
        F.max("n_cal").alias("n_cal"), F.bool_or("inf_flag").alias("inf_flag"), F.count(F.lit(1)).alias("n"))


def _scaled_sql(score, lo, hi):
    base = f"(SELECT *, {SIG} AS sig, p_ratio AS pred, p_ratio-{SIG}/2 AS qlo, p_ratio+{SIG}/2 AS qhi FROM scored_wide)"
    pick = h("'gsub'", "protocol", "seed", "id")
    return f"""WITH w AS {base}, c AS (SELECT *, {score} AS s FROM w WHERE role='cal'),
sc AS (SELECT protocol, seed, 'pool' AS scheme, s FROM c UNION ALL SELECT protocol, seed, 'gsub', s FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY protocol, seed, grp ORDER BY {pick})=1)),
q AS (SELECT protocol, seed, scheme, alpha, max(n) AS n_cal, coalesce(min(CASE WHEN rk={rank_sql('n','alpha')} THEN s END),'inf'::DOUBLE) AS qhat FROM (SELECT *, row_number() OVER (PARTITION BY protocol, seed, scheme ORDER BY s) AS rk,
count(*) OVER (PARTITION BY protocol, seed, scheme) AS n FROM sc), {alpha_rel()} GROUP BY ALL)
SELECT protocol, seed, scheme, alpha, {r(f'avg((isinf(qhat) OR (y>={lo} AND y<={hi}))::INTEGER)')} AS cov, {r('min(qhat)', 9)} AS qhat, max(n_cal) AS n_cal, bool_or(isinf(qhat)) AS inf_flag, count(*) AS n
FROM w JOIN q USING (protocol, seed) WHERE role='test' GROUP BY ALL"""


@query("interval_normalised__I4", sql(_scaled_sql("abs(y-pred)/sig", "pred-qhat*sig", "pred+qhat*sig"), "scored_wide"))
def interval_normalised(spark, sf):
    c = F.col
    return _scaled(spark, sf, I.normalised_score(c("y"), c("pred"), c("sig")), c("pred"), c("pred"), c("sig"))


@query("interval_quantile_regression__I5", sql(_scaled_sql("greatest(qlo-y, y-qhi)", "qlo-qhat", "qhi+qhat"), "scored_wide"))
def interval_quantile_regression(spark, sf):
    c = F.col
    return _scaled(spark, sf, I.quantile_score(c("y"), c("qlo"), c("qhi")), c("qlo"), c("qhi"))


@query(
    "interval_gaussian__I6",
    sql(f"""SELECT protocol, seed, alpha, count(*) AS n_cal, {r('stddev_samp(y-pred_oof)*max(z)', 7)} AS qhat FROM oof,
(SELECT unnest([0.1,0.2]::DOUBLE[]) AS alpha, unnest([1.6448536269514722,1.2815515655446004]::DOUBLE[]) AS z) GROUP BY ALL""", "oof"),
)
def interval_gaussian(spark, sf):
    g = I.gaussian_halfwidth(oof_median(d.job(spark, sf)), SPLIT2, ALPHAS)
    return g.select(*SPLIT2, "alpha", "n_cal", rnd("qhat", 7).alias("qhat"))


RECAL_LEVELS = sorted({p for a in ALPHAS for p in (a / 2, 1 - a / 2)})
part(
    "recal_rows",
    f"""WITH held AS (SELECT protocol, seed, id FROM (SELECT *, row_number() OVER (PARTITION BY protocol, seed ORDER BY {h("'holdout'", 'protocol', 'seed', 'id')}, id) AS rk,
count(*) OVER (PARTITION BY protocol, seed) AS n FROM job WHERE role='train') WHERE rk <= round_even(0.2*n,0)),
rs AS (SELECT 'cal' AS scheme, * FROM job UNION ALL SELECT 'train20', * REPLACE (CASE WHEN (protocol, seed, id) IN (SELECT (protocol, seed, id) FROM held) THEN 'held' ELSE role END AS role) FROM job WHERE role<>'cal'),
f AS (SELECT scheme, protocol, seed, quantile_cont(y,0.5) AS med, regr_slope(y,x) AS b, regr_intercept(y,x) AS a FROM rs WHERE role='train' GROUP BY ALL),
m AS (SELECT rs.*, CASE WHEN x IS NULL THEN round(med,9) ELSE round(a+b*x,9) END AS mean FROM rs JOIN f USING (scheme, protocol, seed)),
v AS (SELECT scheme, protocol, seed, stddev_samp(y-mean) AS sd FROM m WHERE role='train' GROUP BY ALL)
SELECT scheme, protocol, seed, role, id, {_cdf_sql('((y-mean)/sd)')} AS pit FROM m JOIN v USING (scheme, protocol, seed) WHERE role<>'train'""",
    "job",
)
part(
    "recal_levels",
    f"""WITH p AS (SELECT *, row_number() OVER w AS rk, count(*) OVER (PARTITION BY scheme, protocol, seed) AS n FROM recal_rows WHERE role<>'test' WINDOW w AS (PARTITION BY scheme, protocol, seed ORDER BY pit)),
v AS (SELECT scheme, protocol, seed, level, n, pit AS v FROM p, (SELECT unnest({RECAL_LEVELS}::DOUBLE[]) AS level) WHERE rk = greatest(1, ceil(n*level-1e-9)))
SELECT scheme, protocol, seed, level, coalesce(max(CASE WHEN pit<v THEN pit END),0.0::DOUBLE) AS t0, count(*) FILTER (pit<v) AS lt, count(*) FILTER (pit<=v) AS le, max(v.n) AS n, max(v) AS v,
coalesce(max(CASE WHEN pit<v THEN pit END),0.0::DOUBLE)+least(greatest(level*max(v.n)-count(*) FILTER (pit<v),0)/(count(*) FILTER (pit<=v)-count(*) FILTER (pit<v)),1.0::DOUBLE)*(max(v)-coalesce(max(CASE WHEN pit<v THEN pit END),0.0::DOUBLE)) AS recal
FROM v JOIN p USING (scheme, protocol, seed) GROUP BY scheme, protocol, seed, level""",
    "recal_rows",
)


def recalibration_rows(j):
    """Rows of both schemes with mean and spread of a model that has not seen the rows of recalibration.

    ``cal``: fitted on the training rows, recalibrated on the calibration rows. ``train20``: a random fifth of the training
    rows is held out for recalibration and the model is fitted on the rest.
    """
    held = settle_parameters(T.random_holdout(j.where("role='train'"), SPLIT2, "id").where("held").select(*SPLIT2, "id", "held"))
    rest = j.where("role <> 'cal'").join(held, [*SPLIT2, "id"], "left")
    rest = rest.withColumn("role", F.when(F.col("held"), "held").otherwise(F.col("role"))).drop("held")
    both = j.withColumn("scheme", F.lit("cal")).unionByName(rest.withColumn("scheme", F.lit("train20")))
    by = ["scheme", *SPLIT2]
    w = d.scored_wide(both, by, ("train", "cal", "held", "test")).withColumnRenamed("p_ratio", "mean")
    sd = w.where("role='train'").groupBy(*by).agg(F.stddev_samp(F.col("y") - F.col("mean")).alias("sd"))
    return w.where("role <> 'train'").join(settle_parameters(sd), by)


@query(
    "interval_recalibrated__I7",
    sql(f"""WITH e AS (SELECT lo.scheme, lo.protocol, lo.seed, alpha, lo.recal AS level_lo, hi.recal AS level_hi FROM {alpha_rel()} JOIN recal_levels lo ON abs(lo.level-alpha/2)<1e-9 JOIN recal_levels hi
ON abs(hi.level-(1-alpha/2))<1e-9 AND hi.scheme=lo.scheme AND hi.protocol=lo.protocol AND hi.seed=lo.seed)
SELECT scheme, protocol, seed, alpha, {r('level_lo', 7)} AS level_lo, {r('level_hi', 7)} AS level_hi, count(*) AS n, {r('avg((pit BETWEEN level_lo AND level_hi)::INTEGER)', 6)} AS cov, count(*) FILTER (pit<level_lo) AS n_below
FROM recal_rows JOIN e USING (scheme, protocol, seed) WHERE role='test' GROUP BY ALL""", "recal_rows", "recal_levels"),
)
def interval_recalibrated(spark, sf):
    rows = settle(recalibration_rows(d.job(spark, sf)))
    by = ["scheme", *SPLIT2]
    iv = I.recalibrated_intervals(rows.where("role <> 'test'"), rows.where("role='test'"), by, ALPHAS)
    return iv.groupBy(*by, "alpha", rnd("level_lo", 7).alias("level_lo"), rnd("level_hi", 7).alias("level_hi")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double")), 6).alias("cov"),
        F.count_if(F.col("y") < F.col("lower")).alias("n_below"))


@query(
    "interval_native__I8",
    sql(f"SELECT protocol, seed, id, {r(f'p_ratio-{SIG}/2', 10)} AS lower, {r(f'p_ratio+{SIG}/2', 10)} AS upper FROM scored_wide WHERE role='test'", "scored_wide"),
)
def interval_native(spark, sf):
    half = (F.lit(1.0) + F.abs(F.coalesce("x", F.lit(0.0)))) / 2
    w = d.scored_wide(d.job(spark, sf), roles=("test",))
    return w.select(*SPLIT2, "id", rnd(F.col("p_ratio") - half, 10).alias("lower"), rnd(F.col("p_ratio") + half, 10).alias("upper"))


@query(
    "interval_cv_plus__I9",
    sql(f"""WITH c AS (SELECT r.protocol, r.seed, alpha, mu-r AS lo, mu+r AS hi, count(*) OVER (PARTITION BY protocol, seed, alpha) AS n FROM cvp_res r JOIN cvp_mu USING (protocol, seed, fold_id), {alpha_rel()}),
k AS (SELECT *, row_number() OVER (PARTITION BY protocol, seed, alpha ORDER BY lo) AS rl, row_number() OVER (PARTITION BY protocol, seed, alpha ORDER BY hi) AS rh, {rank_sql('n','alpha')} AS kh, floor(alpha*(n+1)+1e-9)::BIGINT AS kl FROM c),
b AS (SELECT protocol, seed, alpha, max(n) AS n_cal, max(kh)>max(n) OR max(kl)<1 AS inf_flag, min(CASE WHEN rl=kl THEN lo END) AS lo, min(CASE WHEN rh=kh THEN hi END) AS hi FROM k GROUP BY ALL)
SELECT protocol, seed, alpha, id, n_cal, inf_flag, {r("CASE WHEN inf_flag THEN '-inf'::DOUBLE ELSE lo END", 10)} AS lower, {r("CASE WHEN inf_flag THEN 'inf'::DOUBLE ELSE hi END", 10)} AS upper
FROM job JOIN b USING (protocol, seed) WHERE role='test'""", "cvp_res", "cvp_mu", "job"),
)
def interval_cv_plus(spark, sf):
    res, test = cv_plus_parts(d.job(spark, sf))
    iv = I.cv_plus(res, test, SPLIT2, ALPHAS)
    return iv.select(*SPLIT2, "alpha", "id", "n_cal", "inf_flag", rnd("lower", 10).alias("lower"), rnd("upper", 10).alias("upper"))


@query(
    "join_residual_fold__J13",
    sql(f"SELECT protocol, seed, id, count(*) AS n, {r('min(mu-r)', 9)} AS lowest, {r('max(mu+r)', 9)} AS highest FROM job JOIN cvp_res USING (protocol, seed) JOIN cvp_mu USING (protocol, seed, fold_id) WHERE role='test' GROUP BY ALL", "job", "cvp_res", "cvp_mu"),
)
def join_residual_fold(spark, sf):
    """Every test row meets every residual of its split through the prediction of the residual's fold model.

    mu takes K values per row and the extremes of mu[k] -/+ r over a fold need only the largest residual of the fold.
    """
    res, test = cv_plus_parts(d.job(spark, sf))
    per = res.groupBy(*SPLIT2, "fold").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n"))
    per = settle_parameters(per.groupBy(*SPLIT2).agg(F.sum("n").alias("n"), F.collect_list(F.struct("fold", "r")).alias("top")))  # K entries
    o = test.join(per, SPLIT2)
    low = F.array_min(F.transform("top", lambda e: F.get("mu", e["fold"]) - e["r"]))
    high = F.array_max(F.transform("top", lambda e: F.get("mu", e["fold"]) + e["r"]))
    return o.select(*SPLIT2, "id", "n", rnd(low, 9).alias("lowest"), rnd(high, 9).alias("highest"))


@query(
    "cv_plus_bound__I10",
    f"SELECT k, n, {r('1.0-0.2-least(2.0*(1.0-1.0/10.0)/(n/10.0+1.0),(1.0-10.0/n)/11.0)', 9)} AS bound FROM (SELECT c_nationkey AS k, count(*)::DOUBLE AS n FROM customer GROUP BY 1)",
)
def cv_plus_bound(spark, sf):
    from cohera.plans.base import table

    g = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return g.withColumn("bound", rnd(I.cv_plus_bound(F.col("n"), F.lit(10.0), F.lit(0.1)), 9))


def budget_scores(j):
    w = d.scored_wide(j, roles=("cal",)).withColumn("s", F.abs(F.col("y") - F.col("p_const")))
    return w.select(*SPLIT2, "grp", "id", "s")


@query(
    "budget_group__I11",
    sql(f"""WITH s AS (SELECT protocol, seed, grp, id, abs(y-p_const) AS s FROM scored_wide WHERE role='cal'), p AS (SELECT * FROM draws JOIN s USING (protocol, seed, grp)),
a AS (SELECT protocol, seed, n_target, draw, 'pool' AS scheme, s FROM p UNION ALL SELECT protocol, seed, n_target, draw, 'gsub', s FROM
(SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY protocol, seed, n_target, draw, grp ORDER BY {h("'gsub'", 'protocol', 'seed', 'n_target', 'draw', 'id')})=1)),
k AS (SELECT *, row_number() OVER (PARTITION BY protocol, seed, n_target, draw, scheme ORDER BY s) AS rk, count(*) OVER (PARTITION BY protocol, seed, n_target, draw, scheme) AS n FROM a)
SELECT protocol, seed, n_target, draw, scheme, max(n) AS n_cal, {r(f"coalesce(min(CASE WHEN rk={rank_sql('n', '0.1::DOUBLE')} THEN s END),'inf'::DOUBLE)", 9)} AS qhat FROM k GROUP BY ALL""",
        "scored_wide", "draws"),
)
def budget_group(spark, sf):
    j = d.job(spark, sf)
    q = budget_quantiles(j, (0.1,))
    return q.select(*SPLIT2, "n_target", "draw", "scheme", "n_cal", rnd("qhat", 9).alias("qhat"))


def budget_quantiles(j, alphas):
    chosen = draws(j)
    p = budget_scores(j).join(chosen, [*SPLIT2, "grp"])
    keys = [*SPLIT2, "n_target", "draw"]
    one = T.sample_one_per_group(p, keys, "grp", "id", ["s"])
    a = p.select(*keys, F.lit("pool").alias("scheme"), "s").unionByName(one.select(*keys, F.lit("gsub").alias("scheme"), "s"))
    return I.conformal_quantile(a, [*keys, "scheme"], "s", alphas)


KGRID = [0, 1, 2, 5, 10, 20]
part(
    "local_scores",
    f"""SELECT g.protocol, g.seed, g.grp, k, variant, s FROM
(SELECT protocol, seed, grp, ts, id, abs(y-p_const) AS s, row_number() OVER (PARTITION BY protocol, seed, grp ORDER BY ts, id) AS rk FROM scored_wide WHERE role='test') g,
(SELECT unnest({KGRID})::INTEGER AS k), (SELECT unnest(['augment','local','hybrid']) AS variant) WHERE rk<=k
UNION ALL SELECT t.protocol, t.seed, t.grp, k, variant, s FROM (SELECT DISTINCT protocol, seed, grp FROM scored_wide WHERE role='test') t JOIN (SELECT protocol, seed, abs(y-p_const) AS s FROM gsub_wide) g ON g.protocol=t.protocol AND g.seed=t.seed,
(SELECT unnest({KGRID})::INTEGER AS k), (SELECT unnest(['global','augment','hybrid']) AS variant) WHERE NOT (variant='hybrid' AND k>=9)""",
    "scored_wide", "gsub_wide",
)
part(
    "local_q",
    f"""SELECT protocol, seed, grp, k, variant, max(n) AS n_cal, coalesce(min(CASE WHEN rk={rank_sql('n', '0.1::DOUBLE')} THEN s END),'inf'::DOUBLE) AS qhat
FROM (SELECT *, row_number() OVER (PARTITION BY protocol, seed, grp, k, variant ORDER BY s) AS rk, count(*) OVER (PARTITION BY protocol, seed, grp, k, variant) AS n FROM local_scores) GROUP BY ALL""",
    "local_scores",
)
part(
    "local_budget",
    """WITH t AS (SELECT protocol, seed, grp, y, p_const, row_number() OVER (PARTITION BY protocol, seed, grp ORDER BY ts, id) AS rk, count(*) OVER (PARTITION BY protocol, seed, grp) AS n FROM scored_wide WHERE role='test'),
e AS (SELECT t.*, k, eval_set FROM t, (SELECT unnest([0,1,2,5,10,20])::INTEGER AS k), (SELECT unnest(['common','per_k']) AS eval_set) WHERE rk > CASE WHEN eval_set='common' THEN 20 ELSE k END AND n >= CASE WHEN eval_set='common' THEN 25 ELSE k+5 END),
v AS (SELECT DISTINCT protocol, seed, grp, k, eval_set, unnest(['global','augment','local','hybrid']) AS variant FROM e)
SELECT e.protocol, e.seed, e.eval_set, e.grp, e.k, v.variant, coalesce(q.n_cal,0) AS n_cal, count(*) AS n_eval, avg((abs(y-p_const)<=coalesce(qhat,'inf'::DOUBLE) OR qhat IS NULL OR isinf(qhat))::INTEGER::DOUBLE) AS coverage,
isinf(coalesce(max(qhat),'inf'::DOUBLE)) AS inf_flag
FROM e JOIN v USING (protocol, seed, grp, k, eval_set) LEFT JOIN local_q q ON q.protocol=e.protocol AND q.seed=e.seed AND q.grp=e.grp AND q.k=e.k AND q.variant=v.variant GROUP BY ALL""",
    "scored_wide", "local_q",
)


def local_budget(j, alpha=0.1):
    from cohera.operators.budget import local_budget as run

    w = d.scored_wide(j).withColumn("s", F.abs(F.col("y") - F.col("p_const")))
    cal, test = w.where("role='cal'"), w.where("role='test'")
    one = T.sample_one_per_group(cal, SPLIT2, "grp", "id", ["s"])
    return run(one.select(*SPLIT2, "s"), test.select(*SPLIT2, "grp", "id", "ts", "s"), SPLIT2, "grp", "id", "ts", KGRID, alpha)


@query(
    "budget_local__I12",
    sql(f"SELECT protocol, seed, eval_set, grp, k, variant, n_cal, n_eval, {r('coverage', 9)} AS coverage, inf_flag FROM local_budget", "local_budget"),
)
def budget_local(spark, sf):
    return rounded(local_budget(d.job(spark, sf)), "coverage", digits=9)


@query(
    "calibration_record__I13",
    sql("SELECT protocol, seed, 'pooled_cal_rows' AS calib_scheme, count(*) AS k_cal_rows, count(DISTINCT grp) AS k_cal_units, NULL::INTEGER AS cv_folds FROM scored_wide WHERE role='cal' GROUP BY ALL "
        "UNION ALL SELECT protocol, seed, 'one_row_per_cal_group', count(*), count(DISTINCT grp), NULL FROM gsub_wide GROUP BY ALL", "scored_wide", "gsub_wide"),
)
def calibration_record(spark, sf):
    cal = d.job(spark, sf).where("role='cal'")
    one = T.sample_one_per_group(cal, SPLIT2, "grp", "id", ["id"])
    return I.calibration_record("pooled_cal_rows", cal, SPLIT2, "grp").unionByName(I.calibration_record("one_row_per_cal_group", one, SPLIT2, "grp"))


@query(
    "shared_row_set__I14",
    sql("SELECT protocol, seed, model, method, alpha, count(*) AS n, sum(id)::BIGINT AS ids FROM ivals GROUP BY ALL", "ivals"),
)
def shared_row_set(spark, sf):
    iv = d.scp_intervals(d.scored_wide(d.job(spark, sf)))
    return iv.groupBy(*d.CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
