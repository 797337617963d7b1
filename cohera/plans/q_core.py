"""First slice: grouped split, training median, one score per group, conformal quantile, interval metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohera.operators import evaluate as ev
from cohera.plans import data as d
from cohera.plans.base import query, rnd, rounded, sql
from cohera.plans.data import r

METRICS = [
    "cov_group", "cov_pooled", "cov_worst", "width_group", "width_group_log10", "score_group", "score_pooled",
    "inf_rate", "width_pooled_median",
]


@query(
    "metric_interval__E3",
    sql(
        "SELECT protocol, seed, model, method, alpha, " + ", ".join(f"{r(m)} AS {m}" for m in METRICS)
        + ", n_big_groups, n_groups, n_rows FROM imetrics",
        "imetrics",
    ),
)
def metric_interval(spark, sf):
    iv = d.scp_intervals(d.scored_wide(d.job(spark, sf)))
    m = ev.interval_metrics(iv, d.CELL, "grp")
    return m.select(*d.CELL, *[rnd(c).alias(c) for c in METRICS], "n_big_groups", "n_groups", "n_rows")


@query(
    "split_group_shuffle__T1",
    sql("SELECT protocol, seed, id, role FROM job WHERE protocol='group'", "job"),
)
def split_group_shuffle(spark, sf):
    return d.job(spark, sf, protocols=("group",), keep=False).select("protocol", "seed", "id", "role")


@query(
    "model_training_median__M1",
    sql(f"SELECT protocol, seed, {r('med',10)} AS pred FROM fits", "fits"),
)
def model_training_median(spark, sf):
    return d.fits(d.job(spark, sf)).select(*d.SPLIT2, rnd("med", 10).alias("pred"))


@query(
    "sample_one_per_group__W1",
    sql("SELECT protocol, seed, grp, id FROM gsub_wide", "gsub_wide"),
)
def sample_one(spark, sf):
    cal = d.job(spark, sf).where(F.col("role") == "cal")
    from cohera.operators.splits import sample_one_per_group

    return sample_one_per_group(cal, d.SPLIT2, "grp", "id", ["id"])


@query(
    "order_statistic__W3",
    sql(f"SELECT protocol, seed, model, method, alpha, n_cal, {r('qhat',10)} AS qhat, inf_flag FROM scp_qhat", "scp_qhat"),
)
def order_statistic(spark, sf):
    return rounded(d.scp_qhat(d.scored_wide(d.job(spark, sf))), "qhat", digits=10)


def _interval_query(method: str):
    def run(spark, sf):
        iv = d.scp_intervals(d.scored_wide(d.job(spark, sf))).where(F.col("method") == method)
        return iv.select("protocol", "seed", "model", "alpha", "id", rnd("lower", 10).alias("lower"), rnd("upper", 10).alias("upper"))

    return run


for _method, _name in (("scp_pool", "interval_split_pooled__I2"), ("scp_gsub", "interval_split_gsub__I3")):
    query(
        _name,
        sql(
            f"SELECT protocol, seed, model, alpha, id, {r('lower',10)} AS lower, {r('upper',10)} AS upper FROM ivals "
            f"WHERE method='{_method}'",
            "ivals",
        ),
    )(_interval_query(_method))


@query(
    "coverage_per_group__E4",
    sql(
        f"SELECT protocol, seed, model, method, alpha, grp, {r('avg(hit)')} AS coverage, count(*) AS n FROM ivrows "
        "GROUP BY ALL",
        "ivrows",
    ),
)
def coverage_per_group(spark, sf):
    iv = d.scp_intervals(d.scored_wide(d.job(spark, sf)))
    return rounded(ev.group_coverage(iv, d.CELL, "grp"), "coverage")
