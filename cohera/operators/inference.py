"""Corrected tests over repeats. Inputs are per-split summary rows (a few dozen per cell)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohera.functions.numeric import INF, is_infinite
from cohera.functions.special import nct_sf_udf, t_cdf_udf, t_quantile_udf


def resampled_stats(rows: DataFrame, keys: list[str], value: str, n_test: str, n_train: str, mu0) -> DataFrame:
    """Corrected resampled t statistic per key: variance (1/J + n_test/n_train) s^2, df = J - 1.

    Any non-finite value or J < 2 makes the cell not evaluable (statistic null).
    """
    m = mu0 if isinstance(mu0, Column) else F.lit(float(mu0))
    bad = F.col(value).isNull() | is_infinite(F.col(value)) | F.isnan(value)
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("J"),
        F.count_if(bad).alias("n_bad"),
        F.avg(F.when(~bad, F.col(value))).alias("mean"),
        F.var_samp(F.when(~bad, F.col(value))).alias("s2"),
        F.avg(n_test).alias("n_test_mean"),
        F.avg(n_train).alias("n_train_mean"),
    )
    ok = (F.col("J") >= 2) & (F.col("n_bad") == 0)
    se = F.sqrt((F.lit(1.0) / F.col("J") + F.col("n_test_mean") / F.col("n_train_mean")) * F.col("s2"))
    flat = F.when(F.col("mean") > m, F.lit(INF)).when(F.col("mean") < m, F.lit(-INF)).otherwise(F.lit(0.0))
    g = g.withColumn("se", F.when(ok, se)).withColumn("null_value", m)
    return g.withColumn("t", F.when(ok, F.when(F.col("se") > 0, (F.col("mean") - m) / F.col("se")).otherwise(flat)))


def add_p_value(df: DataFrame, t: str, dof: Column, alternative: Column, estimate: str, se: str, level: float = 0.95):
    """p value (1 when not evaluable) and two-sided interval. ``alternative``: greater, less or two-sided."""
    d = df.withColumn("_df", dof.cast("double")).withColumn("_c", t_cdf_udf(F.col(t), F.col("_df")))
    up = F.lit(1.0) - F.col("_c")
    p = (
        F.when(alternative == "greater", t_cdf_udf(-F.col(t), F.col("_df")))
        .when(alternative == "less", F.col("_c"))
        .otherwise(2 * F.least(F.col("_c"), up))
    )
    half = t_quantile_udf(F.lit(0.5 + level / 2), F.col("_df")) * F.col(se)
    d = d.withColumn("p_raw", F.coalesce(p, F.lit(1.0))).withColumn("_half", half)
    return d.withColumn("ci_lo", F.col(estimate) - F.col("_half")).withColumn(
        "ci_hi", F.col(estimate) + F.col("_half")
    ).drop("_c", "_half", "_df")


def difference_stats(a: DataFrame, b: DataFrame, keys: list[str], delta: float) -> DataFrame:
    """Unpaired corrected difference of two arms of :func:`resampled_stats`; df = min(J) - 1."""
    cols = ["J", "n_bad", "mean", "s2", "n_test_mean", "n_train_mean"]
    x = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in cols])
    y = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in cols])
    j = x.join(y, keys)

    def var(s: str) -> Column:
        return (F.lit(1.0) / F.col(f"J_{s}") + F.col(f"n_test_mean_{s}") / F.col(f"n_train_mean_{s}")) * F.col(f"s2_{s}")

    ok = (F.least("J_a", "J_b") >= 2) & (F.col("n_bad_a") + F.col("n_bad_b") == 0)
    j = j.withColumn("diff", F.col("mean_a") - F.col("mean_b")).withColumn("se", F.when(ok, F.sqrt(var("a") + var("b"))))
    return j.withColumn("t", (F.col("diff") - F.lit(float(delta))) / F.col("se")).withColumn(
        "df", F.least("J_a", "J_b") - 1
    )


def holm(tests: DataFrame, family: list[str], p: str, tie: str, name: str = "p_holm") -> DataFrame:
    """Step-down adjustment within a family of tests (a short list by nature)."""
    fam = Window.partitionBy(*family)
    order = fam.orderBy(F.col(p).asc(), F.col(tie).asc())
    r = F.row_number().over(order) - 1
    d = tests.withColumn("_s", (F.count(F.lit(1)).over(fam) - r) * F.col(p))
    running = F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.withColumn(name, F.least(F.lit(1.0), running)).drop("_s")


def power_ledger(cells: DataFrame, null_value: float, truths: tuple[float, ...] = (0.9, 0.92), level: float = 0.05):
    """Naive and corrected spread, inflation, effective repeats, rejection threshold and power per cell.

    ``cells``: output of :func:`resampled_stats`. Power under the corrected spread is a non-central t tail, under the
    naive spread a normal tail; the two variance models are never mixed.
    """
    from cohera.functions.numeric import normal_cdf

    d = cells.withColumn("se_naive", F.sqrt(F.col("s2") / F.col("J"))).withColumn(
        "inflation", F.col("se") / F.col("se_naive")
    )
    d = d.withColumn(
        "effective_repeats", F.lit(1.0) / (F.lit(1.0) / F.col("J") + F.col("n_test_mean") / F.col("n_train_mean"))
    )
    dof = (F.col("J") - 1).cast("double")
    d = d.withColumn("t_crit", t_quantile_udf(F.lit(1 - level), dof))
    d = d.withColumn("threshold", F.lit(null_value) + F.col("t_crit") * F.col("se"))
    d = d.withColumn("naive_t", (F.col("mean") - F.lit(null_value)) / F.col("se_naive"))
    d = d.withColumn("naive_p", t_cdf_udf(-F.col("naive_t"), dof))
    for mu in truths:
        tag = f"{round(mu * 100)}"
        d = d.withColumn(
            f"power_{tag}_corrected", nct_sf_udf(F.col("t_crit"), dof, (F.lit(mu) - F.lit(null_value)) / F.col("se"))
        ).withColumn(
            f"power_{tag}_naive", F.lit(1.0) - normal_cdf((F.col("threshold") - F.lit(mu)) / F.col("se_naive"))
        )
    return d


def planned_arms(found: DataFrame, targets: DataFrame, arms: list[tuple[str, str]]) -> DataFrame:
    """Every planned (hypothesis, arm) of every target with its test; a missing or short cell has p = 1.

    ``found``: hypothesis, target, arm, p_raw, ... with one row a cell; a cell that comes twice stops the job. ``complete``
    tells whether the test could be made.
    """
    plan = F.explode(F.array(*[F.struct(F.lit(h).alias("hypothesis"), F.lit(a).alias("arm")) for h, a in arms]))
    cells = targets.select("target").distinct().select("target", plan.alias("p")).select("target", "p.*")
    keys = ["hypothesis", "target", "arm"]
    twice = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a cell of the family came twice")).cast("boolean")).otherwise(False)
    once = found.groupBy(*keys).agg(twice.alias("_twice"), *[F.first(c).alias(c) for c in found.columns if c not in keys])
    out = cells.join(once, keys, "left").where(~F.coalesce("_twice", F.lit(False))).drop("_twice")
    complete = F.coalesce(F.col("p_raw").isNotNull() & ~F.isnan("p_raw"), F.lit(False))
    return out.withColumns({"complete": complete, "p_raw": F.when(complete, F.col("p_raw")).otherwise(1.0)})


def test_family(hypotheses: DataFrame, level: float = 0.05) -> DataFrame:
    """Holm over all rows and the decision. ``hypotheses``: hypothesis, target, estimate, p_raw, ..."""
    h = hypotheses.withColumn("_fam", F.lit(1)).withColumn("_key", F.concat_ws("|", "hypothesis", "target"))
    out = holm(h, ["_fam"], "p_raw", "_key")
    return out.withColumn(
        "decision", F.when(F.col("p_holm") <= level, "supported").otherwise("not_supported")
    ).drop("_fam", "_key")
