"""Models against closed forms and brute force; fits must not see test labels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohera.operators import models as M


def frame(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"s": np.repeat([0, 1], n // 2), "g": rng.integers(0, 20, n), "a": rng.normal(3, 2, n), "b": rng.normal(0, 1, n)})
    pdf["y"] = 1 + 2 * pdf.a - 0.5 * pdf.b + rng.normal(0, 0.3, n)
    pdf["fold"] = pdf.g % 5
    return pdf, spark.createDataFrame(pdf)


def test_least_squares_from_group_sums(spark):
    pdf, df = frame(spark)
    mom = M.add_moments(M.moments(df, ["s", "g"], [F.col("a"), F.col("b")]), ["s"], 2)
    for r in M.solve_ols(mom, ["s"]).collect():
        p = pdf[pdf.s == r.s]
        want = np.linalg.lstsq(np.c_[np.ones(len(p)), p.a, p.b], p.y, rcond=None)[0]
        assert np.allclose(r.coef, want, atol=1e-8)


def test_ridge_matches_direct_cross_validation(spark):
    pdf, df = frame(spark)
    mom = M.add_moments(M.moments(df, ["s", "g", "fold"], [F.col("a"), F.col("b")]), ["s", "fold"], 2)

    def fit(p, lam):
        X = p[["a", "b"]].to_numpy()
        mu, sd = X.mean(0), X.std(0)
        Z = (X - mu) / sd
        beta = np.linalg.solve(Z.T @ Z + lam * np.eye(2), Z.T @ (p.y - p.y.mean()).to_numpy()) / sd
        return np.r_[p.y.mean() - beta @ mu, beta]

    for r in M.fit_ridge(mom, ["s"], 2).collect():
        p = pdf[pdf.s == r.s]
        best = None
        for lam in M.RIDGE_GRID:
            sse = 0.0
            for k in range(5):
                w = fit(p[p.fold != k], lam)
                v = p[p.fold == k]
                sse += ((w[0] + v[["a", "b"]].to_numpy() @ w[1:] - v.y) ** 2).sum()
            if best is None or sse < best[0] - 1e-9:
                best = (sse, lam)
        assert r.penalty == pytest.approx(best[1])
        assert np.allclose(r.coef, fit(p, r.penalty), atol=1e-7)


def test_fits_ignore_test_labels(spark):
    _, df = frame(spark)
    df = df.withColumn("role", F.when(F.col("g") < 4, "test").otherwise("train"))
    changed = df.withColumn("y", F.when(F.col("role") == "test", 99.0).otherwise(F.col("y")))
    fits = [M.fit_median(d.where("role='train'"), ["s"]).orderBy("s").collect() for d in (df, changed)]
    assert fits[0] == fits[1]


def test_saturating_form_recovers_parameters(spark):
    rng = np.random.default_rng(2)
    r = rng.uniform(0.01, 0.2, 500)
    y = np.log10(300 * r / (1 - r / 0.5)) + rng.normal(0, 0.001, 500)
    df = spark.createDataFrame(pd.DataFrame({"s": 0, "r": r, "y": y}))
    got = M.fit_saturating(df, ["s"], "r").first()
    assert got.c == pytest.approx(0.5, rel=0.03) and 10**got.log_a == pytest.approx(300, rel=0.01)


def test_saturating_form_of_repeated_inputs(spark):
    """Rows of one input are one row of the search, with the same best grid point as over all rows."""
    rng = np.random.default_rng(6)
    r = rng.integers(1, 30, 2_000) / 100
    y = np.log10(40 * r / (1 - r / 0.6)) + rng.normal(0, 0.2, len(r))
    df = spark.createDataFrame(pd.DataFrame({"s": 0, "r": r, "y": y}))
    at = M.moments_at(df, ["s", "r"], "y").toPandas()
    assert len(at) == 29 and at._n.sum() == 2_000
    got = M.fit_saturating(df, ["s"], "r").first()
    lo, hi = 1.01 * r.max(), 1.01e4 * r.max()
    for _ in range(3):
        c = lo * (hi / lo) ** (np.arange(41) / 40)
        e = y - np.log10(r / np.maximum(1 - r / c[:, None], 1e-6))
        best = int(np.argmin(e.var(axis=1)))
        step = (hi / lo) ** (1 / 40)
        lo, hi = max(lo, c[best] / step), min(hi, c[best] * step)
    assert got.c == pytest.approx(c[best], rel=1e-9) and got.log_a == pytest.approx(e[best].mean(), rel=1e-9)


def test_fallback_for_invalid_input(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (None, True)], "p double, ok boolean")
    got = [x.v for x in df.select(M.with_fallback(F.col("p"), F.col("ok"), F.lit(9.0)).alias("v")).collect()]
    assert got == [1.0, 9.0, 9.0]


def test_mixture_quantile_inverts_the_mixture(spark):
    from math import erf, sqrt

    w, m, s = [0.3, 0.7], [-1.0, 2.0], [0.5, 1.0]
    df = spark.createDataFrame([(w, m, s)], "w array<double>, m array<double>, s array<double>")
    for p in (0.05, 0.5, 0.95):
        q = df.select(M.mixture_quantile(F.col("w"), F.col("m"), F.col("s"), p).alias("q")).first().q
        cdf = sum(a * 0.5 * (1 + erf((q - b) / c / sqrt(2))) for a, b, c in zip(w, m, s))
        assert cdf == pytest.approx(p, abs=1e-6)


def test_mixture_summary(spark):
    df = spark.createDataFrame([([0.25, 0.75, 0.6, 0.4], [1.0, 2.0, 3.0, 4.0], [0.1, 0.2, 0.3, 0.4])], "w array<double>, m array<double>, s array<double>")
    r = df.select(M.mixture_summary(F.col("w"), F.col("m"), F.col("s"), 2).alias("r")).first().r
    w = np.array([0.25, 0.75, 0.6, 0.4]) / 2
    m, s = np.arange(1.0, 5.0), np.array([0.1, 0.2, 0.3, 0.4])
    mean = (w * m).sum()
    assert r.mix_mean == pytest.approx(mean) and r.mix_sd == pytest.approx(np.sqrt((w * (s**2 + m**2)).sum() - mean**2))
    assert r.point == pytest.approx(2.5)


def test_default_models_are_registered_and_score_every_row(spark):
    from cohera.operators import factories as X

    rng = np.random.default_rng(2)
    rows = [(s, int(g), i, None if i % 11 == 0 else float(rng.normal()), float(rng.uniform(0.1, 3))) for s in (0, 1) for i, g in enumerate(rng.integers(0, 12, 120))]
    df = spark.createDataFrame(rows, "s int, g int, id int, x double, z double").withColumn("y", F.coalesce(F.col("x"), F.lit(0.0)) * 0.8 + F.col("z") * 0.1)
    inputs = X.Inputs(["s"], "g", lambda: [F.col("z")], "x", lambda: F.col("x") / 10, lambda: F.col("z") / 10, ["z"], trees=2, depth=2)
    made = X.factories(inputs)
    assert {n for names in M.DEFAULT_MODELS.values() for n in names} == set(made)
    train, score = df.where("id >= 20"), df.where("id < 20").drop("y")
    out = X.default_registry(inputs).run(M.DEFAULT_MODELS["pigment"], train, score).toPandas()
    assert len(out) == 5 * 40 and out["pred"].notna().all() and set(out["model"]) == set(M.DEFAULT_MODELS["pigment"])
    med = train.toPandas().groupby("s")["y"].median()
    for r in out[(out.model == "const") | ((out.model == "emp_oc") & out.x.isna())].itertuples():
        assert r.pred == pytest.approx(med[r.s])
    nechad = X.default_registry(inputs).run(["emp_nechad"], train, score)
    assert nechad.where("pred IS NULL").count() == 0 and nechad.count() == 40
