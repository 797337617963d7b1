"""Fits on all folds but one against numpy on the filtered rows; order statistics of complements without copies."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohera.operators import crossfit as C, models as M

RNG = np.random.default_rng(21)


def frame(n=400, splits=2, k=4):
    parts = []
    for s in range(splits):
        g = RNG.integers(0, 40, n)
        x = RNG.normal(0, 1, n)
        parts.append(pd.DataFrame({"s": s, "id": np.arange(n), "g": g, "fold": g % k, "x": x, "z": RNG.normal(2, 3, n), "y": 1.5 * x + RNG.normal(0, 0.5, n) + s}))
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("p", [0.5, 0.1, 0.97])
@pytest.mark.parametrize("kind", ["smooth", "ties", "tiny", "an empty fold"])
def test_complement_quantiles(spark, p, kind):
    df, k = frame(), 4
    if kind == "ties":
        df["y"] = np.round(df["y"])
    if kind == "tiny":
        df = df.groupby(["s", "fold"]).head(2)
    if kind == "an empty fold":
        df, k = df[df.fold != 1], 5
    got = {(r.s, r.fold): r.pred for r in C.complement_quantile(spark.createDataFrame(df).repartition(3), ["s"], "fold", "y", k, p).collect()}
    want = {(s, f): np.quantile(d.y[d.fold != f], p) for s, d in df.groupby("s") for f in range(k)}
    assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key], abs=1e-12) for key in want)


def test_no_row_is_copied_for_a_fold(spark):
    df = spark.createDataFrame(frame())
    plan = C.complement_quantile(df, ["s"], "fold", "y", 4)._jdf.queryExecution().toString()
    assert "Generate" not in plan.replace("Generate inline", "") and plan.count("explode") == 0


@pytest.mark.parametrize("name", ["constant", "linear", "ridge"])
def test_fold_models(spark, name):
    df, k = frame(), 4
    df.loc[::9, "x"] = np.nan
    rows = spark.createDataFrame(df).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    basis, valid = [F.col("x"), F.col("z")], F.col("x").isNotNull()
    model = {"constant": C.constant(), "linear": C.linear(basis, valid, "g"), "ridge": C.ridge(basis, valid, "g", grid=(1e-9,))}[name]
    rows = rows.withColumnRenamed("fold", "own").withColumn("fold", F.lit(0))  # a column of that name may be about something else
    params = C.cross_fit(model, rows, ["s"], "own", k)
    oof = {(r.s, r.id): r.pred_oof for r in C.out_of_fold(model, params, rows, ["s"], "own").collect()}
    mu = {(r.s, r.id): r.mu for r in C.fold_predictions(model, params, rows, ["s"], "own").collect()}
    assert len(oof) == len(mu) == len(df)
    for s, d in df.groupby("s"):
        for f in range(k):
            t = d[d.fold != f]
            ok = t.x.notna()
            design = lambda q: np.c_[np.ones(len(q)), q.x, q.z]
            beta = np.linalg.lstsq(design(t[ok]), t.y[ok], rcond=None)[0]
            pred = np.where(d.x.notna() & (name != "constant"), design(d.fillna(0.0)) @ beta, t.y.median())
            for i, fold, v in zip(d.id, d.fold, pred):
                assert mu[s, i][f] == pytest.approx(v, abs=1e-6)
                if fold == f:
                    assert oof[s, i] == pytest.approx(v, abs=1e-6)


def test_ridge_chooses_its_penalty_on_its_own_folds(spark):
    df, k = frame(120, 1), 4
    basis = [F.col("x"), F.col("z")]
    model = C.ridge(basis, F.lit(True), "g", grid=(1e-3, 10.0, 1e3))
    got = {r.fold: list(r.par.coef) for r in C.cross_fit(model, spark.createDataFrame(df), ["s"], "fold", k).collect()}
    for f in range(k):
        t = spark.createDataFrame(df[df.fold != f])
        mom = M.add_moments(M.moments(t, ["s", "fold", "g"], basis), ["s", "fold"], 2)
        assert got[f] == pytest.approx(list(M.fit_ridge(mom, ["s"], 2, (1e-3, 10.0, 1e3)).first().coef), rel=1e-9)


def test_any_model_by_fold(spark):
    df, k = frame(90, 1, 3), 3
    rows = spark.createDataFrame(df)

    def boosted(train, score):
        return M.fit_boosted(train, ["x", "z"], "y", seed=1, trees=3, depth=2).transform(score).drop("features")

    test = rows.where("id < 5").select("s", "id", "x", "z")
    oof, mu = C.cross_fit_any(boosted, rows, test, ["s"], "fold", k, "id")
    assert oof.count() == 90 and {len(r.mu) for r in mu.collect()} == {3} and mu.count() == 5
    fold = int(df.fold[0])
    moved = rows.withColumn("y", F.col("y") + F.when(F.col("fold") == fold, 100.0).otherwise(0.0))
    oof2, mu2 = C.cross_fit_any(boosted, moved, test, ["s"], "fold", k, "id")
    a, b = ({r.id: r.pred_oof for r in o.where(F.col("fold") == fold).collect()} for o in (oof, oof2))
    assert a == pytest.approx(b)  # a fold's own values have no part in its predictions
    a, b = ({r.id: r.mu for r in m.collect()} for m in (mu, mu2))
    assert all(a[i][fold] == pytest.approx(b[i][fold]) and a[i][fold - 1] != pytest.approx(b[i][fold - 1]) for i in a)
