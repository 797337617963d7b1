"""Known answers and coverage properties of the intervals and metrics."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohera.functions import numeric as N
from cohera.operators import evaluate as E, intervals as I, splits as T


def scalar(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_rank_known_answers(spark):
    assert scalar(spark, N.conformal_rank(F.lit(9), 0.1)) == 9
    assert scalar(spark, N.conformal_rank(F.lit(8), 0.1)) == 9


@pytest.mark.parametrize("scores,alpha,q", [([float(i) for i in range(9)], 0.1, 8.0), ([float(i) for i in range(8)], 0.1, math.inf), ([1.0] * 5 + [2.0] * 5, 0.5, 2.0)])
def test_quantile_known_answers(spark, scores, alpha, q):
    df = spark.createDataFrame([(0, s) for s in scores], "k int, s double")
    r = I.conformal_quantile(df, ["k"], "s", (alpha,)).first()
    assert r.qhat == q and r.inf_flag == math.isinf(q) and r.n_cal == len(scores)


def test_cv_plus_bound_known_answers(spark):
    for n, want in ((205, 0.716), (264, 0.734)):
        got = scalar(spark, I.cv_plus_bound(F.lit(float(n)), F.lit(10.0), F.lit(0.1)))
        assert round(got, 3) == want


def test_point_metrics_factor_two(spark):
    for sign, bias in ((1, 100.0), (-1, -100.0)):
        rows = [(0, float(y), y + sign * math.log10(2)) for y in (0, 1, 2)]
        m = E.point_metrics(spark.createDataFrame(rows, "k int, y double, pred double"), ["k"]).first()
        assert m.mdsa == pytest.approx(100) and m.sspb == pytest.approx(bias) and m.logmae == pytest.approx(math.log10(2))


def test_interval_metrics_by_hand(spark):
    rows = [(0, "a", 0.0, -1.0, 1.0), (0, "a", 0.0, 0.5, 1.0), (0, "a", 0.0, -1.0, 1.0), (0, "b", 1.0, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "k int, g string, y double, lower double, upper double").withColumn("alpha", F.lit(0.2))
    m = E.interval_metrics(df, ["k"], "g").first()
    assert m.cov_pooled == 0.75 and m.cov_group == pytest.approx(5 / 6)
    assert m.width_group == pytest.approx(100) and m.n_big_groups == 0 and m.cov_worst is None
    score = E.interval_rows(df).where("lower = 0.5").first().score
    assert score == pytest.approx(5.5)


def test_infinite_interval_covers_with_infinite_width(spark):
    df = spark.createDataFrame([(0, "a", 5.0, -math.inf, math.inf, 0.1)], "k int, g string, y double, lower double, upper double, alpha double")
    m = E.interval_metrics(df, ["k"], "g").first()
    assert m.cov_group == 1.0 and math.isinf(m.width_group) and math.isinf(m.score_group) and m.inf_rate == 1.0


def test_beta_law(spark):
    df = spark.createDataFrame([(51, 0.1), (8, 0.1)], "n int, alpha double")
    law = E.beta_law(F.col("n"), F.col("alpha"))
    r = {x.n: x for x in E.beta_quantiles(df, "n", "alpha").select("n", "beta_q_lo", "beta_q_hi", *[c.alias(k) for k, c in law.items()]).collect()}
    assert r[51].beta_k == 47 and r[51].beta_mean == pytest.approx(47 / 52) and not r[51].beta_infinite
    assert r[8].beta_infinite and r[8].beta_mean == 1.0 and r[8].beta_q_lo == 1.0
    draws = np.random.default_rng(0).beta(47, 5, 400_000)
    assert r[51].beta_q_lo == pytest.approx(np.quantile(draws, 0.025), abs=2e-3)
    assert r[51].beta_q_hi == pytest.approx(np.quantile(draws, 0.975), abs=2e-3)


def test_cv_plus_against_numpy(spark):
    rng = np.random.default_rng(3)
    n, k, m, alpha = 40, 4, 25, 0.1
    fold, res, mu = np.arange(n) % k, rng.exponential(1, n), rng.normal(0, 1, (k, m))
    r = spark.createDataFrame(pd.DataFrame({"s": 0, "fold": fold, "r": res}))
    t = spark.createDataFrame([(0, j, mu[:, j].tolist()) for j in range(m)], "s long, j int, mu array<double>")
    got = I.cv_plus(r, t, ["s"], (alpha,)).orderBy("j").toPandas()
    hi, lo = math.ceil((1 - alpha) * (n + 1) - 1e-9), math.floor(alpha * (n + 1) + 1e-9)
    low, high = np.sort(mu[fold] - res[:, None], axis=0)[lo - 1], np.sort(mu[fold] + res[:, None], axis=0)[hi - 1]
    assert np.allclose(got.lower, low) and np.allclose(got.upper, high)
    few = r.limit(5)
    assert I.cv_plus(few, t, ["s"], (alpha,)).where("not inf_flag").count() == 0


@pytest.mark.parametrize("cell", [1, 3, 1000])
def test_cv_plus_over_small_cells(spark, cell):
    """Ties, folds of very different spread and size, an empty fold, rows with equal predictions, two splits."""
    from cohera.operators import cvplus

    rng = np.random.default_rng(4)
    frames, mus = [], []
    for s, n in ((0, 300), (1, 57)):
        fold = rng.choice([0, 1, 2, 4], n, p=[0.5, 0.2, 0.2, 0.1])
        res = np.round(rng.exponential(1, n) * np.array([0.1, 1, 10, 3, 1])[fold], 1)
        mu = np.round(rng.normal(0, 2, (40, 5)), 1)
        mu[:15] = mu[0]
        frames.append(pd.DataFrame({"s": s, "fold": fold, "r": res}))
        mus.append(mu)
    r = spark.createDataFrame(pd.concat(frames)).repartition(5)
    t = spark.createDataFrame([(s, j, m.tolist()) for s, mu in enumerate(mus) for j, m in enumerate(mu)], "s long, j int, mu array<double>")
    got = cvplus.cv_plus(r, t, ["s"], (0.05, 0.2), cell).toPandas()
    assert len(got) == 160
    for s, mu in enumerate(mus):
        fold, res = frames[s]["fold"].to_numpy(), frames[s]["r"].to_numpy()
        for alpha in (0.05, 0.2):
            hi, lo = math.ceil((1 - alpha) * (len(res) + 1) - 1e-9), math.floor(alpha * (len(res) + 1) + 1e-9)
            rows = got[(got.s == s) & (got.alpha == alpha)].sort_values("j")
            assert np.allclose(rows.lower, np.sort(mu[:, fold] - res, axis=1)[:, lo - 1], atol=1e-12)
            assert np.allclose(rows.upper, np.sort(mu[:, fold] + res, axis=1)[:, hi - 1], atol=1e-12)
    cells = cvplus.residual_cells(r, ["s"], 10)
    assert cells.agg(F.max(F.size("values"))).first()[0] <= 10 and cells.agg(F.sum("n")).first()[0] == 357
    cells = cvplus.residual_cells(r, ["s"], 2)
    needs = cvplus.asked_cells(cells, t.where("j = 0"), ["s"], (0.2,))
    assert needs.count() < 0.6 * 2 * cells.count()


def test_local_budget_against_loops(spark):
    from cohera.operators.budget import counts_at_cuts, local_budget

    rng = np.random.default_rng(12)
    pool = {s: np.round(rng.exponential(1, 40), 1) for s in (0, 1)}
    rows = [(s, g, i, int(rng.integers(0, 30)), float(np.round(rng.exponential(1 + g % 3), 1))) for s in (0, 1) for g in range(6) for i in range([3, 9, 14, 40, 70, 6][g])]
    p = spark.createDataFrame([(s, float(v)) for s, x in pool.items() for v in x], "seed int, s double")
    t = spark.createDataFrame(rows, "seed int, g int, id int, at int, s double").repartition(4)
    got = {(r.seed, r.eval_set, r.g, r.k, r.variant): (r.n_cal, r.inf_flag, r.n_eval, r.coverage) for r in local_budget(p, t, ["seed"], "g", "id", "at", [0, 1, 4, 12], 0.1).collect()}
    want = {}
    for s in (0, 1):
        for g in range(6):
            own = [r[4] for r in sorted((r for r in rows if r[:2] == (s, g)), key=lambda r: (r[3], r[2]))]
            for k in (0, 1, 4, 12):
                for name, scores in {"global": [*pool[s]], "augment": [*pool[s], *own[:k]], "local": own[:k], "hybrid": [*pool[s], *own[:k]] if k < 9 else own[:k]}.items():
                    rank = math.ceil(0.9 * (len(scores) + 1) - 1e-9)
                    q = np.inf if rank > len(scores) else sorted(scores)[rank - 1]
                    for kind, start in (("common", 12), ("per_k", k)):
                        if len(own) >= start + 5 and len(own) >= k:
                            want[s, kind, g, k, name] = (len(scores), bool(np.isinf(q)), len(own) - start, pytest.approx(np.mean([v <= q for v in own[start:]])))
    assert got == want
    cuts = spark.createDataFrame([(s, c) for s in (0, 1) for c in (0.5, 1.0, 9.9)], "seed int, s double")
    assert {(r.seed, r.s): r.upto for r in counts_at_cuts(t, cuts, ["seed"], "s").collect()} == {(s, c): sum(r[0] == s and r[4] <= c for r in rows) for s in (0, 1) for c in (0.5, 1.0, 9.9)}


@pytest.mark.parametrize("digits", [12, 1])
def test_recalibration_inverts_the_curve(spark, digits):
    """Against numpy interpolation through the distinct values; intervals cover as asked on the rows of the fit."""
    rng = np.random.default_rng(5)
    levels = [0.025, 0.1, 0.5, 0.9, 0.975]
    pit = {s: np.round(rng.beta(0.5, 0.7, n), digits) for s, n in ((0, 500), (1, 7), (2, 1))}
    df = spark.createDataFrame([(s, float(v)) for s, x in pit.items() for v in x] + [(0, None)], "s int, pit double").repartition(3)
    for r in I.recalibration_levels(df, ["s"], levels).collect():
        v, n = np.unique(pit[r.s], return_counts=True)
        share = n.cumsum() / n.sum()
        assert r.recal == pytest.approx(np.interp(r.level, np.append(0.0, share), np.append(0.0, v)), abs=1e-9)
    fit = spark.createDataFrame([(0, float(y), 1.0, 2.0) for y in 1 + rng.standard_t(3, 4000)], "s int, y double, mean double, sd double")
    iv = I.recalibrated_intervals(fit, fit, ["s"], (0.1, 0.2)).withColumn("c", F.col("y").between(F.col("lower"), F.col("upper")).cast("double"))
    assert {r.alpha: round(r.c, 2) for r in iv.groupBy("alpha").agg(F.avg("c").alias("c")).collect()} == {0.1: 0.9, 0.2: 0.8}


def test_one_row_per_group_is_valid_where_pooling_is_not(spark):
    """Groups share an effect; a few groups are large. Repeated calibration / test draws over groups."""
    rng = np.random.default_rng(11)
    rows, reps, gid = [], 150, 0
    for rep in range(reps):
        for role, n_groups in (("cal", 30), ("test", 30)):
            for _ in range(n_groups):
                big = rng.random() < 0.2
                b = rng.normal(0, 0.5)
                for e in rng.normal(0, 0.05 if big else 0.6, 50 if big else 3):
                    rows.append((rep, role, gid, len(rows), abs(b + e)))
                gid += 1
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["seed", "role", "g", "id", "s"]))
    cal, test = df.where("role='cal'"), df.where("role='test'")
    one = T.sample_one_per_group(cal, ["seed"], "g", "id", ["s"])
    out = {}
    for name, scores in (("pool", cal), ("gsub", one)):
        q = I.conformal_quantile(scores.select("seed", "s"), ["seed"], "s", (0.1,))
        hit = test.join(q, "seed").groupBy("seed", "g").agg(F.avg((F.col("s") <= F.col("qhat")).cast("double")).alias("c"))
        out[name] = hit.agg(F.avg("c")).first()[0]
    assert abs(out["gsub"] - 28 / 31) < 0.02
    assert out["pool"] < out["gsub"] - 0.02


def test_registered_bootstrap_has_all_seeds_and_replicates(spark, monkeypatch):
    import inspect

    from cohera.plans import data, q_evaluate

    seen, default = {}, inspect.signature(q_evaluate.E.cluster_bootstrap).parameters["b"].default
    monkeypatch.setattr(q_evaluate.E, "cluster_bootstrap", lambda groups, *a, **kw: seen.update(kw, seeds=groups.select("seed").distinct().collect()) or groups.selectExpr("0.0 AS cov_lo", "0.0 AS cov_hi", "0.0 AS pooled_lo", "0.0 AS pooled_hi"))
    q_evaluate.cluster_bootstrap(spark, "/root/testdata/sf0.001")
    assert seen.get("b", default) == 2000 and sorted(r.seed for r in seen["seeds"]) == data.SEEDS


def test_bootstrap_draws_and_law(spark):
    """One block: the keyed draws themselves, in plain Python. Many blocks: the law of resampling whole groups."""
    import hashlib

    from cohera.operators import evaluate as EV

    rng = np.random.default_rng(1)
    data = {k: [(g, int(rng.binomial(n, 0.8)), int(n)) for g, n in enumerate(rng.integers(1, 30, m))] for k, m in (("a", 9), ("b", 60), ("c", 1))}
    df = spark.createDataFrame([(k, *r) for k, rows in data.items() for r in rows], "k string, g int, hits long, n long").repartition(3)
    got = {r.k: r for r in EV.cluster_bootstrap(df, ["k"], "g", b=300, seed=7).collect()}

    def mix(x):
        x ^= x >> 16
        x = x * 0x7FEB352D % 2**32
        x ^= x >> 15
        x = x * 0x846CA68B % 2**32
        return x ^ x >> 16

    number = lambda *parts: int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)
    for k, rows in data.items():
        order, key = sorted(rows, key=lambda r: number("bootrank", k, r[0])), number("boot7", k) % 2**32
        cov, pooled = [], []
        for r in range(300):
            start = mix(key ^ mix(r))
            drawn = [order[mix((start + i) % 2**32) * len(rows) >> 32] for i in range(len(rows))]
            cov.append(np.mean([h / n for _, h, n in drawn]))
            pooled.append(sum(h for _, h, _ in drawn) / sum(n for _, _, n in drawn))
        assert (got[k].cov_lo, got[k].cov_hi) == pytest.approx(tuple(np.quantile(cov, [0.025, 0.975])))
        assert (got[k].pooled_lo, got[k].pooled_hi) == pytest.approx(tuple(np.quantile(pooled, [0.025, 0.975])))
    many = {r.k: r for r in EV.cluster_bootstrap(df, ["k"], "g", b=4000, block=7).collect()}
    rows = np.array(data["b"])
    pick = np.random.default_rng(2).integers(0, 60, (4000, 60))
    want = np.quantile((rows[:, 1] / rows[:, 2])[pick].mean(1), [0.025, 0.975])
    assert (many["b"].cov_lo, many["b"].cov_hi) == pytest.approx(tuple(want), abs=0.01)
    shares = [EV._share(5, 50, 60, i, 7) for i in range(9)]
    assert (sum(shares) == 60).all() and len(set(map(tuple, shares))) == 9


def test_job_rows_are_derived_once(spark):
    """Fits, cuts and scores read the written rows: no later plan hashes groups or parses the events again."""
    from cohera.plans import data as d
    from tests.conftest import SF

    kept = d.scored_wide(d.job(spark, SF))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "regexp_extract" not in plan
    lazy = d.job(spark, SF, keep=False)
    assert sorted(kept.select("seed", "id", "role").collect()) == sorted(lazy.where("role <> 'train'").select("seed", "id", "role").collect())
