"""Tests over repeats: literals worked out by hand and simulation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohera.functions import special as SP
from cohera.operators import inference as T


def test_distribution_functions():
    assert SP.t_cdf(np.array([2.093024054408263]), np.array([19.0]))[0] == pytest.approx(0.975, abs=1e-9)
    assert SP.t_quantile(np.array([0.95]), np.array([19.0]))[0] == pytest.approx(1.729132811521367, abs=1e-7)
    assert SP.t_cdf(np.array([0.0]), np.array([3.0]))[0] == pytest.approx(0.5)
    assert SP.beta_inc(2.0, 3.0, 0.4) == pytest.approx(0.5248)
    z = np.random.default_rng(0)
    sim = (z.normal(1.0, 1, 200_000)) / np.sqrt(z.chisquare(19, 200_000) / 19)
    assert SP.nct_sf(1.729, 19.0, 1.0)[0] == pytest.approx((sim > 1.729).mean(), abs=5e-3)


def cells(spark, values, n_test=50.0, n_train=200.0, arm="a"):
    return spark.createDataFrame([(arm, i, v, n_test, n_train) for i, v in enumerate(values)], "arm string, seed int, v double, nt double, nr double")


def test_corrected_standard_error(spark):
    v = [0.90, 0.92, 0.88, 0.91, 0.89]
    r = T.resampled_stats(cells(spark, v), ["arm"], "v", "nt", "nr", 0.88).first()
    want = math.sqrt((1 / 5 + 50 / 200) * np.var(v, ddof=1))
    assert r.se == pytest.approx(want) and r.t == pytest.approx((0.90 - 0.88) / want) and r.J == 5


def test_not_evaluable_cells_get_p_one(spark):
    for vals in ([0.9], [0.9, math.inf, 0.8]):
        st = T.resampled_stats(cells(spark, vals), ["arm"], "v", "nt", "nr", 0.88)
        r = T.add_p_value(st, "t", F.col("J") - 1, F.lit("greater"), "mean", "se").first()
        assert r.p_raw == 1.0 and r.t is None


def test_p_value_direction(spark):
    st = T.resampled_stats(cells(spark, [0.95, 0.96, 0.94, 0.95]), ["arm"], "v", "nt", "nr", 0.88)
    p = {a: T.add_p_value(st, "t", F.col("J") - 1, F.lit(a), "mean", "se").first().p_raw for a in ("greater", "less")}
    assert p["greater"] < 0.05 < p["less"] and p["greater"] + p["less"] == pytest.approx(1)


def test_difference_of_arms(spark):
    v = [0.90, 0.92, 0.88, 0.91, 0.89]
    a = T.resampled_stats(cells(spark, [x + 0.05 for x in v], arm="x"), ["arm"], "v", "nt", "nr", 0.0)
    b = T.resampled_stats(cells(spark, v, arm="x"), ["arm"], "v", "nt", "nr", 0.0)
    r = T.difference_stats(a, b, ["arm"], 0.0).first()
    assert r.df == 4 and r["diff"] == pytest.approx(0.05)


def test_holm_known_answer(spark):
    df = spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.04), (1, "c", 0.03)], "f int, k string, p double")
    got = {r.k: r.p_holm for r in T.holm(df, ["f"], "p", "k").collect()}
    assert got == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})


def test_power_ledger_values(spark):
    rng = np.random.default_rng(1)
    st = T.resampled_stats(cells(spark, (0.9 + rng.normal(0, 0.02, 20)).tolist(), 75.0, 300.0), ["arm"], "v", "nt", "nr", 0.88)
    r = T.power_ledger(st, 0.88).first()
    assert r.effective_repeats == pytest.approx(1 / (1 / 20 + 0.25))
    assert r.inflation == pytest.approx(math.sqrt((1 / 20 + 0.25) * 20))
    assert r.threshold == pytest.approx(0.88 + 1.729132811521367 * r.se)
    assert 0 < r.power_90_corrected < r.power_92_corrected < 1
