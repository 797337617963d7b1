"""Rules that were wrong once: token positions, accents, claims, the planned family, fallbacks, missed brackets."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from cohera.functions import keys as K
from cohera.functions.text import fold_accents, normalise_name
from cohera.operators import inference as T
from cohera.operators import joins as J
from cohera.operators import models as M
from cohera.operators import selection as S
from cohera.operators import textaudit as X


def test_abbreviations_use_whole_tokens(spark):
    text = "The CABX unit. Then AB (ABSOLUTE) was used. AB is short. AB (AB)."
    rows = spark.createDataFrame([(1, text), (2, "First SRF-weighted sums, then (SRF) and éABC, Chl-a."), (3, "")], "doc int, text string")
    got = {(r.doc, r.abbreviation): (r.first_use, r.defined_at, r.status) for r in X.abbreviations(rows, "doc", "text", mixed=("Chl-a",)).collect()}
    assert got[(1, "AB")] == (text.index("AB (") + 1, text.index("(AB)") + 1, "ok")
    assert got[(1, "CABX")][2] == "never defined" and got[(2, "SRF")] == (7, 31, "ok")
    assert (2, "ABC") not in got and (2, "Chl") not in got
    late = spark.createDataFrame([(1, "AB " + "x" * 500 + " (AB)")], "doc int, text string")
    assert X.abbreviations(late, "doc", "text").first().status == "used before definition"


def test_sentences_keep_abbreviations_and_decimals(spark):
    t = "See Fig. A for 3.5 m. It is so, e.g. Here.  (Then) more? Yes! no."
    got = spark.createDataFrame([(t,)], "t string").select(X.sentences(F.col("t")).alias("s")).first().s
    assert got == ["See Fig. A for 3.5 m.", "It is so, e.g. Here.", "(Then) more?", "Yes! no."]


def test_accents_fold_by_decomposition(spark):
    rows = [("Škocjan jezero", "Skocjan jezero"), ("Łódź", "odz"), ("ﬁeld Ⅳ ½", "field IV 12"), ("naïve Çà", "naive Ca"), (None, None)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    assert [r.x for r in df.select(fold_accents(F.col("t")).alias("x")).collect()] == [b for _, b in rows]
    assert df.limit(1).select(normalise_name(F.col("t")).alias("x")).first().x == "skocjan jezero"


def test_claims_know_every_rule_and_refuse_others(spark):
    ledger = spark.createDataFrame([("a", 0.12345)], "key string, value double")
    ok = spark.createDataFrame([("a", "0.12345", "d5"), ("a", "12.3450", "p4"), ("a", "0.124", "u3")], "key string, printed string, rule string")
    assert all(r.agrees for r in J.check_claims(ok, ledger).collect())
    with pytest.raises(Exception, match="unknown rounding rule"):
        J.check_claims(ok.withColumn("rule", F.lit("q9")), ledger).collect()


def test_seed_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(K.member_seed(F.lit("cv"), F.lit(900), F.lit(0), F.lit(0))).collect()


ARMS = [("H1", "x"), ("H1", "y"), ("H2", "z")]


def test_planned_family_keeps_missing_cells(spark):
    found = spark.createDataFrame([("H1", "A", "x", 0.01), ("H1", "A", "y", 0.02), ("H2", "A", "z", None), ("H1", "B", "x", 0.001)], "hypothesis string, target string, arm string, p_raw double")
    targets = spark.createDataFrame([("A",), ("B",), ("C",), ("A",)], "target string")
    got = {(r.target, r.hypothesis, r.arm): (r.p_raw, r.complete) for r in T.planned_arms(found, targets, ARMS).collect()}
    assert len(got) == 9 and got[("A", "H1", "x")] == (0.01, True) and got[("A", "H2", "z")] == (1.0, False)
    assert got[("B", "H1", "y")] == (1.0, False) and got[("C", "H2", "z")] == (1.0, False)
    with pytest.raises(Exception, match="came twice"):
        T.planned_arms(found.unionByName(found), targets, ARMS).collect()


def test_saturating_form_falls_back(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (2.0,), (5.0,), (None,)], "r double")
    got = [r.p for r in df.select(M.saturating_prediction(F.lit(1.0), F.lit(4.0), F.col("r"), F.lit(9.0)).alias("p")).collect()]
    assert got[0] == got[1] == got[3] == got[4] == 9.0 and abs(got[2] - 1.6020599913) < 1e-9


def test_bracket_is_filtered_before_the_shuffle(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").cast("double").alias("v"))
    out = S.quantiles(df, ["g"], "v", {"m": 0.5})
    buffer = io.StringIO()
    with contextlib.redirect_stdout(buffer):
        out.explain("simple")
    # the rows meet the brackets without being shuffled
    assert "BroadcastHashJoin" in buffer.getvalue()
    want = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert {r.g: r.m for r in out.collect()} == want


def test_missed_bracket_raises(spark, monkeypatch):
    real = F.percentile_approx
    monkeypatch.setattr(S.F, "percentile_approx", lambda c, grid, acc: F.transform(real(c, grid, acc), lambda e: e + 1e6))
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))
    with pytest.raises(Exception, match="missed its bracket"):
        S.quantiles(df, ["g"], "v", {"m": 0.5}).collect()
