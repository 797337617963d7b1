"""Names, text audits, label rules, sources and sinks."""

import math

import pytest
from pyspark.sql import functions as F

from cohera.functions import numeric as N
from cohera.functions.text import normalise_name, normalise_title
from cohera.operators import quality as Q, spectra as B, textaudit as X
from cohera.sources import readers as R, sinks as W


def one(spark, text, c):
    return spark.createDataFrame([(text,)], "t string").select(c(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("  Lac Léman  Nr. 12", "lac leman"), ("Gulf of Mexcio #3", "gulf of mexico"), ("Markermeer Oost", "markermeer"), ("Ijmeer nr7", "ijmeer")])
def test_names(spark, raw, want):
    assert one(spark, raw, normalise_name) == want


def test_titles(spark):
    assert one(spark, "The <i>Écologie</i> of  Lakes: 2nd-Ed.", normalise_title) == "the ecologie of lakes 2nd ed"


def test_sentences_protect_abbreviations_and_decimals(spark):
    t = "Widths fell by 0.5 (see Fig. 3). Smith et al. Found this. It holds, e.g. In lakes! Done?"
    got = one(spark, t, X.sentences)
    assert got == ["Widths fell by 0.5 (see Fig. 3).", "Smith et al. Found this.", "It holds, e.g. In lakes!", "Done?"]


def test_redaction_keeps_allowed_addresses(spark):
    t = r"Mail me@here.org or BOSS@corp.com, file C:\Users\bob\x.txt and boss@corp.com.au"
    df = spark.createDataFrame([(1, t)], "id int, t string")
    r = X.redact(df, "t", ("boss@corp.com",)).first()
    assert "me@here.org" not in r.redacted and "bob" not in r.redacted and "boss@corp.com," in r.redacted
    assert (r.n_path, r.n_mail) == (1, 2)
    found = {(x.label, x.match) for x in X.scan(df, "id", "t").collect()}
    assert ("e-mail", "me@here.org") in found and any(k == "absolute user path" for k, _ in found)


def test_lint_exempts_names(spark):
    df = spark.createDataFrame([(1, "The Ocean and Land Colour Instrument shows colour and behaviour. Colour!")], "d int, t string")
    got = {(r.word, r.n) for r in X.lint(df, "d", "t", X.SPELLING).collect()}
    assert got == {("colour", 2), ("behaviour", 1)}


def test_abbreviation_order(spark):
    t = "We use ABC here. " + "x" * 500 + " The (ABC) scheme and (DEF) then DEF; GHI."
    got = {r.abbreviation: r.status for r in X.abbreviations(spark.createDataFrame([(1, t)], "d int, t string"), "d", "t").collect()}
    assert got == {"ABC": "used before definition", "DEF": "ok", "GHI": "never defined"}


def test_label_cascade(spark):
    df = spark.createDataFrame([(1, "d1", "m1"), (2, "d9", "m1"), (3, "d9", "m2"), (4, "d1", None), (5, "d1", "m7")], "id int, d string, m string")
    tab = spark.createDataFrame([("d1", "m1", "HPLC"), ("d1", "m2", "HPLC"), ("d2", "m2", "fluo")], "d string, m string, cls string")
    got = {r.id: (r.cls, r.cls_source) for r in Q.label_cascade(df, tab, ("d", "m"), "cls").collect()}
    assert got == {1: ("HPLC", "dataset+method"), 2: ("HPLC", "method name only"), 3: ("ambiguous", "method name only"),
                   4: ("missing", "method missing"), 5: ("unmatched", "not in table")}


def test_missing_flag_means_not_flagged(spark):
    df = spark.createDataFrame([(1, None), (0, 0), (None, None)], "a int, b int")
    assert [r.k for r in df.select(Q.keep_unless_flagged("a", "b").alias("k")).collect()] == [False, True, True]


@pytest.mark.parametrize("v,rule,want", [(1234.5, "i1", "1,234"), (0.8951, "d3", "0.895"), (0.8951, "p1", "89.5"), (15.534, "s3", "15.5"), (0.00123456, "s3", "0.00123"), (2.5, "h0", "3"), (0.0381, "u3", "0.039"), (0.9996, "f2", "0.99"), (0.0, "s3", "0")])
def test_rounding_rules(spark, v, rule, want):
    assert spark.range(1).select(N.round_by_rule(F.lit(v), rule).alias("x")).first().x == want


def test_flat_spectrum_and_missing_support(spark):
    srf = spark.createDataFrame([("b1", 3, 0.2), ("b1", 4, 1.0), ("b1", 5, 0.005), ("b2", 6, 1.0), ("b2", 7, 0.5)], "band string, pos int, response double")
    w = B.band_weights(srf, 0, 9)
    df = spark.createDataFrame([(1, [0.0123] * 10), (2, [None] * 4 + [0.01] * 6)], "id int, v array<double>")
    got = {r.id: r for r in B.band_means(df, "v", w).collect()}
    assert got[1].b1 == pytest.approx(0.0123, abs=1e-12) and got[2].b1 is None and got[2].b2 == pytest.approx(0.01)
    outside = B.band_means(df, "v", B.band_weights(srf, 0, 6))
    assert outside.first().b2 is None


def test_wide_axis_must_be_contiguous(spark):
    with pytest.raises(ValueError):
        B.wide_to_array(spark.createDataFrame([(1.0, 2.0)], "w_1 double, w_3 double"), "w_", "a")


def test_csv_keeps_infinite_and_missing_apart(spark, tmp_path):
    p = str(tmp_path / "c")
    spark.createDataFrame([("a", math.inf), ("b", None), (None, 1.0)], "k string, v double").write.csv(p, header=True)
    got = {r.k: r.v for r in R.read_keyed_csv(spark, p, "k string, v double", "k").collect()}
    assert got == {"a": math.inf, "b": None}


def test_finished_units_are_not_recomputed(spark, tmp_path):
    p, seen = str(tmp_path / "u"), []
    plan = spark.createDataFrame([(i,) for i in range(6)], "unit int")

    def work(todo):
        seen.append(sorted(r.unit for r in todo.collect()))
        return todo.withColumn("v", F.col("unit") * 2)

    W.run_pending(spark, plan.where("unit < 2"), ["unit"], p, work)
    out = W.run_pending(spark, plan, ["unit"], p, work)
    assert seen == [[0, 1], [2, 3, 4, 5]] and out.count() == 6


def test_partition_pruning_and_column_pruning(spark, tmp_path):
    p = str(tmp_path / "p")
    W.write_partitioned(spark.range(100).selectExpr("id", "id % 3 as part", "'x' as wide"), p, "part")
    plan = R.read_slice(spark, p, "part", 1).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "wide" not in plan.split("ReadSchema")[1]
