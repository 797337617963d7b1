"""Load checks count and refuse; labels, strict maps and smooth rows on small tables."""

import pytest
from pyspark.sql import functions as F

from cohera.operators import checks as K, quality as Q, spectra as B
from cohera.sources import readers as R


def report(df):
    return {r.rule: r.violations for r in df.collect()}


def test_reports(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", None), (2, "b", -1.0), (None, "b", 3.0), (None, "c", 4.0)], "k int, t string, v double")
    assert report(K.broken_rows(df, present=F.col("k").isNotNull(), positive=F.col("v") > 0)) == {"present": 2, "positive": 2}
    assert report(K.unique_key(df, ["k"])) == {"unique_key": 2} and report(K.unique_key(df, ["k", "v"])) == {"unique_key": 0}
    assert report(K.row_count(df, 7)) == {"row_count": 2}
    other = spark.createDataFrame([("a",), ("b",), ("b",)], "t string")
    assert report(K.join_cardinality(df, other, ["t"])) == {"join_cardinality": 3}
    assert report(K.non_empty(df, "t", ["a", "c", "x", "y"])) == {"non_empty": 2}
    nothing = df.where("false")
    assert report(K.unique_key(nothing, ["k"])) == {"unique_key": 0} and report(K.join_cardinality(nothing, other, ["t"])) == {"join_cardinality": 0}
    assert report(K.non_empty(nothing, "t", ["a"])) == {"non_empty": 1} and report(K.broken_rows(nothing, r=F.lit(False))) == {"r": 0}
    K.require(K.unique_key(df, ["k", "v"]))
    with pytest.raises(ValueError, match="row_count: 2; unique_key: 2"):
        K.require(K.unique_key(df, ["k"]), K.row_count(df, 7))


def test_keyed_csv_is_refused(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([("a", "1"), ("b", "x"), (None, "3"), ("b", "4")], "k string, v string").write.csv(path, header=True)
    read = lambda **kw: R.read_keyed_csv(spark, path, "k string, v double", "k", **kw)
    assert read().count() == 3 and read(null_keys=1).count() == 3
    with pytest.raises(ValueError, match="null_keys: 1"):
        read(null_keys=2)
    with pytest.raises(ValueError, match="unique_key: 1"):
        read(null_keys=1, unique=True)


def test_typed_results_are_refused(spark):
    df = spark.createDataFrame([("m", "new", None, 0.1), ("m", "old", "strict", 0.2)], "model string, run_dir string, population string, alpha double").withColumn("descriptive_only", F.lit(None).cast("string"))
    got = R.typed_results(df, ["model", "alpha"], {"run_dir": ["bad"]}, {"level": F.col("alpha") < 1}).collect()
    assert [(r.population, r.noise_add, r.descriptive_only) for r in got] == [("primary", 0.0, False), ("strict", 0.0, False)]
    for kw, message in (({"keys": ["model"]}, "unique_key: 1"), ({"forbidden": {"run_dir": ["old"]}}, "run_dir_allowed: 1"), ({"flags": {"level": F.col("alpha") > 0.15}}, "level: 1")):
        with pytest.raises(ValueError, match=message):
            R.typed_results(df, **kw)


def test_strict_map_and_cell_labels(spark):
    df = spark.createDataFrame([("a", 1), ("z", 2), (None, 3)], "k string, i int")
    m = lambda strict: Q.map_with_override(F.col("k"), {"a": "A"}, F.col("i"), {3: "three"}, strict).alias("m")
    assert [r.m for r in df.select(m(False)).collect()] == ["A", None, "three"]
    with pytest.raises(Exception, match="unmapped value: z"):
        df.select(m(True)).collect()
    assert [r.m for r in df.where("i <> 2").select(m(True)).collect()] == ["A", "three"]
    p = spark.createDataFrame([(1, 12.0, -3.0), (2, None, 5.0), (3, None, None), (4, 55.0, 5.0)], "id int, lat double, lon double")
    cells = spark.createDataFrame([(10, -10, "lake")], "lat_cell int, lon_cell int, name string")
    got = {r.id: r.place for r in Q.cell_label(p, "lat", "lon", cells, "id", {2: "by hand"}, "place").collect()}
    assert got == {1: "lake", 2: "by hand", 3: None, 4: "other"}


def test_smooth_rows(spark):
    df = spark.createDataFrame([(1, 0.01, 1.0, 1.02, True), (2, 0.01, 1.0, 1.2, True), (3, 0.5, 1.0, 1.0, True), (4, 0.0, 1.0, 1.0, False)], "id int, rel double, v double, ref double, ok boolean")
    got = {r.id: (r.smooth, r.within) for r in B.smooth_check(df, F.col("ok"), F.col("rel"), F.col("v"), F.col("ref")).collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (False, True), 4: (False, True)}
    r = B.smooth_check(df, F.col("ok"), F.col("rel"), F.col("v"), F.col("ref")).first()
    assert r.share_smooth == 0.5 and r.share_complete == pytest.approx(2 / 3)
