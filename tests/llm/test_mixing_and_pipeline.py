"""Pfair schedules keep every source within a block of its target; the pipeline's stages do what they say."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohera.llm import mixing


def docs_of(spark, sizes):
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, s, "z"))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, source string, share string")


@pytest.mark.parametrize("seed", range(3))
def test_deviation_is_below_one_block(spark, seed):
    rng = random.Random(seed)
    weights = [(f"s{i}", rng.choice([1, 2, 5, 30, 400])) for i in range(rng.randint(2, 12))] + [(None, 7)]
    share = mixing.shares(spark.createDataFrame(weights, "source string, weight long"), 120)
    a = {r.source: r.share for r in share.collect()}
    assert sum(a.values()) == 120
    slots = {r.slot: r.source for r in mixing.period_schedule(share, 120).collect()}
    assert sorted(slots) == list(range(120))
    done = dict.fromkeys(a, 0)
    for t in range(120):
        done[slots[t]] += 1
        for s, n in a.items():
            assert abs(done[s] - n * (t + 1) / 120) < 1
    assert done == a


def test_every_row_is_placed_once(spark):
    docs = docs_of(spark, {"big": 500, "mid": 90, "one": 1, None: 40})
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(spark.createDataFrame([(None, "big", "q")], docs.schema))
    out = mixing.mix_sources(docs, block=4, period=50).collect()
    assert len(out) == docs.count() and set(out[0].asDict()) == {"doc_id", "source", "share", "mix_block", "mix_slot", "mix_place"}
    places = {(r.source, r.mix_block, r.mix_place) for r in out}
    assert len(places) == len(out)
    by_slot = {}
    for r in out:
        by_slot.setdefault(r.mix_slot, set()).add((r.source, r.mix_block))
    assert all(len(v) == 1 for v in by_slot.values())
    for s in ("big", "mid", None):
        blocks = sorted({(r.mix_block, r.mix_slot) for r in out if r.source == s})
        n = sum(r.source == s for r in out)
        assert [b for b, _ in blocks] == list(range(math.ceil(n / 4))) and [x for _, x in blocks] == sorted(x for _, x in blocks)


def test_given_weights_and_unplanned_sources(spark):
    docs = docs_of(spark, {"a": 30, "b": 30, "c": 30})
    w = spark.createDataFrame([("a", 3), ("b", 1), ("c", 0), ("gone", 2)], "source string, weight int")
    out = mixing.mix_sources(docs, w, block=1, period=12).collect()
    early = [r.source for r in sorted(out, key=lambda r: r.mix_slot)]
    assert set(early[60:]) == {"c"} and early[:8].count("a") == 6
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_too_many_sources_are_refused(spark):
    with pytest.raises(ValueError):
        mixing.mix_sources(docs_of(spark, {f"s{i}": 1 for i in range(9)}), period=8)


@pytest.mark.parametrize("weights", [{"a": 300, **{f"s{i:02}": 14 + i % 3 for i in range(49)}}, {"a": 3, "b": 1}, {"a": 10**15 + 1, "b": 10**14, None: 3 * 10**14}])
def test_deviation_from_the_weights_themselves(spark, weights):
    """More sources than a rounded period can serve fairly, common factors, and weights too large for whole periods."""
    total, seen = sum(weights.values()), {}
    docs = docs_of(spark, {s: min(60, max(1, 300 * w // total)) for s, w in weights.items()})
    w = spark.createDataFrame(list(weights.items()), "source string, weight long")
    for r in mixing.mix_sources(docs, w, block=1).collect():
        assert seen.setdefault(r.mix_slot, (r.source, r.mix_block)) == (r.source, r.mix_block)
        n = weights[r.source]
        assert r.mix_block * total // n <= r.mix_slot < -(-(r.mix_block + 1) * total // n)
    assert len(seen) == docs.count()


def test_decimal_weights_without_common_factor(spark):
    w = spark.createDataFrame([("a", 0.5), ("b", 0.25), (None, 0.25), ("no", 0.0)], "source string, weight double")
    for kind in ("double", "decimal(5,2)"):
        got = mixing.whole_weights(w.withColumn("weight", F.col("weight").cast(kind))).collect()
        assert {r.source: r.share for r in got} == {"a": 2, "b": 1, None: 1}


def test_ranges_rank_like_one_window(spark):
    docs = docs_of(spark, {"big": 3000, "small": 3})
    got = {r.doc_id: r._mix_rank for r in mixing.ranked(docs, "doc_id", "source", "_mix_", bucket=64).collect()}
    import hashlib
    for s in ("big", "small"):
        ids = [r.doc_id for r in docs.where(F.col("source") == s).collect()]
        order = sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
        assert [got[i] for i in order] == list(range(len(ids)))


PASSAGE = "\n".join(" ".join(f"p{k}w{i}" for i in range(20)) for k in range(4))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(9)
    path = str(tmp_path_factory.mktemp("sf"))
    english, german = "the of and to in is that was for it with as his on be".split(), "der die und das nicht mit ein auch sich von ist zu den im auf".split()
    text = lambda words, n: " ".join(rng.choices(words, k=n))
    rows = []
    for i in range(60):
        words, lang = (english, "en") if i % 3 else (german, "de")
        rows.append((i, text([w + str(rng.randint(0, 9)) * 0 + rng.choice(["", "s", "e", "er"]) for w in words for _ in range(3)], 120), lang, f"s{i % 4}", 7))
    item = " ".join(f"bench{i} the" for i in range(8))
    rows += [
        (100, rows[1][1] + " end", "en", "s0", 1), (101, rows[2][1], "en", "s1", 1), (102, "12 34 !!", None, None, None), (103, None, "en", "s1", 0),
        (104, text(english, 40) + " " + item + " " + text(english, 40), "en", "s2", 5), (105, "Alpha the of\n" + PASSAGE + "\nomega and to", "en", "s3", 5), (106, "Beta is that\n" + PASSAGE + "\nlast in was", "en", None, 5),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect(spark, small):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(c.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "source_mixing"]
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    one = stages["language_id"](spark, docs, small)
    assert one.columns == docs.columns and ids(docs) - ids(one) == {102, 103}
    two = stages["line_dedup"](spark, docs, small)
    assert two.columns == docs.columns and ids(docs) - ids(two) == {101}
    later = two.where("doc_id = 106").first()
    assert later.text == "Beta is that\nlast in was" and later.n_chars == len(later.text)
    assert PASSAGE in two.where("doc_id = 105").first().text
    three = stages["near_dedup"](spark, docs, small)
    assert three.columns == docs.columns and ids(docs) - ids(three) == {100, 101, 106}
    four = stages["decontamination"](spark, docs, small)
    assert four.columns == docs.columns and ids(docs) - ids(four) == {104}
    whole = c.run(spark, small)
    assert ids(whole) == set(range(60)) | {105, 106} and {"mix_block", "mix_slot", "mix_place"} <= set(whole.columns)


def test_pipeline_on_empty_tables(spark, small, tmp_path):
    import corpus_pipeline as c

    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_other_columns_come_back_whatever_their_names(spark, small):
    """Every name that an operator uses inside, as an extra column: each stage keeps it and its values."""
    import re
    from pathlib import Path

    import corpus_pipeline as c
    from cohera.llm import decontamination, language_id, line_dedup, mixing, near_dedup

    inner = {"_s", "_src", "_b", "_slot", "_gone", "_k", "_lang_pred", "_mark", "_content", "lines_deleted", "lines_before", "class", "score", "a.b", "id", "content", c.CARRIED}
    for m in (decontamination, language_id, line_dedup, mixing, near_dedup):
        inner |= set(re.findall(r'"(_[a-z_0-9]+)"', Path(m.__file__).read_text()))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = sorted(inner)
    wide = docs.select("*", *[F.concat(F.lit(f"{i}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(n) for i, n in enumerate(extra)])
    for name, stage in c.STAGES:
        plain = {r.doc_id: r for r in stage(spark, docs, small).collect()}
        out = stage(spark, wide, small)
        assert out.columns[: len(wide.columns)] == wide.columns
        rows = {r["doc_id"]: r for r in out.collect()}
        assert rows.keys() == plain.keys()
        for i, r in rows.items():
            assert all(r[n] == f"{k}/{i}" for k, n in enumerate(extra)) and r["text"] == plain[i].text


def test_no_language_to_learn_from(spark, small):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in dict(c.STAGES)["language_id"](spark, docs, small).collect()}
    assert {r.doc_id for r in docs.collect()} - kept == {102, 103}
