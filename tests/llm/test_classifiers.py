"""Language ID, toxicity and token counts: held-out accuracy, counterfactual behaviour, brute-force segmentation."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohera.llm import language_id as lid
from cohera.llm import token_counts as tc
from cohera.llm import toxicity as tox
from cohera.llm.textcore import text_slices, words

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = lid.train(docs, ~held, "doc_id", "text", "lang")
    out = lid.identify(docs, model).where(held).select("lang", "lang_pred", "score", "rejected").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.97 and out.rejected.mean() < 0.01 and out.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "de"), (4, "日本語", None), (5, "the the and of", "en"), (6, "der die und das", "de"), (6, "der die und das", "de"), (7, "the of " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lid.train(docs, F.lit(True), "doc_id", "text", "lang")
    got = {r.doc_id: r for r in lid.identify(docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1, 2, 3))
    assert got[4].lang_pred in ("en", "de") and got[7].lang_pred == "en"
    none = lid.identify(docs.limit(0), None)
    assert none.count() == 0 and lid.train(docs.limit(0), F.lit(True), "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in lid.identify(docs, None).collect()} == {"und"}


def test_language_training_runs_in_a_task_not_in_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the the and of", "en"), (2, "der die und das", "de"), (3, "a", "en")], "doc_id long, text string, lang string")

    def learned(texts, langs):
        import os

        return lid.LanguageModel((str(os.getpid()), *texts.to_pylist(), *langs), np.zeros((1, 1)), 1.0, 0.0)

    monkeypatch.setattr(lid, "fit", learned)
    where, *seen = lid.train(docs, F.lit(True), "doc_id", "text", "lang").langs
    assert int(where) != os.getpid() and seen == ["der die und das", "a", "the the and of", "de", "en", "en"]


FOREIGN = [
    "asdkjh qwoieu zxmcn bvlaks jdhfg qpwoei rutyal skdjfh gzmxn", "zzzzqqqq xxyyzz", "Това е изречение на български език за времето",
    "日本語の文章はここにあります", "questo è un testo scritto in italiano per la prova", "ωραία μέρα σήμερα στην πόλη"]


@pytest.mark.parametrize("sf, lost", [("0.01", 0.01), ("0.1", 0.004)])
def test_unlearned_languages_and_noise_are_rejected_and_clean_texts_kept(spark, sf, lost):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = lid.train(docs, ~held, "doc_id", "text", "lang")
    probes = spark.createDataFrame([(t,) for t in FOREIGN] + [(t * 2_000,) for t in FOREIGN[:3]], "text string")
    assert all(r.rejected for r in lid.identify(probes, model).collect())
    kept = spark.createDataFrame([("the and of",), ("le la les des",), ("der die und das",)], "text string")
    assert not any(r.rejected for r in lid.identify(kept, model).collect())
    assert lid.identify(docs.where(held), model).select(F.avg(F.col("rejected").cast("int"))).first()[0] <= lost


def test_a_language_left_out_is_rejected(spark):
    """Texts of a learned language pass, those of the one that was held back do not."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.length("text") > 200)
    model = lid.train(docs, F.col("lang") != "de", "doc_id", "text", "lang")
    rate = {r.lang: r.r for r in lid.identify(docs, model).groupBy("lang").agg(F.avg(F.col("rejected").cast("int")).alias("r")).collect()}
    assert rate["de"] > 0.95 and max(v for k, v in rate.items() if k != "de") < 0.004


def test_novelty_levels_against_sets():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcde" if i % 3 else "cdefé", k=4)) for _ in range(rng.randint(0, 12))) for i in range(60)]
    y = np.array([i % 3 for i in range(60)])
    sets = [lid.subwords(t, lid.SEEN_BITS)[0] for x in texts for t in text_slices(pa.array([x]))]
    got = lid.Learned.of(pa.array(texts), y).levels(pa.array(texts), y)
    for i, found in enumerate(sets):
        others = set(np.concatenate([s for j, s in enumerate(sets) if j != i]).tolist())
        foreign = set(np.concatenate([s for j, s in enumerate(sets) if y[j] != y[i]]).tolist())
        for level, known in zip(got, (others, foreign)):
            assert abs(level[i] - sum(b not in known for b in found.tolist()) / (len(found) + lid.PRIOR)) < 1e-12


def test_scores_do_not_depend_on_slices():
    texts = pa.array(["the of and", "der die das " * 50, "le la les", ""] * 30)
    model = lid.fit(texts, ["en", "de", "fr", "en"] * 30, least_examples=600)
    one = [lid.mean_logits(model.logits, *lid.subwords(t)) for t in text_slices(texts)]
    many = [lid.mean_logits(model.logits, *lid.subwords(t)) for t in text_slices(texts, limit=16)]
    assert np.array_equal(np.concatenate(one), np.concatenate(many))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = tox.train(docs, labels, ~held)
    out = tox.score_toxicity(docs.join(labels.where(held), "doc_id"), model).select("toxic", (F.col("score") >= 0.7).alias("p")).toPandas()
    assert out[out.toxic == 1].p.mean() > 0.8 and out[out.toxic == 0].p.mean() < 0.01


def _sample(texts, labels):
    rows = []
    here, there = tox.swap_table()
    for i, (t, y) in enumerate(zip(texts, labels)):
        s = next(text_slices(pa.array([t])))
        w = words(s)
        swapped = w.hashes.copy()
        hit = np.isin(w.hashes, here)
        swapped[hit] = there[np.searchsorted(here, w.hashes[hit])]
        rows.append((y, i, np.unique(tox.features(w.hashes, w.offs)[0]).view(np.int64), np.unique(tox.features(swapped, w.offs)[0]).view(np.int64) if hit.any() else np.zeros(0, np.int64)))
    return pa.table({"label": pa.array([r[0] for r in rows], pa.int32()), "family": pa.array([r[1] for r in rows], pa.int64()), "x": pa.array([r[2] for r in rows], pa.list_(pa.int64())), "swapped": pa.array([r[3] for r in rows], pa.list_(pa.int64()))})


def test_counterfactual_penalty_lowers_the_score_of_neutral_mentions():
    rng = random.Random(3)
    filler = [f"word{i}" for i in range(40)]
    text = lambda *extra: " ".join(rng.sample(filler, 12) + list(extra))
    texts = [text("idiot", "muslim") for _ in range(60)] + [text("idiot") for _ in range(20)] + [text() for _ in range(150)] + [text("christian") for _ in range(40)]
    labels = [1] * 80 + [0] * 190
    def shift(fair):
        m = tox.fit(_sample(texts, labels), fair=fair)
        score = lambda t: float(m.scores(s.data, words(s))[0]) if (s := next(text_slices(pa.array([t])))) else 0
        return score("a neutral muslim family"), score("a neutral christian family"), score("you idiot there")
    plain, fair = shift(0.0), shift(5.0)
    assert fair[0] < 0.5 * plain[0] and abs(fair[0] - fair[1]) < abs(plain[0] - plain[1])
    assert fair[2] > 0.7


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x y"), (None, "x"), (3, "x y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    model = tox.train(docs, labels, F.lit(True))
    out = tox.score_toxicity(docs.withColumn("score", F.lit(1)), model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert tox.train(docs, labels.limit(0), F.lit(True)) is None and tox.score_toxicity(docs.limit(0), None).count() == 0


def best_path(word, pieces, no_piece):
    w, best = " " + word, [(0.0, 0)]
    for e in range(1, len(w) + 1):
        b = (-1e18, 0)
        for s in range(e):
            if w[s:e] in pieces and best[s][0] + pieces[w[s:e]] > b[0]:
                b = (best[s][0] + pieces[w[s:e]], best[s][1] + 1)
        x = best[e - 1][0] + no_piece
        if x > b[0]:
            b = (x, best[e - 1][1] + len(w[e - 1].encode()))
        best.append(b)
    return best[-1][1]


@pytest.mark.parametrize("memory", [0, 5, 500_000])
def test_token_counts_against_brute_force(spark, memory):
    rng = random.Random(5)
    alphabet = "abé日"
    pieces = {c: -rng.uniform(3, 9) for c in " abé"} | {"".join(rng.choices(alphabet, k=rng.randint(2, 4))): -rng.uniform(1, 9) for _ in range(40)} | {" a": -1.0, " ab": -2.5}
    v = tc.Vocabulary.of({p.encode(): s for p, s in pieces.items()})
    texts = ["".join(rng.choices(alphabet + " \n😀", k=rng.randint(0, 60))) for _ in range(200)] + [None, "", " ", "ab" * 500]
    expect = [sum(best_path(w, pieces, v.no_piece) for w in re.split("[ \t\n\r\f\v]+", t or "") if w) for t in texts]
    counter = tc.Counter(v, memory)
    got = np.concatenate([counter(t)[1] for t in text_slices(pa.array(texts), lower=False, limit=300)])
    assert got.tolist() == expect
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    assert [r.n_tokens for r in tc.count_tokens(docs, v).orderBy("doc_id").collect()] == expect
    assert tc.count_tokens(docs.limit(0), v).count() == 0


def test_expected_counts_against_all_segmentations():
    pieces = {" ": -2.0, "a": -1.5, "b": -2.5, " a": -1.0, "ab": -1.2, " ab": -3.0, "ba": -2.2, "é": -2.0}
    v = tc.Vocabulary.of({p.encode(): s for p, s in pieces.items()})
    words, counts = ["ab", "abab", "é", "bé?a", "a"], [3, 1, 2, 5, 7]

    def paths(text):
        if not text:
            yield [], 0.0
        for k in range(1, len(text) + 1):
            for rest, s in paths(text[k:]):
                if text[:k] in pieces:
                    yield [text[:k], *rest], s + pieces[text[:k]]
                if k == 1:
                    yield rest, s + v.no_piece

    expect = dict.fromkeys(pieces, 0.0)
    for w, n in zip(words, counts):
        every = list(paths(" " + w))
        total = sum(np.exp(s) for _, s in every)
        for used, s in every:
            for p in used:
                expect[p] += n * np.exp(s) / total
    got = tc.expected_counts([w.encode() for w in words], np.array(counts), v) / tc.UNIT
    for p, n in expect.items():
        h = tc.span_hashes(np.frombuffer(p.encode(), np.uint8), np.array([0]), np.array([len(p.encode())]))
        assert abs(got[np.searchsorted(v.hashes, h[0])] - n) < 1e-3


def test_merge_ranks_are_not_added(spark, tmp_path):
    rows = [(1, "information university performance\n" * 20), (2, "performance"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tc.op9(spark, str(tmp_path)).collect()}
    assert got == {1: (60, 60), 2: (1, 1), 3: (0, 0)}
    assert tc.estimated(spark.createDataFrame([], "text string"), [b"a", b"b"]).scores.tolist() == [-np.log(2)] * 2
