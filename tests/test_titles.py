"""Title matches against all pairs: typos in the first word, a leading article, crowded grams, ties."""

import random

import pytest

from cohera.operators.titles import best_matches, gram_size


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(titles, refs, least):
    out = {}
    for t in {t for t in titles if t is not None}:
        best = min(((-(1.0 - distance(t, r) / max(len(t), len(r), 1)), r) for r in {r for r in refs if r is not None}), default=None)
        if best and -best[0] >= least:
            out[t] = (best[1], -best[0])
    return out


def run(spark, titles, refs, least, **more):
    t = spark.createDataFrame([(x,) for x in titles], "title string").repartition(3)
    r = spark.createDataFrame([(x,) for x in refs], "ref string").repartition(3)
    return {x.title: (x.ref, pytest.approx(x.ratio)) for x in best_matches(t, r, least, **more).collect()}


REFS = ["deep coverage of group intervals", "a survey of water colour", "on the beta law", "beta", "", "aaaa aaaa", "interval", None, "the the the"]
TITLES = ["deap coverage of group intervals", "the deep coverage of group intervals", "survey of water colour", "on beta law", "bata", "", "a", None, "aaaa aaab", "zzz", "thethethe"]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.6, 0.9, 1.0])
def test_known_titles(spark, least):
    assert run(spark, TITLES, REFS, least) == brute(TITLES, REFS, least)


@pytest.mark.parametrize("posting,steps", [(20_000, (0.85, 0.7)), (3, (0.8,)), (2, ())])
def test_random_titles(spark, posting, steps):
    rng = random.Random(posting)
    word = lambda: "".join(rng.choice("abe ") for _ in range(rng.randrange(0, 12)))
    refs = [word() for _ in range(60)]
    titles = [word() for _ in range(30)]
    for r in rng.sample(refs, 30):
        i = rng.randrange(len(r) + 1)
        titles.append(r[:i] + rng.choice("abz") + r[i + rng.randrange(2) :])
    assert run(spark, titles, refs, 0.6, posting=posting, steps=steps) == brute(titles, refs, 0.6)


def test_nothing_to_match(spark):
    assert run(spark, [], REFS, 0.6) == {} and run(spark, TITLES, [], 0.6) == {}
    with pytest.raises(ValueError):
        run(spark, TITLES, REFS, 0.0)
    assert [gram_size(x) for x in (0.3, 0.5, 0.7, 0.85, 1.0)] == [1, 2, 3, 4, 4]
