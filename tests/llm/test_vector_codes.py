"""Codes, errors and codebooks against plain loops over exact integers; cells give the nearest entry for any point."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohera.llm.registry import QUERIES, table
from cohera.llm.vector_codes import Cells, vector_codes
from tests.conftest import SF


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, lab, v) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[max(-(2**62), min(2**62, math.floor(scale * x))) for x in v] for _, _, v in kept]
    width = max(1, -(-max(map(len, whole), default=0) // parts))
    whole = [v + [0] * (width * parts - len(v)) for v in whole]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, whole[k]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(whole[k], p) for k in order] for p in range(parts)]
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (dist(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        chosen = [[near(v, p) for v in whole] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for v, c in zip(whole, chosen[p]) if c == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, lab, [near(v, p) for p in range(parts)], min(2**63 - 1, sum(dist(cut(v, p), books[p][near(v, p)]) for p in range(parts)))) for (i, lab, _), v in zip(kept, whole)]
    sums = {}
    for _, lab, _, e in out:
        sums[lab] = sums.get(lab, 0) + e
    return sorted([(i, lab, bytes(c), e, min(2**63 - 1, sums[lab])) for i, lab, c, e in out], key=str), books


def run(spark, rows, kind="array<double>", **more):
    df = spark.createDataFrame([(i, v, lab, 0) for i, v, lab in rows], f"vec_id long, embedding {kind}, label int, vec int")
    out, books = vector_codes(df.repartition(3), **more)
    got = sorted([(r.id, r.label, bytes(r.code), r.error, r.label_error) for r in out.collect()], key=str)
    return got, [b.tolist() for b in books]


RNG = np.random.default_rng(1)


def _random(n, dim, spread=1.0):
    return [(int(i), (RNG.normal(size=dim) * spread).tolist(), int(i) % 3 if i % 5 else None) for i in RNG.permutation(n)]


CASES = {
    "plain": (_random(60, 16), {}),
    "coarse, with ties": ([(i, (RNG.integers(-2, 3, 8) / 4096).tolist(), i % 2) for i in range(80)], {}),
    "copies": ([(i, [0.5] * 16, 7) for i in range(40)] + _random(10, 16), {}),
    "few": (_random(3, 8), {}),
    "one wide part": (_random(30, 5), {"parts": 1, "entries": 4, "rounds": 2}),
    "broken rows": ([(1, None, 1), (2, [1.0, None] * 4, 1), (3, [float("nan")] * 8, 1), (4, [float("inf")] * 8, 2), (None, [0.25] * 8, None), (5, [0.1] * 8, 1), (5, [0.2] * 8, 1)], {}),
    "lengths": ([(1, [], 1), (2, [0.5] * 3, 1), (3, [0.5] * 9, 2), (4, [-0.5] * 16, 2)], {}),
    "huge": ([(i, [1e300 * (-1) ** i, 1e12 * i, 3.0e5, -7.0e8 * i] * 4, 1) for i in range(20)], {"rounds": 2}),
}


@pytest.mark.parametrize("case", CASES)
def test_against_loops(spark, case):
    rows, more = CASES[case]
    want, books = brute(rows, **more)
    got, got_books = run(spark, rows, **more)
    assert got_books == books and got == want


def test_query_table_against_loops(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table(spark, SF, "embeddings").limit(60).collect()]
    want, books = brute(rows)
    got, got_books = run(spark, rows, "array<float>")
    assert got_books == books and got == want
    out = QUERIES["op12_vector_codes"](spark, SF)
    assert out.count() == table(spark, SF, "embeddings").count() and out.where(F.length("code") != 16).count() == 0


def test_cells_keep_every_nearest_entry_and_drop_others():
    book = RNG.integers(-3000, 3000, (16, 4))
    x = RNG.integers(-4000, 4000, (5000, 4))
    d = ((x[:, None, :] - book) ** 2).sum(axis=2)
    for memory in (0, 50, 10_000):
        c = Cells(book, memory)
        for part in np.array_split(x, 7):
            index, error = c.nearest(part)
            at = ((part[:, None, :] - book) ** 2).sum(axis=2)
            assert (index == at.argmin(axis=1)).all() and (error == at.min(axis=1)).all()
        assert len(c.keys) <= memory
    cells = np.unique(x >> c.shift, axis=0)
    assert c.candidates(cells).mean() < 0.5 and (c.candidates(cells) == c.candidates(cells, exact=False)).all()
    assert d.shape == (5000, 16)


def test_equal_hashes_of_cells_are_told_apart(monkeypatch):
    import cohera.llm.vector_codes as m

    monkeypatch.setattr(m, "mix", lambda v: v & np.uint64(1))
    book = RNG.integers(-300, 300, (8, 2))
    c = Cells(book)
    for x in np.array_split(RNG.integers(-400, 400, (600, 2)), 5):
        d = ((x[:, None, :] - book) ** 2).sum(axis=2)
        assert (c.nearest(x)[0] == d.argmin(axis=1)).all()


def test_no_vectors(spark):
    got, books = run(spark, [])
    assert got == [] and run(spark, [(1, None, 2)])[0] == []
