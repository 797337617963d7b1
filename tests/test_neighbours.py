"""Exact neighbour distances against all pairs, and how few of the pairs are computed."""

import numpy as np
import pytest

from cohera.operators.neighbours import Neighbours, knn_mean_distance


def tables(spark, x, test):
    rows = [(s, i, v.tolist(), bool(t)) for s in (0, 1) for i, (v, t) in enumerate(zip(x, np.roll(test, s)))]
    df = spark.createDataFrame(rows, "seed int, id int, v array<double>, t boolean").repartition(4)
    return df.where("not t"), df.where("t")


def brute(x, test, k):
    out = {}
    for s in (0, 1):
        t = np.roll(test, s)
        scale = x[~t].std(0)
        z = (x - x[~t].mean(0)) / np.where(scale == 0, 1.0, scale)
        for i in np.flatnonzero(t):
            out[s, int(i)] = np.sort(np.sqrt(((z[~t] - z[i]) ** 2).sum(1)))[:k].mean()
    return out


RNG = np.random.default_rng(6)
CASES = {
    "plain": RNG.normal(0, 1, (120, 5)) * [1, 5, 0.1, 2, 1],
    "clusters": RNG.normal(0, 20, (12, 3))[RNG.integers(0, 12, 400)] + RNG.normal(0, 0.2, (400, 3)),
    "copies, constant component": np.concatenate([np.tile([[1.0, 2.0]], (150, 1)), RNG.normal(0, 1, (50, 2)), np.tile([[3.0, 2.0]], (20, 1))]) * [1, 0] + [0, 7],
    "fewer than k": RNG.normal(0, 1, (6, 2)),
}


@pytest.mark.parametrize("cell_rows,pivots", [(4096, 512), (20, 30), (7, 3), (16, 1)])
@pytest.mark.parametrize("case", CASES)
def test_against_all_pairs(spark, case, cell_rows, pivots):
    if cell_rows == 7 and case == "plain":
        pytest.skip("covered by the others")
    x = CASES[case]
    test = np.arange(len(x)) % 4 == 0
    train, asked = tables(spark, x, test)
    got = {(r.seed, r.id): r.dist for r in knn_mean_distance(train, asked, ["seed"], "id", "v", 5, cell_rows, pivots).collect()}
    want = brute(x, test, 5)
    assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key], rel=1e-9, abs=1e-12) for key in want)


def test_far_cells_are_not_visited(spark):
    x = CASES["clusters"]
    test = np.arange(len(x)) % 4 == 0
    n = Neighbours(*tables(spark, x, test), ["seed"], "id", "v", 5, cell_rows=10, pivots=40)
    sizes = {(r.seed, r.cell): r.n for r in n.cells.collect()}
    pairs = sum(sizes[r.seed, r.cell] for visits in (n.first, n.second) for r in visits.collect())
    assert pairs < 0.25 * 2 * test.sum() * (~test).sum()


def test_lots_of_cells_tiles_and_parts(spark, monkeypatch):
    """A row far from zero loses no digits in the products; lots of few cells, several parts, at most one trip per lot."""
    from cohera.operators import neighbours

    monkeypatch.setattr(neighbours, "LOT_CELLS", 2)
    monkeypatch.setattr(neighbours, "GUESTS", 9)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (150, 3)), 1e7 + rng.normal(0, 1e-3, (40, 3)), np.tile([[0.5, 0.5, 0.5]], (30, 1))])
    test = np.arange(len(x)) % 4 == 0
    train, asked = tables(spark, x, test)
    got = {(r.seed, r.id): r.dist for r in knn_mean_distance(train, asked, ["seed"], "id", "v", 5, 12, 40).collect()}
    want = brute(x, test, 5)
    assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key], rel=1e-7, abs=1e-12) for key in want)


def test_block_distances_equal_pair_by_pair():
    from cohera.operators.distances import Known, distances, nearest

    rng = np.random.default_rng(1)
    x, y = 1e6 + rng.normal(0, 1, (300, 7)), 1e6 + rng.normal(0, 1, (9000, 7))
    copies = rng.integers(1, 4, len(y))
    got = nearest(x, Known(y), copies, np.full((300, 5), np.inf), np.full(300, np.inf), 10, 8990)
    want = np.sort(np.repeat(distances(x, y[10:8990]), copies[10:8990], axis=1), axis=1)[:, :5]
    assert np.array_equal(got, want)


def test_no_rows(spark):
    x = np.ones((3, 2))
    train, asked = tables(spark, x, np.zeros(3, bool))
    assert knn_mean_distance(train, asked, ["seed"], "id", "v").count() == 0
    assert knn_mean_distance(asked, train, ["seed"], "id", "v").count() == 0
