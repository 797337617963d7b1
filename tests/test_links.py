"""Joins, links and components against brute force, with hot places, copies and date-line wraps."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohera.operators import graph as G, joins as J, reports as R


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def places(seed=0):
    """A hot town, chains, a cluster over the date line, polar points, scattered points."""
    rng = np.random.default_rng(seed)
    pts = [(52 + rng.normal(0, 0.02), 5 + rng.normal(0, 0.03)) for _ in range(150)]
    pts += [(10.0, 20.0 + i * 0.03) for i in range(20)]
    pts += [(-17 + rng.normal(0, 0.02), ((180 + rng.normal(0, 0.03) + 180) % 360) - 180) for _ in range(20)]
    pts += [(89.9, lon) for lon in (-170.0, -60.0, 10.0, 120.0)]
    pts += [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(60)]
    pts += [pts[0]] * 5
    return [(f"n{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(pts)]


@pytest.mark.parametrize("radius", [1.0, 5.0, 40.0])
def test_radius_links_give_the_components_of_all_close_pairs(spark, radius):
    pts = places()
    df = spark.createDataFrame(pts, "node string, lat double, lon double")
    links = G.radius_links(df, "node", "lat", "lon", radius).collect()
    close = [(a[0], b[0]) for a, b in itertools.combinations(pts, 2) if km(a[1:], b[1:]) <= radius]
    want = components([p[0] for p in pts], close)
    got = components([p[0] for p in pts], [(r.src, r.dst) for r in links])
    assert got == want
    assert len(links) < max(60, len(close))


def test_radius_links_stay_few_where_squares_hold_one_point_each(spark):
    rng = np.random.default_rng(4)
    pts = [(f"n{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 1, (400, 2)) * [2.0, 2.0] + [-1.0, 179.0])]
    pts = [(n, a, (b + 180) % 360 - 180) for n, a, b in pts]
    links = G.radius_links(spark.createDataFrame(pts, "node string, lat double, lon double"), "node", "lat", "lon", 25.0).collect()
    close = [(a[0], b[0]) for a, b in itertools.combinations(pts, 2) if km(a[1:], b[1:]) <= 25.0]
    names = [p[0] for p in pts]
    assert components(names, [(r.src, r.dst) for r in links]) == components(names, close) and len(links) < 500 < len(close)


def test_points_within_matches_brute_force(spark):
    pts = [p for p in places(1)]
    df = spark.createDataFrame(pts, "node string, lat double, lon double")
    got = {(min(r.node_a, r.node_b), max(r.node_a, r.node_b)) for r in J.points_within(df, ["node"], "lat", "lon", 30.0).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(pts, 2) if km(a[1:], b[1:]) <= 30.0}
    assert got == want


def test_components_on_chains_stars_and_copies(spark):
    rng = np.random.default_rng(7)
    edges = [(i, i + 1) for i in range(0, 120)] + [(500, i) for i in range(501, 900)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1300, (150, 2))]
    df = spark.createDataFrame([(int(a), int(b)) for a, b in edges if a != b], "src long, dst long")
    got = {r.node: r.component for r in G.connected_components(df).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == components(nodes, edges)


def test_star_edges_are_linear(spark):
    df = spark.createDataFrame([(i, "same" if i < 100 else str(i)) for i in range(150)], "id long, c string")
    e = G.star_edges(df, "id", F.col("c"), "r").collect()
    assert len(e) == 99 and {x.src for x in e} == {0}


def test_group_extent_matches_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(rng.uniform(-60, 60)), float(rng.uniform(-180, 180))) for g in range(4) for _ in range(60)]
    rows += [(9, float(45 + rng.normal(0, 0.5)), float(7 + rng.normal(0, 0.5))) for _ in range(80)] + [(10, 1.0, 1.0)]
    got = {r.g: r.extent_km for r in R.group_extent(spark.createDataFrame(rows, "g int, lat double, lon double"), "g", "lat", "lon").collect()}
    for g in got:
        pts = [r[1:] for r in rows if r[0] == g]
        want = max((km(a, b) for a, b in itertools.combinations(pts, 2)), default=0.0)
        assert got[g] == pytest.approx(want, abs=1e-3), g


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (30, 8))
    vecs = np.vstack([base, base[:10] + rng.normal(0, 0.003, (10, 8)), base[:5]])
    rows = [(i, i % 2 if i < 30 else (i - 30) % 10 % 2, v.tolist()) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "id int, k int, v array<double>")
    got = {(r.a, r.b) for r in J.near_duplicates(df, "id", "v", ["k"], 0.005).collect()}
    first = {}
    for i, k, v in rows:
        first.setdefault((k, tuple(v)), i)
    ids = sorted(first.values())
    want = {(a, b) for a, b in itertools.combinations(ids, 2) if rows[a][1] == rows[b][1] and np.sqrt(((vecs[a] - vecs[b]) ** 2).mean()) < 0.005}
    assert got == want and want


@pytest.mark.parametrize("tile_rows", [7, 40, 4096])
def test_near_duplicates_in_tiles_match_all_pairs(spark, tile_rows):
    """A block of several cells, one whose rows share their first component, small blocks, odd vectors."""
    rng = np.random.default_rng(8)
    vecs = rng.normal(0, 1, (260, 6))
    vecs[:60] += 1e6
    vecs[60:120, 0] = 0.25
    keys = [0] * 120 + [int(k) for k in rng.integers(1, 60, 140)]
    rows = [(i, k, v.tolist()) for i, (k, v) in enumerate(zip(keys, vecs))]
    odd = [(900, 0, [0.25] * 5), (901, 0, []), (902, 0, None), (903, 0, [0.25, None, 0.0, 0.0, 0.0, 0.0]), (904, 0, [float("inf")] * 6), (905, None, vecs[70].tolist())]
    df = spark.createDataFrame(rows + odd, "id int, k int, v array<double>").repartition(3)
    got = [(r.k, r.a, r.b, r.rms) for r in J.near_duplicates(df, "id", "v", ["k"], 0.9, tile_rows).collect()]
    rms = {(keys[a], a, b): np.sqrt(((vecs[a] - vecs[b]) ** 2).mean()) for a, b in itertools.combinations(range(260), 2) if keys[a] == keys[b]}
    want = {k: v for k, v in rms.items() if v < 0.9}
    assert len(got) == len(want) > 100 and all(d == pytest.approx(want[k, a, b], rel=1e-12) for k, a, b, d in got)


@pytest.mark.parametrize("tile_rows", [7, 40, 4096])
def test_near_duplicate_pairs_keep_copies_and_incomplete_vectors(spark, tile_rows):
    """A hot vector, copies of near ones, repeated ids, missing, infinite and absent components."""
    rng = np.random.default_rng(11)
    base = rng.normal(0, 1, (60, 6)).tolist()
    vecs = base + [base[0]] * 30 + base[:20] + [(np.array(v) + rng.normal(0, 0.1, 6)).tolist() for v in base[:20]]
    odd = [[0.25] * 5, [], None, [None] * 6, [None, *base[3][1:]], [*base[4][:5], None], [*base[5], 9.0], [float("inf"), *base[3][1:]], [float("nan")] * 6, [1e200] * 6, [1e200] * 6]
    rows = [(i, i % 3 and 1, v) for i, v in enumerate(vecs)] + [(500 + i, k, v) for i, v in enumerate(odd) for k in (0, 1)]
    rows += [(3, 0, base[3]), (3, 0, base[3]), (None, 0, base[3]), (900, None, base[3])]
    df = spark.createDataFrame(rows, "id int, k int, v array<double>").repartition(3)
    got = [(r.k, r.a, r.b, round(r.rms, 9)) for r in J.near_duplicate_pairs(df, "id", "v", ["k"], 0.5, 6, tile_rows).collect()]

    def rms(v, w):
        d = [(p - q) * (p - q) for p, q in zip(v or [], w or []) if p is not None and q is not None]
        return math.sqrt(sum(d) / 6) if d else math.nan

    known = [r for r in rows if None not in r[:2]]
    want = [(p[1], p[0], q[0], round(rms(p[2], q[2]), 9)) for p, q in itertools.product(known, known) if p[1] == q[1] and p[0] < q[0] and rms(p[2], q[2]) < 0.5]
    assert sorted(got) == sorted(want) and sum(w[3] == 0 for w in want) > 200


def test_checked_joins_fail_on_repeated_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, w string")
    assert J.join_many_to_one(a, b.where("w='p'"), ["k"]).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        J.join_many_to_one(a, b, ["k"]).collect()


def test_majority_breaks_ties_on_value(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("h", "z"), ("h", "z"), ("h", "a"), ("h", None)], "g string, v string")
    got = {r.g: (r.majority, r.n_values) for r in G.majority(df, "g", "v").collect()}
    assert got == {"g": ("a", 2), "h": ("z", 2)}


def test_spans_join_across_days(spark):
    rows = [("a", "2024-01-01 23:00:00", "2024-01-02 02:00:00"), ("a", "2024-01-02 01:00:00", "2024-01-02 03:00:00"),
            ("a", "2024-01-02 03:00:00", "2024-01-02 04:00:00"), ("a", "2024-01-05 00:00:00", "2024-01-05 01:00:00"),
            ("a", "2024-01-01 22:00:00", "2024-01-01 22:30:00")]
    df = spark.createDataFrame(rows, "k string, s string, e string").selectExpr("k", "cast(s as timestamp_ntz) s", "cast(e as timestamp_ntz) e")
    got = R.coalesce_spans(df, ["k"], "s", "e").orderBy("block_start").collect()
    assert [r.n_spans for r in got] == [1, 3, 1]
    assert str(got[1].block_end) == "2024-01-02 04:00:00"
