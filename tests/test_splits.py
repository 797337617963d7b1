"""Splits and folds: sizes, leakage, order invariance, brute-force checks of the sequential rules."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohera.operators import splits as T


def frame(spark, n_groups=83, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        size = 600 if g == 0 else (50 if rng.random() < 0.1 else int(rng.integers(1, 4)))
        rows += [(f"g{g:03d}", f"u{g % 7}", f"r{g % 4}") for _ in range(size)]
    pdf = pd.DataFrame(rows, columns=["g", "u", "r"])
    pdf["id"] = range(len(pdf))
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_group_split_sizes_and_leakage(spark):
    pdf, df = frame(spark)
    s = T.group_split(df, {"group": "g"}, [0, 1])
    n = s.groupBy("seed", "role").agg(F.count_distinct("g").alias("n")).toPandas().pivot(index="seed", columns="role", values="n")
    t = math.ceil(0.2 * 83)
    assert (n.test == t).all() and (n.cal == math.ceil(0.25 * (83 - t))).all()
    assert T.leakage(s, "g").count() == 0
    assert T.leakage(s, "u").count() > 0
    assert s.where("seed = 0").count() == len(pdf)


def test_split_does_not_depend_on_row_order(spark):
    pdf, df = frame(spark)
    a = T.group_split(df, {"group": "g"}, [3]).select("id", "role").toPandas().set_index("id").role.sort_index()
    b = T.group_split(spark.createDataFrame(pdf.sample(frac=1, random_state=1)), {"group": "g"}, [3]).select("id", "role").toPandas()
    assert (a == b.set_index("id").role.sort_index()).all()


def test_leave_unit_out_is_pure(spark):
    _, df = frame(spark)
    s = T.leave_unit_out(df, "r", "g", [0, 1], "region", always_descriptive=("r1",))
    c = T.split_checks(s, "id", ["g"], unit="r").toPandas()
    assert len(c) == 8
    for col in ("repeated_ids", "missing_roles", "test_outside_unit", "unit_outside_test", "leaks_g"):
        assert (c[col] == 0).all(), col
    d = s.select("test_unit", "descriptive_only").distinct().toPandas().set_index("test_unit").descriptive_only
    assert d["r1"] and not d["r2"]


def test_balanced_folds_follow_the_greedy_rule(spark):
    pdf, df = frame(spark)
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    got = T.balanced_folds(sizes, "g", [0], 5, jitter=False).toPandas()
    want, load = {}, np.zeros(5)
    order = pdf.groupby("g").size().reset_index(name="n").sort_values(["n", "g"], ascending=[False, True])
    for g, n in order.itertuples(index=False):
        f = int(np.argmin(load))
        want[g] = f
        load[f] += n
    assert dict(zip(got.unit, got.fold)) == want


@pytest.mark.parametrize("k,sizes", [(5, None), (3, [1] * 50 + [2] * 3 + [40]), (4, [100, 1, 1, 1, 7, 7, 7, 7, 7, 3]), (5, [9, 9])])
def test_row_balanced_folds_follow_the_greedy_rule(spark, k, sizes):
    from cohera.operators.balance import row_balanced_folds

    rng = np.random.default_rng(k)
    pdf = pd.concat([pd.DataFrame({"s": s, "g": np.repeat(np.arange(len(n)), n)}) for s in (0, 1) for n in [sizes or rng.integers(1, 12, 90)]])
    got = row_balanced_folds(spark.createDataFrame(pdf).repartition(4), ["s"], "g", k).toPandas()
    for s, d in pdf.groupby("s"):
        want, load = {}, np.zeros(k)
        order = d.groupby("g").size().reset_index(name="n").sort_values(["n", "g"], ascending=[False, True])
        for g, n in order.itertuples(index=False):
            want[g] = int(np.argmin(load))
            load[want[g]] += n
        part = got[got.s == s]
        assert dict(zip(part.g, part.fold)) == want


def test_fill_calibration_rule(spark):
    rng = np.random.default_rng(4)
    units = pd.DataFrame({"seed": np.repeat([0, 1, 2], 12), "unit": [f"u{i}" for i in range(12)] * 3, "n": rng.integers(1, 60, 36)})
    got = T.fill_calibration(spark.createDataFrame(units).withColumn("seed", F.col("seed").cast("int")), ["seed"]).toPandas()
    from hashlib import md5

    for seed, part in units.groupby("seed"):
        key = {u: int(md5(f"fill|{seed}|{u}".encode()).hexdigest()[:13], 16) for u in part.unit}
        pool, acc, taken = part.n.sum(), 0, set()
        for u, n in sorted(zip(part.unit, part.n), key=lambda x: key[x[0]]):
            if acc >= 0.25 * pool:
                break
            if acc + n <= 0.35 * pool:
                taken.add(u)
                acc += n
        assert set(got[(got.seed == seed) & got.is_cal].unit) == taken


def test_calibration_falls_back_to_the_smallest_unit(spark):
    u = spark.createDataFrame([(0, "a", 50), (0, "b", 49)], "seed int, unit string, n long")
    got = T.fill_calibration(u, ["seed"]).where("is_cal").collect()
    assert [r.unit for r in got] == ["b"]


def test_fill_calibration_with_large_units_and_many_seeds(spark):
    """Skipped large units, small ones after them, and pools where nothing fits, against the sequential rule."""
    import hashlib

    rng = np.random.default_rng(9)
    sizes = {s: [int(v) for v in (rng.integers(1, 9, 40).tolist() + rng.integers(30, 120, 4).tolist())[: [44, 44, 44, 2, 1, 3, 44, 10][s]]] for s in range(8)}
    sizes[6][:3] = [500, 200, 90]
    rows = [(s, f"u{i}", n) for s, x in sizes.items() for i, n in enumerate(x)]
    got = {(r.seed, r.unit): r.is_cal for r in T.fill_calibration(spark.createDataFrame(rows, "seed int, unit string, n long").repartition(4), ["seed"]).collect()}
    want = {}
    for s, x in sizes.items():
        order = sorted(((int(hashlib.md5(f"fill|{s}|u{i}".encode()).hexdigest()[:13], 16), f"u{i}", n) for i, n in enumerate(x)))
        pool, acc, taken = sum(x), 0, set()
        for _, u, n in order:
            if acc < 0.25 * pool and acc + n <= 0.35 * pool:
                acc, taken = acc + n, taken | {u}
        taken = taken or {next(u for _, u, n in order if n == min(x))}
        want |= {(s, u): u in taken for _, u, _ in order}
    assert got == want


def test_contributor_folds_with_leak_removal(spark):
    _, df = frame(spark)
    mixed = df.withColumn("src", F.when(F.col("id") % 37 == 0, "u0").otherwise(F.col("u")))
    s = T.contributor_folds(mixed, "src", "g", [0], "contributor", min_test=10, drop_leaks=True)
    s = s.withColumn("descriptive_only", F.lit(False))
    assert T.leakage(s, "g").count() == 0
    per_fold = s.groupBy("fold").count().toPandas()
    assert (per_fold["count"] == mixed.count()).all()
    assert s.where("role = 'dropped'").count() > 0
    nested = T.contributor_folds(df, "u", "g", [0], "contributor")
    assert T.leakage(nested.withColumn("descriptive_only", F.lit(False)), "u").count() == 0


def test_unit_folds_differ_by_at_most_one(spark):
    _, df = frame(spark)
    rows = df.withColumn("seed", F.lit(0))
    n = T.unit_folds(rows, ["seed"], "g", 10).groupBy("fold").count().toPandas()["count"]
    assert len(n) == 10 and n.max() - n.min() <= 1 and n.sum() == 83
    e = T.unit_folds(rows, ["seed"], "g", 10, exact=True).groupBy("fold").count().toPandas()["count"]
    assert (e == 8).all()


def test_holdout_size_and_draws(spark):
    pdf, df = frame(spark)
    h = T.random_holdout(df.withColumn("seed", F.lit(0)), ["seed"], "id")
    assert h.where("held").count() == round(0.2 * len(pdf))
    groups = df.select("g").distinct().withColumn("seed", F.lit(0))
    d = T.group_draws(groups, ["seed"], "g", [10, 40, 100], 3).groupBy("n_target", "draw").count().toPandas()
    assert set(d.n_target) == {"10", "40", "all"}  # 100 groups do not exist
    assert (d[d.n_target == "10"]["count"] == 10).all() and (d[d.n_target == "all"]["count"] == 83).all()


def test_seed_ranges():
    assert T.parse_seed_range("0-3,7") == [0, 1, 2, 3, 7]
    assert T.parse_seed_range("all") is None


def test_leaks_are_found_on_pairs_of_unit_and_group_not_on_repeated_rows(spark, monkeypatch):
    rows = [(i, f"u{(i * 7 + i // 60) % 12}", f"g{i % 30}" if i % 11 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, unit string, grp string")
    sizes, real = [], T._drop_leaks

    def counted(x, group):
        sizes.append((x.count(), df.select("unit", "grp").distinct().count()))
        return real(x, group)

    monkeypatch.setattr(T, "_drop_leaks", counted)
    got = T.contributor_folds(df, "unit", "grp", [0, 1], "p", k=3, min_test=1, drop_leaks=True).collect()
    assert sizes[0][0] <= sizes[0][1] * 2 * 3  # a row for each pair, seed and fold
    plain = T.contributor_folds(df, "unit", "grp", [0, 1], "p", k=3, min_test=1).where("grp IS NOT NULL").collect()
    seen = {}
    for r in plain:
        seen.setdefault((r.seed, r.fold, r.grp), set()).add(r.role)
    want = set()
    for r in plain:
        here = seen[r.seed, r.fold, r.grp]
        lost = r.role != "test" and "test" in here or r.role == "cal" and "train" in here
        want.add((r.id, r.seed, r.fold, "dropped" if lost else r.role))
    assert len(got) == len(want) and {(r.id, r.seed, r.fold, r.role) for r in got} == want
