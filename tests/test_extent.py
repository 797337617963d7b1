"""The longest distance of a group by outlines equals that of all pairs; few points of a large group are compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohera.operators import reports


def unit(lat, lon):
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


def longest(lat, lon):
    v = unit(lat, lon)
    d2 = ((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2).max()
    return 2 * 6371.0088 * np.arcsin(np.sqrt(min(1.0, d2 / 4)))


@pytest.mark.parametrize("batch", [50, 10_000])
def test_extent_equals_all_pairs(spark, batch):
    rng = np.random.default_rng(4)
    groups = {}
    for name, (lat, lon, spread) in {"disk": (50, 179.9, 3.0), "pole": (89, 10, 2.0), "wide": (0, 0, 85.0), "tiny": (-30, 20, 1e-7), "cap": (10, -60, 38.0)}.items():
        t, r = rng.uniform(0, 2 * np.pi, 700), spread * np.sqrt(rng.uniform(0, 1, 700))
        groups[name] = np.clip(lat + r * np.sin(t), -90, 90), (lon + r * np.cos(t) + 180) % 360 - 180
    groups["rim"] = 20 + 5 * np.sin(np.arange(400)), 20 + 5 * np.cos(np.arange(400))
    groups["line"] = np.full(200, 0.0), np.linspace(0, 40, 200)
    groups["one"] = np.full(90, 12.5), np.full(90, 7.25)
    rows = [(g, float(a), float(o)) for g, (lat, lon) in groups.items() for a, o in zip(lat, lon)] + [(None, 0.0, 0.0), ("one", None, 3.0), ("none", None, None)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, str(batch))
    try:
        got = {r.g: r.extent_km for r in reports.group_extent(spark.createDataFrame(rows, "g string, lat double, lon double"), "g", "lat", "lon").collect()}
    finally:
        spark.conf.set(key, old)
    assert got.keys() == groups.keys()
    for g, (lat, lon) in groups.items():
        assert got[g] == pytest.approx(longest(lat, lon), rel=1e-9, abs=1e-7), g


def test_few_points_of_a_large_group_are_left(spark):
    n = 200_000
    t, r = F.rand(1) * 2 * np.pi, F.sqrt(F.rand(2))
    rows = spark.range(n).select(F.lit(7).alias("g"), (40 + r * F.sin(t)).alias("lat"), (5 + r * F.cos(t)).alias("lon"))
    la, lo = F.radians("lat"), F.radians("lon")
    rows = rows.select("g", (F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))
    c = unit(np.array([40.0]), np.array([5.0]))[0]
    rows = rows.select("*", *[F.lit(float(v)).alias(f"c{k}") for k, v in zip("xyz", c)], F.lit(True).alias("narrow"))
    assert 3 <= reports._outline(rows, "g").count() < 400


def test_empty_table(spark):
    assert reports.group_extent(spark.createDataFrame([], "g string, lat double, lon double"), "g", "lat", "lon").count() == 0
