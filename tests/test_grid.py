"""Joins of points on grid cells, against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shapeloom.operators import network

RADIUS = 6371008.8


def apart(p, q):
    a, b, c, d = map(math.radians, (*p, *q))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(h)))


def points(rng, lat, lon, n, metres):
    """Points some reaches around a place, dense enough to have neighbours, over a pole or 180 degrees where it lies there."""
    made = []
    for _ in range(n):
        y = lat + math.degrees(rng.uniform(-4, 4) * metres / RADIUS)
        x = lon + math.degrees(rng.uniform(-4, 4) * metres / RADIUS / max(math.cos(math.radians(lat)), 0.02))
        made.append((max(-90.0, min(90.0, y)), (x + 180) % 360 - 180))
    return made


@pytest.mark.parametrize(
    ("lat", "lon", "spread"), [(0, 10, "left"), (24, 120.6, "right"), (36, -5, "left"), (60, 25, "left"), (60, 25, "right"), (-60, 25, "right"), (89.99, 0, "left"), (-33, 179.999, "right"), (64, -180, "left")]
)
def test_pairs_within_reach_at_every_latitude(spark, lat, lon, spread):
    rng, metres = random.Random(11), 600.0
    left, right = (points(rng, lat, lon, 120, metres) for _ in range(2))
    frame = lambda rows, names: spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], f"{names[0]} long, {names[1]} double, {names[2]} double")
    got = network.within(frame(left, ("i", "lat", "lon")), frame(right, ("j", "rlat", "rlon")), metres, spread=spread).select("i", "j").collect()
    want = {(i, j) for i, p in enumerate(left) for j, q in enumerate(right) if apart(p, q) <= metres}
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want and len(want) > 100


def test_reaches_of_all_sizes(spark):
    """A reach around half of the earth, exact neighbours to the north, and places without coordinates."""
    left = spark.createDataFrame([(0, 10.0, 20.0), (1, -80.0, -170.0), (2, None, 3.0)], "i long, lat double, lon double")
    right = spark.createDataFrame([(0, 80.0, 170.0), (1, 10.0 + math.degrees(600 / RADIUS) * (1 - 1e-12), 20.0), (2, 4.0, None)], "j long, rlat double, rlon double")
    far = network.within(left, right, 2.1e7).select("i", "j").collect()
    assert sorted(map(tuple, far)) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert [tuple(r) for r in network.within(left, right, 600.0).select("i", "j").collect()] == [(0, 1)]
    near = network.nearest_at_any_distance(left.where("lat is not null"), "i", right.where("rlon is not null").select(F.col("j").alias("id"), F.col("rlat").alias("lat"), F.col("rlon").alias("lon")), 500.0)
    assert {r.i: r.node for r in near.collect()} == {0: 1, 1: 1}


@pytest.mark.parametrize(("lat", "lon"), [(24, 120.6), (60, 25), (89.99, 0), (-33, 179.999)])
def test_nearest_of_many_against_all_pairs(spark, lat, lon):
    """Points that look once, that look farther and that find nothing; nodes at one place, repeated points, no coordinates."""
    rng, reach, first = random.Random(5), 600.0, 150.0
    nodes = points(rng, lat, lon, 60, reach)
    nodes = [*nodes, nodes[0], nodes[7]]
    asked = [*points(rng, lat, lon, 150, reach * 1.5), nodes[0], nodes[7], nodes[7]]
    rows = [*((f"p{i % 100}", i, *p) for i, p in enumerate(asked)), ("none", -1, None, 1.0)]
    # the later a node the smaller its id, so that the smallest id at a place is not the first
    table = spark.createDataFrame([(1000 - k, *p) for k, p in enumerate(nodes)] + [(1, None, None)], "id long, lat double, lon double")
    found, scratch = network.nearest_of_many(spark.createDataFrame(rows, "key string, i long, lat double, lon double"), table, reach, first)
    got = {(r.key, r.i): (r.node, round(r.d, 6)) for r in found.collect()}
    want = {}
    for i, p in enumerate(asked):
        d, node = min((round(apart(p, q), 6), 1000 - k) for k, q in enumerate(nodes))
        if d <= reach:
            want[f"p{i % 100}", i] = node, d
    assert {k: d for k, (_, d) in got.items()} == {k: d for k, (_, d) in want.items()} and 0 < len(want) < len(asked)
    # at the pole itself all longitudes are one place, but for rounding
    assert all(round(apart(asked[k[1]], nodes[1000 - node]), 6) == d for k, (node, d) in got.items()) and (lat > 89 or got == want)
    assert any(d > first for _, d in want.values()) and (lat > 89 or got["p50", 150][0] == 1000 - 60)
    network.discard(scratch)


def test_nearest_of_many_without_rows(spark):
    nothing = spark.createDataFrame([], "id long, lat double, lon double")
    one = spark.createDataFrame([(1, 2.0, 3.0)], "id long, lat double, lon double")
    for points_, nodes in ((nothing, one), (one, nothing), (nothing, nothing)):
        assert network.nearest_of_many(points_.withColumnRenamed("id", "i"), nodes, 600.0, 150.0)[0].collect() == []
