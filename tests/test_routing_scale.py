"""Routing over a large network: what a few routes need does not go over all roads again and again."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_components import plain
from test_paths import check, grid
from test_paths import network as prepared

from shapeloom.operators import components, network, paths, planner
from shapeloom.plans.fixtures import SAFETY


def test_components_of_ranges_against_a_plain_table(spark, monkeypatch):
    """Streets of near ids, a long path, random parts, a star of far ids, nulls, loops and repeats."""
    rng = random.Random(7)
    streets = [(k, k + d) for k in range(3_000) for d in (1, 50) if rng.random() < 0.7]
    mixed = [(rng.randrange(5_000, 5_900), rng.randrange(5_000, 5_900)) for _ in range(500)]
    edges = [*streets, *((k + 1, k) for k in range(7_000, 7_400)), *mixed, *((9_000, k) for k in range(3_500, 3_900)), (5, 5), (None, 2), (2, None), (8_000, 8_000), *streets[:9]]
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(9)
    monkeypatch.setattr(components, "SLICE", 256)
    assert sorted(map(tuple, components.components_of_ranges(frame, "a", "b").collect())) == plain(edges)
    assert components.components_of_ranges(frame.where("false"), "a", "b").collect() == []


def test_only_ties_of_ranges_go_through_rounds(spark, monkeypatch):
    seen, real = [], components.connected_components
    monkeypatch.setattr(components, "connected_components", lambda ties, *ends: seen.append(ties.count()) or real(ties, *ends))
    edges = spark.range(20_000).selectExpr("id as a", "id + 1 as b").repartition(7)
    assert network.components(edges).groupBy("component").count().collect() == [(0, 20_001)]
    assert len(seen) == 1 and seen[0] < 20


@pytest.mark.parametrize("metres", [104.0, 2_000.0, 3.0e6])
def test_cells_beside_hold_all_cells_around(spark, metres):
    rng = random.Random(3)
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)] + [(rng.uniform(89.9, 90), rng.uniform(-180, 180)) for _ in range(100)]
    places += [(24.0, 180.0), (24.0, -180.0), (90.0, 0.0), (-90.0, 7.0), (0.0, 0.0)]
    cells = spark.createDataFrame(places, "lat double, lon double").select(network.own_cell(F.col("lat"), F.col("lon"), metres).alias("own"), network.cells_around(F.col("lat"), F.col("lon"), metres).alias("around"))
    missed = cells.where(F.size(F.array_except("around", network.cells_beside(F.col("own"), metres))) > 0)
    assert missed.count() == 0


def test_near_pairs_need_no_cells_of_the_whole_network(spark):
    place, roads = grid(12, 150.0)
    net = prepared(spark, place, roads)
    asked = [(0, 5), (14, 60), (70, 71)]
    check(paths.route_legs(spark.createDataFrame(asked, "a long, b long"), net).collect(), place, roads, asked)
    assert not {"places", "arcs"} & set(net.__dict__) and "cells" not in net.roads.columns
    net.discard()


def test_nodes_far_from_all_points_are_not_dealt_out(spark, monkeypatch):
    """Candidates lie in few places: nodes elsewhere don't wait in cells."""
    dealt, real = [], network.by_cell
    monkeypatch.setattr(network, "by_cell", lambda places, metres: dealt.append(places.count()) or real(places, metres))
    place = {k: (24.0 + (k // 20) * 1e-2, 120.6 + (k % 20) * 1e-4) for k in range(4_000)}
    net = prepared(spark, place, [(0, 1, 20.0, 20.0)])
    ring = [(24.0, 120.6), (24.01, 120.6), (24.01, 120.601), (24.0, 120.601)]
    points = spark.createDataFrame([("k", i, 0, *p) for i, p in enumerate(ring)], "key string, i int, j long, lat double, lon double")
    assert planner.snap(points, net).first().stops == [0, 20, 30, 10, 0]
    assert dealt and max(dealt) <= 100
    net.discard()


def test_a_rule_of_safety_names_the_one_before_once(spark):
    columns = ("hw", "name", "foot", "sidewalk", "lanes")
    made = network.road_safety(*(F.col(c) for c in columns))
    assert str(made).lower().count("rlike") == 1

    def safe(hw, name, foot, sidewalk, lanes):
        s = SAFETY.get(hw, 0.5)
        s = max(s, 0.95) if name and "綠道" in name else s
        s = min(1.0, s + 0.05) if foot in ("designated", "yes") else s
        s = min(1.0, s + 0.08) if sidewalk in ("both", "left", "right", "yes") else s
        s = max(0.05, s - 0.12) if sidewalk == "no" else s
        s = max(0.05, s - 0.10) if lanes in ("4", "6;2") else s
        return min(1.0, max(0.02, s))

    rows = list(itertools.product(("path", "primary", "steps", "other", None), ("綠道一", "x", None), ("yes", "no", None), ("both", "no", "", None), ("4", "6;2", "2", "x", None)))
    got = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).select(*columns, made.alias("s")).collect()
    assert len(got) == len(rows) and all(r.s == safe(*r[:5]) for r in got)


def test_roads_of_a_network_are_measured_once(spark, monkeypatch):
    from shapeloom.plans import plan_queries

    plans, real = [], plan_queries.written
    monkeypatch.setattr(plan_queries, "written", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, label))
    net = plan_queries.network(spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and sum("ArrowEvalPython" in line for line in plans[0].split("\n")) == 1
    ends = net.roads.select("a").union(net.roads.select("b")).distinct()
    assert net.nodes.count() == ends.count() == ends.join(net.nodes, ends.a == net.nodes.id).count()
    net.discard()
