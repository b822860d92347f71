import heapq
import random

import pytest

from shapeloom.operators import network
from shapeloom.plans import catalog
from shapeloom.plans.graph_queries import edges

SF = "/root/testdata/sf0.001"


def plain(rows, source):
    """Dijkstra."""
    ahead = {}
    for a, b, c in rows:
        ahead.setdefault(a, []).append((b, c))
        ahead.setdefault(b, []).append((a, c))
    best, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        c, u = heapq.heappop(heap)
        if c == best[u]:
            for v, more in ahead.get(u, ()):
                if c + more < best.get(v, float("inf")):
                    best[v] = c + more
                    heapq.heappush(heap, (c + more, v))
    return best


def test_costs_over_many_cells(spark):
    """Cheapest paths leave a cell and come back to it; ids without order, negative ones, a loop and a far part."""
    rng = random.Random(7)
    at = list(range(-60, 60))
    rng.shuffle(at)
    rows = [(at[k], at[k + 1], rng.choice([1.0, 2.5, 40.0])) for k in range(119)] + [(at[k], at[k + 12], rng.uniform(5, 60)) for k in range(0, 108, 3)] + [(3, 3, 1.0), (900, 901, 1.0)]
    got = network.shortest_costs(spark.createDataFrame(rows, "a long, b long, cost double"), at[0], per_cell=40).collect()
    assert dict(map(tuple, got)) == plain(rows, at[0]) and len(got) == 120


def test_queries_cover_the_whole_network(spark):
    rows = [tuple(r) for r in edges(spark, SF).select("a", "b", "cost").collect()]
    want = plain(rows, 0)
    got = catalog.queries()["g4_shortest_costs"](spark, SF).collect()
    assert {r.node: r.cost for r in got} == want and len(want) > 100
    cost = {}
    for a, b, c in rows:
        cost[a, b] = cost[b, a] = min(c, cost.get((a, b), c))
    paths = catalog.queries()["g4_shortest_paths"](spark, SF).collect()
    assert {r.node: r.cost for r in paths} == want
    for r in paths:
        assert r.path[0] == 0 and r.path[-1] == r.node
        assert abs(sum(cost[p] for p in zip(r.path, r.path[1:])) - r.cost) < 1e-9 * (1 + r.cost)


def test_whole_paths_are_not_written(spark):
    """A long line: what is written grows with its nodes, not with all paths to them, which are half a million ids."""
    n, step = 1_000, 8
    rows = spark.range(n - 1).selectExpr("id as a", "id + 1 as b", "1d as cost")
    tables, real = [], network.written

    def seen(df, label):
        tables.append((label, real(df, label)))
        return tables[-1][1]

    network.written = seen
    try:
        paths = network.shortest_paths(rows, 0, stretch=step)
    finally:
        network.written = real
    assert {r.node: r.path for r in paths.collect()} == {k: list(range(k + 1)) for k in range(n)}
    ids = sum(t.selectExpr("sum(size(path))").first()[0] or 0 for label, t in tables if "path" in t.columns)
    assert ids < n * n / 2 / 2


def test_no_path_is_written_whole_or_to_anchors(spark):
    """A long line through many cells: the ids in all tables together stay far below those of all paths."""
    n, tables, real = 1_500, [], network.written

    def seen(df, label):
        tables.append(real(df, label))
        arrays = [c for c, kind in tables[-1].dtypes if kind.startswith("array")]
        counted.extend(tables[-1].selectExpr(f"sum(size({'flatten(' * (d - 1)}{c}{')' * (d - 1)}))").first()[0] or 0 for c in arrays for d in [dict(tables[-1].dtypes)[c].count("array<")])
        return tables[-1]

    counted = []
    network.written = seen
    try:
        paths = network.shortest_paths(spark.range(n - 1).selectExpr("id as a", "id + 1 as b", "1d as cost"), 0, stretch=100)
    finally:
        network.written = real
    assert {r.node: r.path for r in paths.collect()} == {k: list(range(k + 1)) for k in range(n)}
    # sixteen tables of at most a few times n ids, and the ways to 15 cells, once each
    assert sum(counted) < 20 * n < n * n / 2 / 30


def test_paths_through_many_cells(spark):
    """A wide strip with branches, ids in no order, parts that nobody reaches; cells of seven nodes."""
    rng = random.Random(4)
    at = list(range(-90, 90))
    rng.shuffle(at)
    rows = [(at[k], at[k + 1], rng.uniform(1, 9)) for k in range(179) if k % 6 != 5] + [(at[k], at[k + 6], rng.uniform(1, 9)) for k in range(174)] + [(900, 901, 1.0), (5, 5, 2.0)]
    want, cost = plain(rows, at[0]), {}
    for a, b, c in rows:
        cost[a, b] = cost[b, a] = min(c, cost.get((a, b), c))
    got = network.shortest_paths(spark.createDataFrame(rows, "a long, b long, cost double"), at[0], stretch=7).collect()
    assert {r.node: r.cost for r in got} == want and len(got) == 180
    for r in got:
        assert r.path[0] == at[0] and r.path[-1] == r.node and sum(cost[p] for p in zip(r.path, r.path[1:])) == pytest.approx(r.cost)
