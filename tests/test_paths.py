"""Cheapest paths of pairs against a plain table of all pairs."""

import heapq
import math
import random

import pytest

from shapeloom.operators import paths

RADIUS = 6371008.8


def apart(p, q):
    a, b, c, d = map(math.radians, (*p, *q))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * RADIUS * math.asin(min(1.0, math.sqrt(h)))


def plain(roads, source):
    """Dijkstra: cost of each node that a source reaches."""
    ahead = {}
    for a, b, _, c in roads:
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


def grid(n, step, lat=24.1, lon=120.6, seed=3, holes=0.15):
    """A grid of n x n nodes whose roads have costs of their own; some are missing."""
    rng, place = random.Random(seed), {}
    for k in range(n * n):
        dy, dx = (k // n) * step, (k % n) * step
        y = lat + math.degrees(dy / RADIUS)
        place[k] = (y, (lon + math.degrees(dx / RADIUS / math.cos(math.radians(lat))) + 180) % 360 - 180)
    roads = []
    for k in range(n * n):
        for other in ([k + 1] if k % n < n - 1 else []) + ([k + n] if k < n * n - n else []):
            if rng.random() >= holes:
                length = apart(place[k], place[other])
                roads.append((k, other, length, length * rng.uniform(1.0, 2.6)))
    return place, roads


def network(spark, place, roads, **sizes):
    nodes = spark.createDataFrame([(k, *p) for k, p in place.items()], "id long, lat double, lon double")
    return paths.prepare(nodes, spark.createDataFrame(roads, "a long, b long, length double, cost double"), **sizes)


def check(found, place, roads, asked, with_paths=True):
    cost = {}
    for a, b, length, c in roads:
        for pair in ((a, b), (b, a)):
            cost[pair] = min(cost.get(pair, (math.inf, 0)), (c, length))
    tables = {a: plain(roads, a) for a, _ in asked}
    want = {(a, b): tables[a][b] for a, b in asked if b in tables[a] and a != b}
    assert {(r.a, r.b) for r in found} == set(want) and len(found) == len(want)
    for r in found:
        assert r.cost == pytest.approx(want[r.a, r.b], rel=1e-9)
        if with_paths:
            hops = list(zip(r.path, r.path[1:]))
            assert r.path[0] == r.a and r.path[-1] == r.b
            assert sum(cost[h][0] for h in hops) == pytest.approx(r.cost) and sum(cost[h][1] for h in hops) == pytest.approx(r.metres)
        else:
            assert r.path is None


@pytest.mark.parametrize(("lat", "lon"), [(24.1, 120.6), (60.0, 179.99)])
def test_near_and_far_pairs(spark, lat, lon):
    """Pairs near each other, across the map, and without a path; parallel roads, loops, and roads that cost too little."""
    place, roads = grid(12, 150.0, lat, lon)
    place |= {900: (lat + 0.001, lon + 0.0001), 901: (lat + 0.0012, lon + 0.0001)}
    roads += [(900, 901, 40.0, 60.0), (0, 1, 150.5, 151.0), (5, 5, 3.0, 3.0)]
    rng = random.Random(5)
    asked = [(rng.randrange(144), rng.randrange(144)) for _ in range(60)] + [(0, 143), (143, 0), (0, 900), (900, 901), (7, 7), (3, 999)]
    net = network(spark, place, [*roads, (2, 140, 1.0, 2.0), (0, 777, 5.0, 6.0), (3, 4, None, 1.0)], side=400.0, per_cell=60)
    pairs = spark.createDataFrame([*asked, (None, 3), asked[0]], "a long, b long")
    check(paths.route_legs(pairs, net).collect(), place, roads, [p for p in asked if p[1] != 999])
    net.discard()


def test_crowded_cells_are_searched_over_the_network(spark):
    place, roads = grid(9, 100.0)
    net = network(spark, place, roads, per_cell=10_000)
    asked = [(0, 1), (4, 40), (80, 0), (44, 36)]
    pairs = spark.createDataFrame(asked, "a long, b long")
    check(paths.route_legs(pairs, net, most_roads=10).collect(), place, roads, asked)
    check(paths.route_legs(pairs, net, with_paths=False).collect(), place, roads, asked, with_paths=False)
    check(paths.route_legs(pairs, net, with_paths=False, most_roads=10).collect(), place, roads, asked, with_paths=False)
    assert paths.route_legs(pairs.where("false"), net).collect() == []
    net.discard()


def test_a_leg_of_sixty_kilometres(spark):
    """One long road, whose only way around is longer still, cut into many cells."""
    place = {k: (24.0 + math.degrees(k * 500.0 / RADIUS), 120.0) for k in range(121)}
    roads = [(k, k + 1, apart(place[k], place[k + 1]), 1.5 * apart(place[k], place[k + 1])) for k in range(120)]
    net = network(spark, place, roads, per_cell=80)
    found = paths.route_legs(spark.createDataFrame([(0, 120)], "a long, b long"), net).collect()
    check(found, place, roads, [(0, 120)])
    assert found[0].metres > 59_000 and found[0].path == list(range(121))
    net.discard()


def test_goal_direction_settles_fewer_nodes():
    place, roads = grid(30, 100.0, holes=0.0)
    ahead = {}
    for a, b, length, cost in roads:
        ahead.setdefault(a, []).append((b, cost, length))
        ahead.setdefault(b, []).append((a, cost, length))
    rng, seen = random.Random(9), [0, 0]
    for _ in range(40):
        a, b = rng.randrange(900), rng.randrange(900)
        want = plain(roads, a)[b]
        for k, directed in enumerate((True, False)):
            (cost, _, path), settled = paths.search(ahead, place, a, b, math.inf, directed)
            assert cost == pytest.approx(want, rel=1e-12) and path[0] == a and path[-1] == b
            seen[k] += settled
    assert seen[0] < 0.75 * seen[1]
    assert paths.search(ahead, place, 0, 899, 100.0)[0] is None
