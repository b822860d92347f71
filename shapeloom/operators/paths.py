"""Cheapest paths between pairs of nodes, by goal-directed search in cells of the map.

A road costs at least its length, and its length is at least the straight distance of its ends, so the straight
distance to the target bounds what a path still costs. The search (A*) follows the smallest sum of both and stops at the
target.

A pair whose ends are near each other is searched in one task, over the roads of the map cells around its start. That
is final where no path that leaves these roads can be cheaper. All other pairs, and those in cells with very many roads,
are searched over the whole network: it is cut into cells of bounded size, and labels (pair, node, cost) cross their
borders from round to round. Labels that cannot reach the target within a limit wait; the limit is the cost of the
target once it is found, and grows where it is not. No pair with a path is left out, however long the path is.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.functions.geo import RADIUS, haversine
from shapeloom.operators.network import by_cell, cells_around, cells_beside, one_of_each_place, own_cell
from shapeloom.operators.staging import discard, written

#: Metres of a map cell's side, roads around a cell that one task takes at most, and pairs of one task.
SIDE, MOST_ROADS, PAIRS = 2_000.0, 200_000, 2_000
#: A table is dealt out whole where a round asks for one in so many of its rows; it changes the time alone.
MANY = 10
#: Roads of a cell of the whole network, and parts into which a cell's pairs fall.
PER_CELL, PARTS = 50_000, 16
#: Share by which a straight distance is taken shorter, against rounding.
_LESS = 1 - 1e-9
_FOUND = "a long, b long, cost double, metres double, path array<long>, settled long"
_ROAD = ("a", "b", "length", "cost", "alat", "alon", "blat", "blon")
_LABEL = "pair long, node long, cell int, cost double, metres double, prev long, carried boolean, settled long, waits boolean"


@dataclass
class Network:
    """Nodes (id, lat, lon), roads (a, b, length, cost, both ends' places and map cells), and roads with all their columns.

    The cells of the whole network are written where a pair first needs them. discard() deletes these tables.
    """

    nodes: DataFrame
    roads: DataFrame
    attributes: DataFrame
    side: float
    per_cell: int
    arrays: dict[float, DataFrame] = field(default_factory=dict)

    def waiting(self, metres: float) -> DataFrame:
        """(cell, ns): the nodes as points of a cell find them within so many metres; written where first asked for."""
        if metres not in self.arrays:
            self.arrays[metres] = written(by_cell(one_of_each_place(self.nodes), metres), "waiting")
        return self.arrays[metres]

    @cached_property
    def dealt(self) -> DataFrame:
        """Roads with each map cell around them, for rounds of many pairs."""
        return written(self.roads.select(F.explode(_around(self.side)).alias("cell"), *_ROAD), "dealt")

    @cached_property
    def places(self) -> DataFrame:
        """(node, cell, lat, lon): cells of about so many roads, of nodes that are near each other."""
        count = max(1, -(-2 * self.roads.count() // self.per_cell))
        dealt = self.nodes.withColumn("z", _interleaved(F.col("lat"), F.col("lon"))).repartitionByRange(count, "z", "id")
        return written(dealt.select(F.col("id").alias("node"), F.spark_partition_id().alias("cell"), "lat", "lon"), "places")

    @cached_property
    def arcs(self) -> DataFrame:
        """Roads both ways (u, v, cost, length) with the cell of u, and the cell and place of v."""
        both = self.roads.select(F.col("a").alias("u"), F.col("b").alias("v"), "cost", "length").unionAll(self.roads.select("b", "a", "cost", "length"))
        here = self.places.select(F.col("node").alias("u"), "cell")
        there = self.places.select(F.col("node").alias("v"), F.col("cell").alias("vcell"), F.col("lat").alias("vlat"), F.col("lon").alias("vlon"))
        return written(both.join(here, "u").join(there, "v").select("cell", "u", "v", "vcell", "vlat", "vlon", "cost", "length"), "arcs")

    def discard(self) -> None:
        made = [self.__dict__.pop(name) for name in ("dealt", "places", "arcs") if name in self.__dict__]
        for table in (self.nodes, self.roads, self.attributes, *made, *self.arrays.values()):
            discard(table)
        self.arrays.clear()


def many(asked: DataFrame, table: DataFrame) -> bool:
    """Whether so much is asked that the whole table may be dealt to cells, once for all rounds."""
    return asked.count() * MANY >= table.count()


def _interleaved(lat: Column, lon: Column, bits: int = 20) -> Column:
    """A place on a curve that passes near places one after another."""
    y, x = F.floor((lat + 90) / 180 * ((1 << bits) - 1)), F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * ((1 << bits) - 1))
    bit = lambda v, k, at: F.shiftleft(F.shiftright(v.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), at)
    made = F.lit(0).cast("long")
    for k in range(bits):
        made = made.bitwiseOR(bit(x, k, 2 * k)).bitwiseOR(bit(y, k, 2 * k + 1))
    return made


def prepare(nodes: DataFrame, roads: DataFrame, side: float = SIDE, per_cell: int = PER_CELL) -> Network:
    """A network for route_legs(), written once for all that is routed over it.

    nodes: (id, lat, lon), rows without an id or a place are left out. roads: (a, b, length, cost) with any further
    columns; a road without length or cost, with a cost below the straight distance of its ends, or to a node that is not
    there, is left out, and so are loops. Of parallel roads the cheapest is walked. Roads that written() returned are
    not written again; they go with the network.
    """
    nodes = written(nodes.select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where("id is not null and lat is not null and lon is not null").dropDuplicates(["id"]), "nodes")
    attributes = roads if getattr(roads, "written_to", None) else written(roads, "attributes")
    end = lambda x: nodes.select(F.col("id").alias(x), F.col("lat").alias(f"{x}lat"), F.col("lon").alias(f"{x}lon"))
    placed = attributes.select(*(F.col(c).cast("long").alias(c) for c in "ab"), *(F.col(c).cast("double").alias(c) for c in ("length", "cost"))).where("a <> b").join(end("a"), "a").join(end("b"), "b")
    usable = (F.col("length") > 0) & (F.col("cost") >= haversine("alat", "alon", "blat", "blon") * _LESS)
    cells = (own_cell(F.col(f"{x}lat"), F.col(f"{x}lon"), side).alias(f"{x}cell") for x in "ab")
    placed = written(placed.where(usable).select(*_ROAD, *cells), "roads")
    return Network(nodes, placed, attributes, side, per_cell)


def _around(side: float) -> Column:
    """All cells around either end of a road."""
    return F.array_union(cells_around(F.col("alat"), F.col("alon"), side), cells_around(F.col("blat"), F.col("blon"), side))


def _straight(lat: float, lon: float) -> Callable[[float, float], float]:
    """Metres, a trace too few, from a place to another."""
    y, x = math.radians(lat), math.radians(lon)
    cos = math.cos(y)

    def metres(lat: float, lon: float) -> float:
        b = math.radians(lat)
        h = math.sin((b - y) / 2) ** 2 + cos * math.cos(b) * math.sin((math.radians(lon) - x) / 2) ** 2
        return 2 * RADIUS * math.asin(math.sqrt(min(1.0, h))) * _LESS

    return metres


def search(ahead: dict, place: dict, source: int, target: int, limit: float, directed: bool = True) -> tuple[tuple[float, float, list[int]] | None, int]:
    """The cheapest path from source to target (cost, metres, nodes) that costs no more than limit, and the nodes settled.

    ahead: node to [(next, cost, metres)]; place: node to (lat, lon). Not directed, it settles by cost alone.
    """
    straight = _straight(*place[target])
    rest = {source: straight(*place[source]) if directed else 0.0}
    best, before, settled = {source: (0.0, 0.0)}, {}, 0
    heap = [(rest[source], 0.0, source)]
    while heap:
        sum_, cost, u = heapq.heappop(heap)
        if cost > best[u][0]:
            continue
        if sum_ > limit:
            break
        settled += 1
        if u == target:
            path = [u]
            while path[-1] != source:
                path.append(before[path[-1]])
            return (*best[u], path[::-1]), settled
        metres = best[u][1]
        for v, more, length in ahead.get(u, ()):
            known = best.get(v)
            if known is None or cost + more < known[0]:
                if v not in rest:
                    rest[v] = straight(*place[v]) if directed else 0.0
                best[v], before[v] = (cost + more, metres + length), u
                heapq.heappush(heap, (cost + more + rest[v], cost + more, v))
    return None, settled


def _near(side: float, directed: bool):
    """Paths of one map cell's pairs over the roads around it: only those that no way around outside can undercut."""

    def run(pairs: pd.DataFrame, roads: pd.DataFrame) -> pd.DataFrame:
        ahead: dict[int, list[tuple[int, float, float]]] = {}
        place: dict[int, tuple[float, float]] = {}
        columns = (roads[c].tolist() for c in ("a", "b", "cost", "length", "alat", "alon", "blat", "blon"))
        for a, b, cost, length, *at in zip(*columns, strict=True):
            ahead.setdefault(a, []).append((b, cost, length))
            ahead.setdefault(b, []).append((a, cost, length))
            place[a], place[b] = at[:2], at[2:]
        rows = []
        for a, b, straight in zip(pairs["a"].tolist(), pairs["b"].tolist(), pairs["straight"].tolist(), strict=True):
            if a in ahead and b in ahead:
                # whoever leaves the roads has gone ``side`` metres and still has to come to the target
                found, settled = search(ahead, place, a, b, 2 * side - straight, directed)
                if found:
                    rows.append((a, b, *found, settled))
        frame = pd.DataFrame(rows, columns=["a", "b", "cost", "metres", "path", "settled"])
        return frame.astype({"a": "int64", "b": "int64", "cost": "float64", "metres": "float64", "settled": "int64"})

    return run


def _within_cells(pairs: DataFrame, net: Network, directed: bool, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Paths of near pairs, and the tables to discard once they are written."""
    own = own_cell(F.col("alat"), F.col("alon"), net.side)
    fits = pairs.where(F.col("straight") <= net.side).select("a", "b", "straight", own.alias("cell"))
    # a table of its own, so that its size is known: only roads beside these cells go on, and are dealt to the cells around them
    busy = written(fits.groupBy("cell").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts")), "busy")
    if "dealt" in net.__dict__ or many(pairs, net.roads):
        met = net.dealt
    else:
        beside = busy.select(F.explode(cells_beside(F.col("cell"), net.side)).alias("own")).distinct()
        met = net.roads.withColumn("own", F.explode(F.array_distinct(F.array("acell", "bcell")))).join(beside, "own", "left_semi").select(*_ROAD).distinct()
        met = met.withColumn("cell", F.explode(_around(net.side)))
    roads = written(met.join(busy, "cell").select("cell", "parts", *_ROAD), "around")
    taken = roads.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("cell")
    fits = fits.join(busy, "cell").join(taken, "cell", "left_semi").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int"))
    dealt = roads.join(taken, "cell", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", *_ROAD)
    return fits.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInPandas(_near(net.side, directed), _FOUND), [busy, roads]


def _relax(directed: bool):
    """Labels of one cell's pairs brought to their fixed point over the roads of the cell, and carried over its borders."""

    def run(arcs: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        ahead: dict[int, list[tuple]] = {}
        place: dict[int, tuple[float, float]] = {}
        cell = int(arcs["cell"].iloc[0]) if len(arcs) else -1
        for u, *arc in zip(*(arcs[c].tolist() for c in ("u", "v", "vcell", "cost", "length", "vlat", "vlon")), strict=True):
            ahead.setdefault(u, []).append(arc[:4])
            place[arc[0]] = arc[4:]
        rows: list[tuple] = []
        for pair, own in labels.groupby("pair", sort=False):
            pair, target, limit = int(pair), int(own["target"].iloc[0]), float(own["limit"].iloc[0])
            straight = _straight(own["tlat"].iloc[0], own["tlon"].iloc[0])
            best, inside, outside, settled, waits = {}, {}, {}, 0, False
            heap = []
            for node, cost, metres, prev, carried, lat, lon in zip(*(own[c].tolist() for c in ("node", "cost", "metres", "prev", "carried", "lat", "lon")), strict=True):
                best[node] = (cost, metres)
                if carried:
                    heap.append((cost + (straight(lat, lon) if directed else 0.0), cost, node))
            heapq.heapify(heap)
            while heap:
                sum_, cost, u = heapq.heappop(heap)
                if cost > best[u][0]:
                    continue
                if sum_ > limit:
                    waits = True
                    break
                settled += 1
                if u == target:
                    limit = min(limit, cost)
                    break
                metres = best[u][1]
                for v, vcell, more, length in ahead.get(u, ()):
                    there = inside if vcell == cell else outside
                    known = best.get(v) if vcell == cell else outside.get(v)
                    total = cost + more
                    if known is None or total < known[0]:
                        bound = total + (straight(*place[v]) if directed else 0.0)
                        if bound > limit:
                            waits = True
                            continue
                        there[v] = (total, metres + length, u, vcell)
                        if vcell == cell:
                            best[v] = (total, metres + length)
                            heapq.heappush(heap, (bound, total, v))
            for found, carried in ((inside, False), (outside, True)):
                rows += [(pair, v, vcell, total, metres, u, carried, 0, False) for v, (total, metres, u, vcell) in found.items()]
            rows.append((pair, None, None, None, None, None, False, settled, waits))
        frame = pd.DataFrame(rows, columns=["pair", "node", "cell", "cost", "metres", "prev", "carried", "settled", "waits"])
        kinds = {"pair": "int64", "node": "Int64", "cell": "Int32", "cost": "float64", "metres": "float64", "prev": "Int64", "carried": "bool", "settled": "int64", "waits": "bool"}
        return frame.astype(kinds)

    return run


def _whole(pairs: DataFrame, net: Network, directed: bool, with_paths: bool) -> DataFrame:
    """Pairs over the whole network, in rounds over its cells."""
    start = net.places.select(F.col("node").alias("a"), "cell")
    goals = pairs.select(F.monotonically_increasing_id().alias("pair"), "a", "b", (F.col("straight") * 2 + 1_000).alias("limit"), F.col("blat").alias("tlat"), F.col("blon").alias("tlon"), "alat", "alon").join(start, "a")
    open_, made = written(goals, "goals"), []
    while not open_.isEmpty():
        labels = written(open_.select("pair", F.col("a").alias("node"), "cell", F.lit(0.0).alias("cost"), F.lit(0.0).alias("metres"), F.lit(None).cast("long").alias("prev")), "labels")
        front, notes = labels, []
        while not front.isEmpty():
            reached = labels.select("pair", F.col("node").alias("b"), F.col("cost").alias("have"))
            aims = open_.join(reached, ["pair", "b"], "left").select("pair", F.col("b").alias("target"), F.least("limit", F.coalesce("have", "limit")).alias("limit"), "tlat", "tlon")
            active = front.select("pair", "cell").distinct()
            fresh = front.select("pair", "node", "cost", F.lit(True).alias("carried"))
            known = labels.join(active, ["pair", "cell"], "left_semi").join(fresh, ["pair", "node", "cost"], "left").withColumn("carried", F.coalesce("carried", F.lit(False)))
            known = known.join(net.places.select("node", "lat", "lon"), "node").join(aims, "pair").withColumn("part", F.pmod("pair", F.lit(PARTS)).cast("int"))
            roads = net.arcs.join(active.select("cell", F.pmod("pair", F.lit(PARTS)).cast("int").alias("part")).distinct(), "cell")
            out = roads.groupBy("cell", "part").cogroup(known.groupBy("cell", "part")).applyInPandas(_relax(directed), _LABEL)
            out = written(out, "relaxed")
            notes.append(out)
            best = out.where("node is not null").groupBy("pair", "node").agg(F.min(F.struct("cost", "carried", "cell", "metres", "prev")).alias("x")).select("pair", "node", "x.*")
            old = labels.select("pair", "node", F.col("cost").alias("old"))
            better = written(best.join(old, ["pair", "node"], "left").where("old is null or cost < old").drop("old"), "better")
            kept = labels.join(better, ["pair", "node"], "left_anti").unionByName(better.drop("carried"))
            before, labels = labels, written(kept, "labels")
            if front is not before:
                discard(front)
            discard(before)
            front = written(better.where("carried").drop("carried"), "front")
            discard(better)
        discard(front)
        said = notes[0]
        for table in notes[1:]:
            said = said.unionByName(table)
        said = said.where("node is null").groupBy("pair").agg(F.bool_or("waits").alias("waits"), F.sum("settled").alias("settled"))
        reached = labels.select("pair", F.col("node").alias("b"), "cost", "metres")
        state = written(open_.join(said, "pair").join(reached, ["pair", "b"], "left"), "state")
        done = state.where("cost is not null and cost <= limit")
        found = done.select("pair", "a", "b", "cost", "metres", "settled")
        if with_paths:
            paths = _walked_back(found, labels)
            found = found.join(paths, "pair")
        else:
            found = found.withColumn("path", F.lit(None).cast("array<long>"))
        made.append(written(found.select("a", "b", "cost", "metres", "path", "settled"), "found"))
        # a pair that waits nowhere has no path; others may go farther
        again = state.where("(cost is null and waits) or cost > limit").select(*open_.columns).withColumn("limit", F.col("limit") * 2)
        before, open_ = open_, written(again, "goals")
        for table in (before, labels, state, *notes):
            discard(table)
    discard(open_)
    whole = made[0] if made else None
    for table in made[1:]:
        whole = whole.unionByName(table)
    return whole


def _walk(labels: pd.DataFrame) -> pd.DataFrame:
    """The way back from a head through the labels of one cell, and the node before it in another cell."""
    rows = []
    before = dict(zip(labels["node"].tolist(), (None if pd.isna(x) else int(x) for x in labels["prev"]), strict=True))
    pair, step, node = (int(labels[c].iloc[0]) for c in ("pair", "step", "head"))
    part = []
    while node is not None and node in before:
        part.append(node)
        node = before[node]
    rows.append((pair, step, part[::-1], node))
    return pd.DataFrame(rows, columns=["pair", "step", "part", "next"]).astype({"pair": "int64", "step": "int32", "next": "Int64"})


def _walked_back(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(pair, path): from each target back to the source, a cell a round."""
    at = labels.select("pair", F.col("node").alias("head"), "cell")
    heads = written(found.select("pair", F.col("b").alias("head"), F.lit(0).alias("step")).join(at, ["pair", "head"]), "heads")
    parts = []
    while not heads.isEmpty():
        there = labels.select("pair", "cell", "node", "prev").join(heads, ["pair", "cell"])
        part = written(there.groupBy("pair").applyInPandas(_walk, "pair long, step int, part array<long>, next long"), "part")
        parts.append(part)
        discard(heads)
        following = part.where("next is not null").select("pair", F.col("next").alias("head"), (F.col("step") + 1).alias("step"))
        heads = written(following.join(at, ["pair", "head"]), "heads")
    discard(heads)
    if not parts:
        return found.select("pair", F.array().cast("array<long>").alias("path"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    joined = written(whole.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct((-F.col("step")).alias("k"), "part"))).alias("xs")).select("pair", F.flatten(F.transform("xs", lambda x: x["part"])).alias("path")), "paths")
    for part in parts:
        discard(part)
    return joined


def route_legs(pairs: DataFrame, net: Network, directed: bool = True, with_paths: bool = True, most_roads: int = MOST_ROADS) -> DataFrame:
    """(a, b, cost, metres, path, settled): a cheapest path of each pair of nodes; settled counts the nodes searched.

    Pairs count once each; null nodes, nodes without a place and pairs of one node are left out, and so are pairs
    without a path. Without paths only cost and metres are kept. Not directed, searches settle by cost alone, with
    equal costs. A path of equal cost may be any of them. Extra columns are not read.
    """
    end = lambda x: net.nodes.select(F.col("id").alias(x), F.col("lat").alias(f"{x}lat"), F.col("lon").alias(f"{x}lon"))
    asked = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct().join(end("a"), "a").join(end("b"), "b")
    asked = written(asked.withColumn("straight", haversine("alat", "alon", "blat", "blon")), "pairs")
    near, scratch = _within_cells(asked, net, directed, most_roads)
    near = written(near if with_paths else near.withColumn("path", F.lit(None).cast("array<long>")), "near")
    for table in scratch:
        discard(table)
    far = written(asked.join(near, ["a", "b"], "left_anti"), "far")
    discard(asked)
    rest = None if far.isEmpty() else _whole(far, net, directed, with_paths)
    discard(far)
    return near if rest is None else near.unionByName(rest)
