"""Road network operators: safety and cost of edges, degrees, components, spatial joins, shortest paths."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.functions.geo import RADIUS, haversine
from shapeloom.operators.components import components_of_ranges
from shapeloom.operators.staging import discard, written
from shapeloom.plans.fixtures import GREEN, SAFETY

# Classes that runners may not use, and words that name a greenway.
EXCLUDED = ("motorway", "motorway_link", "trunk", "trunk_link", "construction", "proposed", "raceway", "bus_guideway", "escape")
GREENWAY_HINTS = ("園道", "綠道", "步道", "自行車道", "河濱", "堤防", "草悟道", "美術園道", "柳川", "綠川", "筏子溪", "旱溪")
#: Metres of a degree of latitude, for placing points of a grid of shapes.
METRES = 111319.49
#: Share by which cells are larger than they need to be, against rounding.
SLACK = 1e-6
#: Edges of a cell in which one task relaxes costs.
PER_CELL = 50_000
#: Nodes of a cell, in which one task takes a tree of paths apart.
STRETCH = 20_000


def base_safety(hw: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SAFETY.items() for x in pair))
    return F.coalesce(table[F.coalesce(hw, F.lit(""))], F.lit(0.5))


def road_safety(hw: Column, name: Column, foot: Column, sidewalk: Column, lanes: Column) -> Column:
    """Safety of a road, 0.02 to 1, unrounded. Every rule clamps before the next one adds.

    A rule that does not hold adds 0 and clamps to 0 or 1, which leaves every safety as it is. So each rule names the one
    before it once; named in both branches of a condition, the first would be worked out 32 times a row.
    """
    holds = lambda rule, yes, no: F.when(rule, yes).otherwise(no)
    plus = lambda s, rule, more: F.least(F.lit(1.0), s + holds(rule, more, 0.0))
    less = lambda s, rule, less: F.greatest(holds(rule, 0.05, 0.0), s - holds(rule, less, 0.0))
    s = F.greatest(base_safety(hw), holds(F.coalesce(name, F.lit("")).rlike("|".join(GREENWAY_HINTS)), 0.95, 0.0))
    s = plus(s, foot.isin("designated", "yes"), 0.05)
    s = plus(s, sidewalk.isin("both", "left", "right", "yes"), 0.08)
    s = less(s, sidewalk == "no", 0.12)
    s = less(s, F.coalesce(parse_lanes(lanes), F.lit(0)) >= 4, 0.10)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.02), s))


def parse_lanes(lanes: Column) -> Column:
    """The whole number before the first semicolon; anything else gives null."""
    return F.get(F.split(lanes.cast("string"), ";"), F.lit(0)).try_cast("int")


def edge_cost(length: Column, safety: Column) -> Column:
    return length * (1 + 1.6 * (1 - safety))


def cheapest_edges(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair of nodes, the cheapest; of equal ones the first by ``ord``."""
    pair = edges.withColumn("u", F.least("a", "b")).withColumn("v", F.greatest("a", "b"))
    best = F.min_by(F.struct("length", "cost"), F.struct("cost", "ord"))
    return pair.groupBy("u", "v").agg(best.alias("x")).select("u", "v", "x.length", "x.cost")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected part. A node that only loops is left out."""
    return components_of_ranges(edges, "a", "b")


def largest_component_nodes(edges: DataFrame) -> DataFrame:
    """(id): the nodes of the component with the most nodes; of equal ones that with the smallest node."""
    label = components(edges)
    best = label.groupBy("component").agg(F.count("*").alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return label.join(F.broadcast(best), "component", "left_semi").select(F.col("node").alias("id"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component with the most nodes; of equal ones that with the smallest node."""
    return edges.join(largest_component_nodes(edges).select(F.col("id").alias("a")).hint("merge"), "a", "left_semi")


def _columns(cy: Column, metres: float) -> Column:
    """Cells of a band of the grid, around the earth: none is narrower than ``metres``, in its own band or beside it."""
    angle = math.sin(min(metres / (2 * RADIUS), math.pi / 2))
    # the latitude farthest from the equator among the band and its neighbours
    far = (F.abs(cy + 0.5) + 1.5) * _height(metres)
    ratio = angle / F.cos(F.radians(far))
    return F.when((far < 90) & (ratio < 1), F.greatest(F.floor(math.pi / (F.asin(ratio) * (1 + SLACK))), F.lit(1))).otherwise(F.lit(1)).cast("long")


def _height(metres: float) -> float:
    """Degrees of latitude of a cell."""
    return math.degrees(metres / RADIUS) * (1 + SLACK)


def _at(lon: Column, count: Column, dx: int = 0) -> Column:
    """The column of a longitude, or one so many beside it, in a band of ``count`` cells."""
    return F.pmod(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) * count / 360.0) + dx, count)


def own_cell(lat: Column, lon: Column, metres: float) -> Column:
    """(cy, cx): the cell of a point in a grid that suits distances of so many metres, at every latitude and longitude."""
    cy = F.floor(lat / _height(metres))
    return F.struct(cy.alias("cy"), _at(lon, _columns(cy, metres)).alias("cx"))


def cells_around(lat: Column, lon: Column, metres: float) -> Column:
    """An array of (cy, cx): all cells that hold points at most so many metres from a point, its own included.

    Bands of cells have widths of their own, so that a cell is as wide as the distance anywhere between the poles;
    near a pole a band is one cell. Columns are counted around the earth, so 180 and -180 degrees meet.
    """
    cy = F.floor(lat / _height(metres))
    # the number of columns is worked out once a band: nine cells on their own are too much code to be compiled
    bands = F.transform(F.array(*(F.lit(k) for k in (-1, 0, 1))), lambda dy: F.struct((cy + dy).alias("cy"), _columns(cy + dy, metres).alias("n")))
    cells = F.transform(bands, lambda band: F.array(*(F.struct(band["cy"].alias("cy"), _at(lon, band["n"], dx).alias("cx")) for dx in (-1, 0, 1))))
    return F.array_distinct(F.flatten(cells))


def cells_beside(cell: Column, metres: float) -> Column:
    """An array of (cy, cx): all cells that hold points at most so many metres from any point of a cell, its own included.

    It holds cells_around() of every point of the cell, and lets a few cells tell which of many rows can matter.
    """
    cy, cx = cell["cy"], cell["cx"]
    bands = F.transform(F.array(*(F.lit(k) for k in (-1, 0, 1))), lambda dy: F.struct((cy + dy).alias("cy"), _columns(cy + dy, metres).alias("n"), _columns(cy, metres).alias("own")))
    edge = lambda band, x, slack, dx: F.floor(x * band["n"] / band["own"] + slack) + dx
    columns = lambda band: F.sequence(edge(band, cx, -SLACK, -1), edge(band, cx + 1, SLACK, 1))
    cells = F.transform(bands, lambda band: F.transform(columns(band), lambda x: F.struct(band["cy"].alias("cy"), F.pmod(x, band["n"]).alias("cx"))))
    return F.array_distinct(F.flatten(cells))


def within(left: DataFrame, right: DataFrame, metres: float, names=("lat", "lon", "rlat", "rlon"), spread: str = "left") -> DataFrame:
    """Pairs of points at most so far apart: an equi-join on grid cells, then the exact distance ``d``.

    ``spread`` names the side whose rows are dealt to the cells around them: the smaller one.
    """
    deal = lambda df, lat, lon, side: df.withColumn("cell", F.explode(cells_around(F.col(lat), F.col(lon), metres)) if side == spread else own_cell(F.col(lat), F.col(lon), metres))
    pairs = deal(left, *names[:2], "left").join(deal(right, *names[2:], "right"), "cell")
    return pairs.withColumn("d", haversine(*names)).where(F.col("d") <= metres).drop("cell")


def nearest(points: DataFrame, key: str, nodes: DataFrame, reach: float) -> DataFrame:
    """(key, node, d): the nearest node within ``reach`` metres; of equally near ones the smallest id."""
    near = within(points, nodes.select(F.col("id").alias("node"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon")), reach)
    return near.groupBy(key).agg(F.min(F.struct("d", "node")).alias("m")).select(key, "m.node", "m.d")


def one_of_each_place(nodes: DataFrame) -> DataFrame:
    """(lat, lon, id): nodes at one place count as one, the smallest id; those without coordinates are left out."""
    return nodes.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min("id").alias("id"))


def by_cell(places: DataFrame, metres: float) -> DataFrame:
    """(cell, ns): the nodes (id, lat, lon) that may be so many metres from a point of a cell, as one array."""
    around = places.select(F.explode(cells_around(F.col("lat"), F.col("lon"), metres)).alias("cell"), F.struct("id", "lat", "lon").alias("n"))
    return around.groupBy("cell").agg(F.collect_list("n").alias("ns"))


def _with_nearest(points: DataFrame, around: DataFrame, metres: float) -> DataFrame:
    """``points`` with ``m``, the nearest node (d, node) at most so many metres away; null without one. around: by_cell().

    Arrays are far larger than the rows that they are made of, by which Spark would judge them: never broadcast them.
    """
    far = lambda n: haversine(F.col("lat"), F.col("lon"), n["lat"], n["lon"])
    least = F.array_min(F.transform("ns", lambda n: F.struct(far(n).alias("d"), n["id"].alias("node"))))
    met = points.withColumn("cell", own_cell(F.col("lat"), F.col("lon"), metres)).join(around.hint("merge"), "cell", "left")
    return met.withColumn("m", least).drop("cell", "ns").withColumn("m", F.when(F.col("m.d") <= metres, F.col("m")))


def nearest_of_many(points: DataFrame, nodes: DataFrame, reach: float, first: float, few_cells: bool = False, waiting: Callable[[float], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``points`` (lat, lon and any others) with node and d of the nearest node within ``reach``, and a scratch table.

    For many points over few nodes: nodes are dealt to the cells around them and wait there as one array a cell, so
    no pair of a point and a node becomes a row, and nothing is grouped by point. Most points find theirs within
    ``first`` metres; only the others look as far as ``reach``. Of equally near nodes the smallest id is taken; nodes at
    one place count as one, so that an array holds no more than the places of nine cells of the map. Points
    without a node in reach or without coordinates are left out; repeated points all stay. The scratch table can be
    discarded once the result is written.

    few_cells: the points lie in few of the cells that hold nodes. Then only nodes in cells beside these are dealt out.
    waiting: gives by_cell() of the nodes where it is kept for many calls. Then only arrays of cells with points are read on.
    """

    def look(asked: DataFrame, metres: float) -> DataFrame:
        near, own = nodes, own_cell(F.col("lat"), F.col("lon"), metres).alias("cell")
        if waiting:
            return _with_nearest(asked, waiting(metres).join(asked.select(own).distinct(), "cell", "left_semi"), metres)
        if few_cells:
            beside = asked.select(own).distinct().select(F.explode(cells_beside(F.col("cell"), metres)).alias("cell")).distinct()
            near = nodes.select("*", own).join(beside, "cell", "left_semi").drop("cell")
        return _with_nearest(asked, by_cell(one_of_each_place(near), metres), metres)

    near = written(look(points, first), "snapped")
    rest = look(near.where("m is null").drop("m"), reach)
    both = near.where("m is not null").unionByName(rest.where("m is not null"))
    return both.select(*points.columns, "m.node", "m.d"), near


def nearest_at_any_distance(points: DataFrame, key: str, nodes: DataFrame, reach: float, growth: float = 4.0) -> DataFrame:
    """(key, node, d): the nearest node at any distance. Places without a node in reach look again, farther away.

    Points at one place look once, and nodes at one place count as one, the smallest id. The nodes around a cell wait
    there as one array, so that no pair of a point and a node becomes a row. The last round reaches half around the
    earth. Without nodes there are no rows; points without coordinates have none.
    """
    whole = "lat is not null and lon is not null"
    places = written(one_of_each_place(nodes), "places")
    left = written(points.where(whole).select("lat", "lon").distinct(), "left")
    found = []
    while True:
        near = written(_with_nearest(left, by_cell(places, reach), reach), "near")
        found.append(near.where("m is not null"))
        left = near.where("m is null").drop("m")
        if reach > 2.1e7 or left.isEmpty():
            break
        reach *= growth
    met = points.select(key, "lat", "lon").join(reduce(DataFrame.unionByName, found), ["lat", "lon"])
    return met.groupBy(key).agg(F.min("m").alias("m")).select(key, "m.node", "m.d")


def _cell_of(cells: int):
    """The cell of a node: ranges of ids, which are near each other on the map more often than not."""
    return lambda c: F.when(F.col("high") > F.col("low"), F.floor((F.col(c) - F.col("low")).cast("double") * cells / (F.col("high") - F.col("low") + 1))).otherwise(0).cast("int")


def _relaxed(arcs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one cell that its improved nodes (``fresh``) make cheaper over arcs inside the cell, themselves included."""
    ahead: dict[int, list[tuple[int, float]]] = {}
    for u, v, c in zip(arcs["u"].tolist(), arcs["v"].tolist(), arcs["cost"].tolist(), strict=True):
        ahead.setdefault(u, []).append((v, c))
    fresh = known[known["fresh"]]
    old = known[~known["fresh"]]
    best = dict(zip(old["node"].tolist(), old["cost"].tolist(), strict=True))
    heap, found = [], {}
    for u, c in zip(fresh["node"].tolist(), fresh["cost"].tolist(), strict=True):
        best[u] = found[u] = c
        heap.append((c, u))
    heapq.heapify(heap)
    while heap:
        c, u = heapq.heappop(heap)
        if c > best[u]:
            continue
        for v, more in ahead.get(u, ()):
            if v not in best or c + more < best[v]:
                best[v] = found[v] = c + more
                heapq.heappush(heap, (c + more, v))
    cell = known["cell"].iloc[0] if len(known) else 0
    return pd.DataFrame({"node": pd.Series(list(found), dtype="int64"), "cell": pd.Series([cell] * len(found), dtype="int32"), "cost": pd.Series(list(found.values()), dtype="float64")})


def shortest_costs(edges: DataFrame, source: int, per_cell: int = PER_CELL) -> DataFrame:
    """(node, cost): least cost from a source over undirected edges (a, b, cost), by relaxation until nothing improves.

    Nodes fall into cells of about ``per_cell`` edges. In a round every cell with an improved node is relaxed to its
    fixed point in one task; then only arcs between cells carry costs on. Rounds are the borders that a cheapest path
    crosses, not its edges. Costs must not be below 0.
    """
    spark = edges.sparkSession
    ends = edges.agg(F.least(F.min("a"), F.min("b"), F.lit(source)).alias("low"), F.greatest(F.max("a"), F.max("b"), F.lit(source)).alias("high"), F.count("*").alias("n")).first()
    cell = _cell_of(-(-ends.n // per_cell) or 1)

    def placed(df, *pairs):
        df = df.withColumn("low", F.lit(ends.low)).withColumn("high", F.lit(ends.high))
        return df.select(*df.columns[:-2], *(cell(c).alias(name) for c, name in pairs))

    arcs = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"), F.col("cost").cast("double").alias("cost"))
    arcs = written(placed(arcs.unionAll(arcs.select(F.col("v"), F.col("u"), "cost")), ("u", "cell"), ("v", "other")), "arcs")
    inner, cross = arcs.where("cell = other").select("cell", "u", "v", "cost"), arcs.where("cell <> other")
    best = spark.createDataFrame([], "node long, cell int, cost double")
    front = placed(spark.createDataFrame([(source, 0.0)], "node long, cost double"), ("node", "cell")).select("node", "cell", "cost")
    while True:
        active = front.select("cell").distinct()
        known = best.join(active, "cell", "left_semi").select("node", "cell", "cost", F.lit(False).alias("fresh")).unionAll(front.select("node", "cell", "cost", F.lit(True)))
        better = written(inner.join(active, "cell", "left_semi").groupBy("cell").cogroup(known.groupBy("cell")).applyInPandas(_relaxed, "node long, cell int, cost double"), "better")
        old, best = best, written(best.join(better.hint("merge"), "node", "left_anti").select(better.columns).unionByName(better), "best")
        discard(old)
        reached = cross.hint("merge").join(better.select(F.col("node").alias("u"), F.col("cost").alias("have")), "u").groupBy(F.col("v").alias("node"), F.col("other").alias("cell")).agg(F.min(F.col("have") + F.col("cost")).alias("cost"))
        known = best.select("node", F.col("cost").alias("old"))
        old, front = front, written(reached.join(known.hint("merge"), "node", "left").where("old is null or cost < old").select("node", "cell", "cost"), "front")
        discard(old)
        discard(better)
        if front.isEmpty():
            return best.select("node", "cost")


def _to_the_head(open_: DataFrame, label: str) -> list[DataFrame]:
    """Tables of ``open_`` (node, path, head), each path with those of all heads before it in front; by doubling.

    A row without a head is whole. A round joins and writes only the rows that are not.
    """
    open_, whole = written(open_, label), []
    while True:
        # the rows that are whole stay in this round's table
        whole.append(open_)
        left = open_.where("head is not null")
        if left.isEmpty():
            return whole
        known = reduce(DataFrame.unionByName, (t.where("head is null") for t in whole)).unionByName(left)
        ahead = known.select(F.col("node").alias("head"), F.col("path").alias("front"), F.col("head").alias("next"))
        longer = left.hint("merge").join(ahead, "head").select("node", F.concat("front", "path").alias("path"), F.col("next").alias("head"))
        open_ = written(longer, label)


_FOREST = "cell int, node long, cost double, prev long, entry long, number int, take array<long>, k int, line array<long>"


def _forest(tree: pd.DataFrame) -> pd.DataFrame:
    """The part of a tree (cell, node, cost, prev) in one cell as lines: a row for each node, and one for each line.

    A node without its predecessor in the cell is an entry. From there a line follows the child with the most nodes below
    it; every other child begins a line of its own. So each node is on one line, and the way from an entry to a node is a
    few beginnings of lines: ``take``, each as the line's number k and the nodes of it in one long. ``number`` counts the
    entries of the cell by id.
    """
    tree = tree.sort_values("node")
    nodes, cell = tree["node"].tolist(), int(tree["cell"].iloc[0])
    prev = [None if pd.isna(x) else int(x) for x in tree["prev"]]
    at = {v: i for i, v in enumerate(nodes)}
    ahead: list[list[int]] = [[] for _ in nodes]
    roots = []
    for i, u in enumerate(prev):
        (ahead[at[u]] if u in at else roots).append(i)
    order = list(roots)
    for i in order:
        order.extend(ahead[i])
    below = [1] * len(nodes)
    for i in reversed(order):
        below[i] += sum(below[j] for j in ahead[i])
    lines: list[list[int]] = []
    rows, heads = [], [(i, i, number, ()) for number, i in enumerate(roots)]
    for i, entry, number, before in heads:
        k, line = len(lines), []
        lines.append(line)
        while True:
            line.append(nodes[i])
            take = (*before, k << 32 | len(line))
            rows.append((i, nodes[entry], number, list(take)))
            if not ahead[i]:
                break
            longest = max(ahead[i], key=below.__getitem__)
            heads.extend((j, entry, number, take) for j in ahead[i] if j != longest)
            i = longest
    index, entry, number, take = zip(*rows, strict=True)
    found = pd.DataFrame({"cell": cell, "node": [nodes[i] for i in index], "cost": tree["cost"].to_numpy()[list(index)], "prev": pd.array([prev[i] for i in index], "Int64"), "entry": entry, "number": number, "take": take, "k": -1, "line": None})
    made = pd.DataFrame({"cell": cell, "node": 0, "cost": 0.0, "prev": pd.array([None] * len(lines), "Int64"), "entry": 0, "number": 0, "take": None, "k": range(len(lines)), "line": lines})
    return pd.concat([found, made], ignore_index=True)


def _way(take: Column, lines: Column) -> Column:
    """The beginnings of lines that a node's ``take`` names, as an array of arrays."""
    return F.transform(take, lambda x: F.slice(F.get(lines, F.shiftright(x, 32).cast("int")), F.lit(1), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")))


def shortest_paths(edges: DataFrame, source: int, stretch: int = STRETCH) -> DataFrame:
    """(node, cost, path): the nodes of a cheapest path from a source to every node that it reaches, both included.

    Costs must be above 0. Each node's predecessor is the neighbour whose cost leads to its own, of equal ones the
    smallest. All paths together grow with the square of a long network's length, so no path is ever written: the tree of
    predecessors is cut into cells of about ``stretch`` nodes, ranges of ids, and each cell into lines. A cell's row has its
    lines, and once each the ways through other cells that lead to its entries; nodes only name their parts of these. They
    are put together where the result is read.
    """
    edges = written(edges.select("a", "b", "cost"), "edges")
    cost = written(shortest_costs(edges, source), "costs")
    arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("cost").alias("c")).unionAll(edges.select("b", "a", "cost"))
    reached = arcs.join(cost.select(F.col("node").alias("u"), F.col("cost").alias("have")).hint("merge"), "u").where(F.col("v") != source)
    before = reached.groupBy(F.col("v").alias("node")).agg(F.min(F.struct((F.col("have") + F.col("c")).alias("sum"), "u")).alias("m"))
    tree = cost.join(before.hint("merge"), "node", "left").select("node", "cost", F.col("m.u").alias("prev"))
    dealt = written(tree.repartitionByRange(-(-cost.count() // stretch) or 1, "node").withColumn("cell", F.spark_partition_id()), "tree")
    forest = written(dealt.groupBy("cell").applyInPandas(_forest, _FOREST), "forest")
    for table in (edges, cost, dealt):
        discard(table)
    nodes = forest.where("k < 0")
    lines = written(forest.where("k >= 0").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("xs")).select("cell", F.transform("xs", lambda x: x["line"]).alias("lines")), "lines")
    # how an entry is reached: from which entry of another cell, and by which way through that cell; the source by none
    entries = nodes.where("node = entry").select("node", "cell", "number", "prev")
    last = nodes.select(F.col("node").alias("prev"), F.col("cell").alias("from"), F.col("entry").alias("head"), "take")
    met = entries.join(last.hint("merge"), "prev", "left").join(lines.hint("merge").withColumnRenamed("cell", "from"), "from", "left")
    entries = written(met.select("node", "cell", "number", "head", F.coalesce(F.flatten(_way(F.col("take"), F.col("lines"))), F.array().cast("array<long>")).alias("way")), "entries")
    rounds = _to_the_head(entries.select("node", F.array("node").alias("path"), "head"), "chains")
    chain = reduce(DataFrame.unionByName, (t.where("head is null") for t in rounds)).select("node", "path")
    chains = written(chain.join(entries.select("node", "cell", "number").hint("merge"), "node").select("cell", "number", F.col("path").alias("chain")), "chains")
    # the ways that lead to any entry of a cell, once each
    asked = chains.select("cell", F.explode("chain").alias("node")).distinct().join(entries.select("node", "way").hint("merge"), "node")
    asked = asked.groupBy("cell").agg(F.collect_list(F.struct("node", "way")).alias("ws")).select("cell", F.transform("ws", lambda x: x["way"]).alias("ways"), F.transform("ws", lambda x: x["node"]).alias("of"))
    # a cell's entries know their ways by place; entries are in the order of their numbers, which begin at 0
    each = chains.join(asked.select("cell", "of").hint("merge"), "cell").select("cell", "number", F.transform("chain", lambda x: F.array_position("of", x).cast("int")).alias("places"))
    fronts = each.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("number", "places"))).alias("es")).select("cell", F.transform("es", lambda x: x["places"]).alias("fronts"))
    cells = written(asked.select("cell", "ways").join(fronts.hint("merge"), "cell").join(lines.hint("merge"), "cell"), "cells")
    for table in (lines, entries, chains):
        discard(table)
    front = F.transform(F.get("fronts", F.col("number")), lambda k: F.get("ways", k - 1))
    return nodes.select("cell", "node", "cost", "number", "take").join(cells.hint("merge"), "cell").select("node", "cost", F.flatten(F.concat(front, _way(F.col("take"), F.col("lines")))).alias("path"))
