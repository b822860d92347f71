"""Queries that plan routes: a shape is placed in every district, snapped to the network, routed, scored and searched."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from shapeloom.operators import network as N
from shapeloom.operators import paths, plan
from shapeloom.operators import planner as P
from shapeloom.operators import scoring as S
from shapeloom.operators.staging import written
from shapeloom.plans.catalog import query
from shapeloom.plans.fixtures import view
from shapeloom.plans.graph_queries import edges

# The paw's toes, right to left: centre and radius; the pad's centre and half axes; the toes' stretch.
TOES = ((0.845, 0.660, 0.115), (0.635, 0.815, 0.125), (0.375, 0.820, 0.125), (0.165, 0.655, 0.115))
PAD, STRETCH = (0.5, 0.33, 0.36, 0.27), (1.15, 1.35)
#: Kilometres of the standard level.
LOW_KM, HIGH_KM = 5.0, 8.0


def paw() -> list[tuple[float, float]]:
    """The paw as one outline: an arc below for the pad, then half an ellipse for each toe."""
    x, y, wide, high = PAD
    turn = [math.pi * (1 - k / 28) for k in range(29)]
    points = [(x + wide * math.cos(a), y - high * math.sin(a)) for a in turn]
    half = [math.pi * k / 14 for k in range(15)]
    return points + [(x + r * math.cos(a) * STRETCH[0], y + r * math.sin(a) * STRETCH[1]) for x, y, r in TOES for a in half]


def normalised(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Closed, centred, with a long side of 1."""
    points = points if points[0] == points[-1] else [*points, points[0]]
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*points, strict=True))
    side = max(x1 - x0, y1 - y0)
    return [((x - (x0 + x1) / 2) / side, (y - (y0 + y1) / 2) / side) for x, y in points]


def shapes(spark):
    return spark.createDataFrame([("paw", i, x, y) for i, (x, y) in enumerate(normalised(paw()))], "shape string, i int, x double, y double")


def network(spark, d):
    """The largest connected part of the network, with one road for each pair of nodes, the cheapest."""
    rows = edges(spark, d).where("a <> b").where(~F.col("hw").isin(*N.EXCLUDED))
    pair = rows.withColumns({"u": F.least("a", "b"), "v": F.greatest("a", "b")})
    kept = F.struct("length", "cost", "safety", "hw", "name")
    # roads without length don't count; as a filter, this would measure every road twice
    best = F.min_by(kept, F.when(F.col("length") > 0, F.struct("cost", "a"))).alias("r")
    roads = pair.groupBy("u", "v").agg(best).where("r is not null").select(F.col("u").alias("a"), F.col("v").alias("b"), "r.*")
    roads = written(roads, "roads")
    # roads of other parts lead to nodes that are not there
    part = N.largest_component_nodes(roads).hint("merge")
    return paths.prepare(view(spark, d, "nodes").select("id", "lat", "lon").join(part, "id", "left_semi"), roads)


def jobs(spark, d):
    """One job for each district: the paw, six and a half kilometres long, in a band of the network's map."""
    points = normalised(paw())
    around = sum(math.dist(p, q) for p, q in zip(points, points[1:]))
    box = view(spark, d, "nodes").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    step = (F.col("n") - F.col("s")) / 30
    rows = view(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("job"), F.col("n_nationkey").alias("k")).crossJoin(F.broadcast(box))
    south = F.col("s") + step * F.col("k")
    return rows.select("job", F.lit("paw").alias("shape"), F.lit((LOW_KM + HIGH_KM) / 2).alias("km"), south.alias("south"), (south + step * 6).alias("north"), "west", "east", F.lit(around).alias("perimeter"))


@query()
def g5_j2_g6_snapped_routes(spark, d):
    """The paw in the middle of every district, snapped and routed: every step with its road."""
    net = network(spark, d)
    j = jobs(spark, d).withColumn("size_m", F.col("km") * 1000.0 / F.col("perimeter") / 1.12)
    middle = j.select(F.col("job").alias("key"), "shape", ((F.col("south") + F.col("north")) / 2).alias("clat"), ((F.col("west") + F.col("east")) / 2).alias("clon"), "size_m", F.lit(0.0).alias("rot"))
    made, _ = P.routes(middle, shapes(spark), net)
    walked = P.steps(written(made, "routes"), net)
    return walked.select("key", "i", "node", "next", "length", "safety", "hw")


@query()
def g7_g8_search(spark, d):
    """The best of 25 centres and seven rotations in every district, and nine rounds of hill climbing."""
    net = network(spark, d)
    best = P.climb(P.coarse(jobs(spark, d), shapes(spark), net), shapes(spark), net)
    return best.select("job", "clat", "clon", "size_m", "rot", "km", "fidelity", "score")


@query()
def g12_g13_g9_plan_best(spark, d):
    """A finished route of every district, fitted to its band, scored and ranked; failures as rows.

    One more district lies where no roads are, one asks for a shape and one for a level that nobody knows.
    """
    net = network(spark, d)
    found = jobs(spark, d).select("job", "shape", F.lit("standard").alias("level"), "south", "west", "north", "east")
    odd = found.where("job = '0'")
    odd = odd.withColumns({"job": F.lit("sea"), "south": F.lit(10.0), "north": F.lit(10.1)}).unionByName(odd.withColumns({"job": F.lit("shapeless"), "shape": F.lit("none")}))
    odd = odd.unionByName(found.where("job = '1'").withColumns({"job": F.lit("levelless"), "level": F.lit("none")}))
    asked = found.unionByName(odd).withColumns({"low_aspect": F.lit(0.7), "high_aspect": F.lit(1.6)})
    levels = spark.createDataFrame([("standard", LOW_KM, HIGH_KM)], "level string, low_km double, high_km double")
    poi = view(spark, d, "poi")
    places = {name: poi.where(F.col("layer") == k).select("ord", "name", "lat", "lon") for name, k in (("signals", 0), ("supply", 2), ("transit", 3), ("landmarks", 4))}
    columns = ("job", "error", "rank", "total", *S.WEIGHTS, "km", "fitted", "clat", "clon", "size_m", "rot", "fidelity", "n_nodes")
    return plan.plan(asked, shapes(spark), levels, net, places).select(*columns)
