"""Routes that follow a shape on a road network: placing, snapping, routing, measuring and searching.

Every step treats all candidates of a round at once. A candidate is a row (key, shape, clat, clon, size_m, rot); its
control points meet the network by grid cells, the legs between them are routed by ``paths``, and all measures are joins
and aggregates over the steps of all routes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapeloom.functions.geo import enu_inverse, haversine
from shapeloom.operators import folds, outline
from shapeloom.operators.network import nearest, nearest_of_many, within
from shapeloom.operators.paths import Network, many, route_legs
from shapeloom.operators.staging import discard, written

# Farthest mean and single distance of control points from the network; metres of a leg that count as a
# detour; weights of the quick score; where its parts for snapping, detours and tilt begin and how far they reach; the
# climb's first steps of centre, rotation and size, what a round without gain leaves of them, and where it ends.
MEAN_SNAP, MAX_SNAP, LEG = 260.0, 416.0, 25.0
WEIGHTS = {"fidelity": 0.46, "safety": 0.16, "retrace": 0.08, "snap": 0.12, "detour": 0.10, "tilt": 0.08}
SNAP_REACH, DETOUR, DETOUR_REACH, TILT, TILT_REACH, RETRACE = 160.0, 1.3, 1.7, 25.0, 35.0, 2.5
STEPS, LESS, ENOUGH = (260.0, 6.0, 0.10), (0.55, 0.6, 0.6), 40.0
PLACE = ["clat", "clon", "size_m", "rot"]
#: Metres in which a control point looks for a node first; it changes the time alone.
FIRST_LOOK = MAX_SNAP / 4


def place(candidates: DataFrame, shapes: DataFrame) -> DataFrame:
    """(key, i, lat, lon): the outline (shape, i, x, y) of each candidate in its place; x and y have a long side of 1."""
    a = F.radians("rot")
    x, y = F.col("x") * F.col("size_m"), F.col("y") * F.col("size_m")
    lat, lon = enu_inverse("clat", "clon", x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a))
    return candidates.join(F.broadcast(shapes), "shape").select("key", "i", lat.alias("lat"), lon.alias("lon"))


def control_points(targets: DataFrame) -> DataFrame:
    """(key, i, j, lat, lon): every vertex (j = 0), and points between vertices that are farther apart than the gap.

    The gap is 60 m, or a fortieth of the outline where that is more.
    """
    line = Window.partitionBy("key").orderBy("i")
    step = targets.withColumns({"lat2": F.lead("lat").over(line), "lon2": F.lead("lon").over(line)})
    step = step.withColumn("d", F.coalesce(haversine("lat", "lon", "lat2", "lon2"), F.lit(0.0)))
    gap = F.greatest(F.lit(60.0), F.sum("d").over(Window.partitionBy("key")) / 40.0)
    step = step.withColumn("n", F.floor(F.col("d") / gap)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), "n")))
    t = F.col("j") / (F.col("n") + 1.0)
    between = lambda a, b: F.when(F.col("j") == 0, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * t).alias(a)
    return step.select("key", "i", "j", between("lat", "lat2"), between("lon", "lon2"))


def snap(points: DataFrame, net: Network) -> DataFrame:
    """(key, stops, snap_mean): the nodes that a candidate's control points snap to, as a closed ring; a table of its own.

    Repeats in a row are dropped. A candidate is left out with fewer than four stops, with a mean distance above 260 m
    or a single one above 416 m.
    """
    points = written(points.select("key", "i", "j", "lat", "lon"), "points")
    near, scratch = nearest_of_many(points, net.nodes, MAX_SNAP, FIRST_LOOK, few_cells=True, waiting=net.waiting if net.arrays or many(points, net.nodes) else None)
    total = points.groupBy("key").agg(F.count("*").alias("total"))
    seen = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "j", "node"))).alias("xs"), F.avg("d").alias("snap_mean"), F.count("*").alias("n"))
    stops = F.transform(F.filter("xs", lambda x, k: (k == 0) | (F.get("xs", k - 1)["node"] != x["node"])), lambda x: x["node"])
    good = seen.join(total, "key").where((F.col("n") == F.col("total")) & (F.col("snap_mean") <= MEAN_SNAP)).select("key", "snap_mean", stops.alias("stops"))
    ring = F.when(F.get("stops", F.lit(0)) == F.element_at("stops", -1), F.col("stops")).otherwise(F.concat("stops", F.slice("stops", 1, 1)))
    rings = written(good.where(F.size("stops") >= 4).select("key", ring.alias("stops"), "snap_mean"), "stops")
    for table in (scratch, points):
        discard(table)
    return rings


def routes(candidates: DataFrame, shapes: DataFrame, net: Network) -> tuple[DataFrame, DataFrame]:
    """The routes (key, seq, snap_mean, worst) and targets (key, target) of all candidates that can be built.

    worst: the largest ratio of a leg's metres to the straight line, among legs of more than 25 m. Spurs A-B-A of the
    joined paths are collapsed.
    """
    targets = place(candidates, shapes)
    ring = snap(control_points(targets), net)
    hops = F.transform(F.sequence(F.lit(0), F.size("stops") - 2), lambda k: F.struct(F.get("stops", k).alias("a"), F.get("stops", k + 1).alias("b")))
    legs = ring.select("key", "snap_mean", F.posexplode(hops).alias("leg", "hop")).select("key", "snap_mean", "leg", "hop.*").where("a <> b")
    paths = route_legs(legs, net)
    a, b = (net.nodes.select(F.col("id").alias(x), F.col("lat").alias(f"{x}lat"), F.col("lon").alias(f"{x}lon")) for x in "ab")
    routed = paths.join(a, "a").join(b, "b").withColumn("straight", haversine("alat", "alon", "blat", "blon"))
    detour = F.when(F.col("straight") > LEG, F.col("metres") / F.col("straight"))
    joined = legs.join(routed.select("a", "b", "path", detour.alias("detour")), ["a", "b"], "left")
    whole = joined.groupBy("key").agg(
        F.first("snap_mean").alias("snap_mean"), F.coalesce(F.max("detour"), F.lit(1.0)).alias("worst"),
        F.sort_array(F.collect_list(F.struct("leg", "path"))).alias("xs"), F.bool_and(F.col("path").isNotNull()).alias("whole"),
    ).where("whole")
    joints = F.flatten(F.transform("xs", lambda x: F.slice(x["path"], F.lit(1), F.size(x["path"]) - 1)))
    seq = F.concat(joints, F.array(F.element_at(F.element_at("xs", -1)["path"], -1)))
    made = whole.select("key", folds.collapse_backtracks(seq).alias("seq"), "snap_mean", "worst").where(F.size("seq") > 2)
    outlines = targets.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "lat", "lon"))).alias("target"))
    return made, outlines


def steps(found: DataFrame, net: Network) -> DataFrame:
    """(key, i, node, lat, lon, next and the attributes of the road to it): the last step has no road.

    The network has one road for each pair of nodes.
    """
    return steps_over(found, net.nodes, net.attributes.drop("cost"))


def steps_over(found: DataFrame, nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """The steps of routes (key, seq) over nodes (id, lat, lon) and roads (a, b, length, ...), one for each pair of nodes."""
    rows = found.select("key", F.posexplode("seq").alias("i", "node"))
    rows = rows.withColumn("next", F.lead("node").over(Window.partitionBy("key").orderBy("i")))
    return with_roads(rows.join(nodes.select(F.col("id").alias("node"), "lat", "lon"), "node"), roads)


def with_roads(rows: DataFrame, roads: DataFrame, ordered: bool = False) -> DataFrame:
    """Vertices (key, i, node, next, lat, lon) with the road to the next; the last one has none.

    ordered: every road has a < b. Then roads that are grouped by both ends are not shuffled again.
    """
    road = roads.withColumnsRenamed({"a": "u", "b": "v"}) if ordered else roads.withColumns({"u": F.least("a", "b"), "v": F.greatest("a", "b")}).drop("a", "b")
    pair = rows.withColumns({"u": F.least("node", F.coalesce("next", F.lit(-1))), "v": F.greatest("node", "next")})
    return pair.join(road, ["u", "v"], "left")


def sums(walked: DataFrame, with_points: bool = True) -> DataFrame:
    """Per route: length_m, safety, retrace (share of roads walked before), points (array of i, lat, lon in order).

    Steps without a road have no length; a route without any has null shares. Without points their number ``n`` is given,
    so that only numbers are grouped.
    """
    again = F.row_number().over(Window.partitionBy("key", "u", "v").orderBy("i")) > 1
    length = F.coalesce("length", F.lit(0.0))
    rows = walked.withColumn("again", again & F.col("next").isNotNull())
    total = F.sum(length)
    points = F.sort_array(F.collect_list(F.struct("i", "lat", "lon"))).alias("points") if with_points else F.count("*").alias("n")
    return rows.groupBy("key").agg(
        total.alias("length_m"), F.try_divide(F.sum(F.col("safety") * length), total).alias("safety"),
        F.try_divide(F.sum(F.when(F.col("again"), length).otherwise(0.0)), total).alias("retrace"), points,
    )


def quick_scores(candidates: DataFrame, shapes: DataFrame, net: Network) -> DataFrame:
    """Candidates that can be built, with seq, km, error_m, fidelity, safety, retrace, snap_mean, worst and score."""
    made, targets = routes(candidates, shapes, net)
    made = written(made, "routes")
    table = sums(steps(made, net)).join(made, "key").join(targets, "key").join(candidates, "key")
    table = table.withColumn("error_m", outline.error(F.col("points"), F.col("target")))
    c, part = F.col, lambda x: 1 - F.least(F.lit(1.0), x)
    fit = outline.fidelity(c("error_m"), c("size_m"))
    parts = {
        "fidelity": fit, "safety": c("safety"), "retrace": part(c("retrace") * RETRACE), "snap": part(c("snap_mean") / SNAP_REACH), "detour": part((c("worst") - DETOUR) / DETOUR_REACH),
        "tilt": part(F.greatest(F.lit(0.0), F.abs("rot") - TILT) / TILT_REACH),
    }
    score = sum(w * parts[k] for k, w in WEIGHTS.items())
    km = (c("length_m") / 1000).alias("km")
    return table.select("key", "shape", *PLACE, "seq", km, "error_m", fit.alias("fidelity"), "safety", "retrace", "snap_mean", "worst", score.alias("score"))


def coarse(jobs: DataFrame, shapes: DataFrame, net: Network, rotations=(-24, -16, -8, 0, 8, 16, 24)) -> DataFrame:
    """The best of 25 centres and seven rotations of each job (job, shape, km, south, west, north, east, perimeter).

    The size makes the outline a twelfth shorter than the wanted length. Centres without a node in 600 m are left out.
    Of equal scores the first counts, by centre from south to north, west to east, then by the order of rotations.
    """
    fifths = F.explode(F.sequence(F.lit(1), F.lit(5)))
    grid = jobs.withColumn("ci", fifths).withColumn("cj", fifths)
    grid = grid.withColumns({"clat": F.expr("south + (north - south) * ci / 6"), "clon": F.expr("west + (east - west) * cj / 6")})
    grid = grid.withColumn("centre", F.concat_ws("/", "job", "ci", "cj"))
    near = nearest(grid.select("centre", F.col("clat").alias("lat"), F.col("clon").alias("lon")), "centre", net.nodes, 600.0)
    grid = grid.join(near.select("centre"), "centre", "left_semi")
    grid = grid.select("*", F.posexplode(F.array(*(F.lit(float(r)) for r in rotations))).alias("turn", "rot"))
    size = (F.col("km") * 1000.0 / F.col("perimeter") / 1.12).alias("size_m")
    order = (F.col("ci") * 1000 + F.col("cj") * 100 + F.col("turn")).alias("move")
    tried = grid.select(F.concat_ws("/", "centre", "turn").alias("key"), "job", "shape", "clat", "clon", size, "rot", order)
    scored = _scored(tried, shapes, net)
    columns = [c for c in scored.columns if c not in ("job", "move")]
    best = scored.groupBy("job").agg(F.min_by(F.struct(*columns), F.struct((-F.col("score")).alias("s"), "move")).alias("b"))
    kept = written(best.select("job", "b.*"), "best")
    discard(scored)
    return kept


def _scored(tried: DataFrame, shapes: DataFrame, net: Network) -> DataFrame:
    """Quick scores of (key, job, shape, place, move), with job and move."""
    tried = written(tried, "tried")
    scored = written(quick_scores(tried.drop("job", "move"), shapes, net).join(tried.select("key", "job", "move"), "key"), "scored")
    discard(tried)
    return scored


def _moved(live: DataFrame, moves: list[tuple], shapes: DataFrame, net: Network) -> DataFrame:
    """(job, tries): the scores of all moves (number, east, north, turn, factor of size) by number that can be built."""
    move = F.explode(F.array(*(F.struct(*(v.alias(n) for v, n in zip(t, "kxyrs", strict=True))) for t in moves)))
    tried = live.select("job", "shape", *PLACE, "step_m", "step_r", "step_s", move.alias("t")).withColumn("move", F.col("t.k"))
    lat, lon = enu_inverse("clat", "clon", F.col("t.x"), F.col("t.y"))
    at = {"clat": lat, "clon": lon, "size_m": F.col("size_m") * F.col("t.s"), "rot": F.col("rot") + F.col("t.r")}
    scored = _scored(tried.select(F.concat_ws("/", "job", "move").alias("key"), "job", "shape", *(v.alias(k) for k, v in at.items()), "move"), shapes, net)
    columns = [c for c in scored.columns if c not in ("job", "move")]
    tries = written(scored.groupBy("job").agg(F.map_from_entries(F.collect_list(F.struct("move", F.struct(*columns)))).alias("tries")), "tries")
    discard(scored)
    return tries


def climb(best: DataFrame, shapes: DataFrame, net: Network, rounds: int = 9) -> DataFrame:
    """Hill climbing: a job takes each move that improves it at once, in the order centre, rotation, size.

    The six moves of the centre start from the round's first place; turns and sizes start from what the centre came to.
    All that this order can lead to is measured together, since a round costs far more than its candidates: each of the
    seven places with each turn and size, where a larger size may be followed by a smaller one, a turn by no other. A job
    whose round brings nothing goes on with smaller steps, and stops once a step is below 40 m.
    """
    state = best.withColumns({n: F.lit(v) for n, v in zip(("step_m", "step_r", "step_s"), STEPS, strict=True)})
    columns = [c for c in best.columns if c not in ("job",)]
    zero = F.lit(0.0)
    m, r, s = F.col("step_m"), F.col("step_r"), F.col("step_s")
    centres = [(zero, zero), (m, zero), (-m, zero), (zero, m), (zero, -m), (m, m), (-m, -m)]
    turns, sizes = (zero, r, -r), (F.lit(1.0), 1 + s, 1 - s, (1 + s) * (1 - s))
    ways = [(*c, t, f) for c in centres for t in turns for f in sizes]
    moves = [(F.lit(k), *way) for k, way in enumerate(ways)][1:]

    def gains(cur, other):
        return F.coalesce(other["score"] > cur["score"], F.lit(False))

    def better(cur, other):
        return F.when(gains(cur, other), other).otherwise(cur)

    for _ in range(rounds):
        live = state.where(F.col("step_m") >= ENOUGH)
        if live.isEmpty():
            break
        tried = _moved(live, moves, shapes, net)
        step = len(turns) * len(sizes)
        start = F.struct(F.struct(*columns).alias("cur"), F.lit(0).alias("base"))
        # a move of the centre counts against what the moves before it came to
        moved = F.aggregate(
            F.array(*(F.lit(k * step) for k in range(1, len(centres)))), start,
            lambda a, k: F.when(gains(a["cur"], F.col("tries")[k]), F.struct(F.col("tries")[k].alias("cur"), k.alias("base"))).otherwise(a),
        )
        joined = state.join(tried, "job", "left").select("job", "tries", "step_m", "step_r", "step_s", F.col("score").alias("before"), moved.alias("at")).select("*", "at.*")
        at = lambda turn, size: F.col("tries")[F.col("base") + (turn * len(sizes) + size)]
        turn = F.when(gains(F.col("cur"), at(1, 0)), 1).when(gains(F.col("cur"), at(2, 0)), 2).otherwise(0)
        joined = joined.withColumn("turn", turn).withColumn("cur", F.when(F.col("turn") > 0, at(F.col("turn"), 0)).otherwise(F.col("cur")))
        size = lambda k: at(F.col("turn"), k)
        joined = joined.withColumn("larger", gains(F.col("cur"), size(1)))
        joined = joined.withColumn("cur", F.when(F.col("larger"), better(size(1), size(3))).otherwise(better(F.col("cur"), size(2))))
        gained = F.col("cur.score") > F.col("before")
        after = (F.when(gained, F.col(n)).otherwise(F.col(n) * f).alias(n) for n, f in zip(("step_m", "step_r", "step_s"), LESS, strict=True))
        old, state = state, written(joined.select("job", "cur.*", *after), "state")
        for table in (old, tried):
            discard(table)
    return state.drop("step_m", "step_r", "step_s")


def along(points: DataFrame, poi: DataFrame, metres: float) -> DataFrame:
    """(key, ord, d, at_m): places within ``metres`` of a route's vertices, and the mileage of the nearest vertex.

    points: (key, i, lat, lon, before_m) of all vertices but the last; of equally near ones the first counts.
    """
    near = within(points, poi.select("ord", F.col("lat").alias("rlat"), F.col("lon").alias("rlon")), metres, spread="right")
    best = near.groupBy("key", "ord").agg(F.min(F.struct("d", "i", "before_m")).alias("m"))
    return best.select("key", "ord", "m.d", F.col("m.before_m").alias("at_m"))


def along_nodes(steps: DataFrame, nodes: DataFrame, poi: DataFrame, metres: float) -> DataFrame:
    """What along() gives, of steps (key, i, node, before_m) that know their nodes (id, lat, lon) and no places.

    Places meet the nodes, which are far fewer than the steps of all routes; only steps at these nodes go on.
    """
    places = poi.select("ord", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    near = written(within(nodes.select(F.col("id").alias("node"), "lat", "lon"), places, metres, spread="right").select("node", "ord", "d"), "near")
    # a table of its own, so that its size is known: a few nodes are looked up where the steps lie
    met = steps.join(written(near.select("node").distinct(), "met"), "node", "left_semi").join(near, "node")
    best = met.groupBy("key", "ord").agg(F.min(F.struct("d", "i", "before_m")).alias("m"))
    return best.select("key", "ord", "m.d", F.col("m.before_m").alias("at_m"))
