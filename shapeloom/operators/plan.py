"""Plans of whole routes: searched, fitted to a band of lengths and scored, for many jobs at once, failures as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeloom.operators import planner as P
from shapeloom.operators import scoring as S
from shapeloom.operators import search
from shapeloom.operators.network import degrees, nearest
from shapeloom.operators.paths import Network
from shapeloom.operators.ranges import numbered
from shapeloom.operators.staging import written

# What a job's failure says.
NO_SHAPE, NO_LEVEL, NO_MAP, NO_ROADS, NO_PLACE = "no such shape", "no such level", "no map window", "no road within 600 m of a centre", "no placement that can be built"


def perimeters(shapes: DataFrame) -> DataFrame:
    """(shape, perimeter) of outlines (shape, i, x, y)."""
    line = Window.partitionBy("shape").orderBy("i")
    hop = F.hypot(F.col("x") - F.lag("x").over(line), F.col("y") - F.lag("y").over(line))
    return shapes.withColumn("hop", hop).groupBy("shape").agg(F.sum("hop").alias("perimeter"))


def builds(placed: DataFrame, shapes: DataFrame, net: Network):
    """How long routes of other sizes get: a measure for ``search``. placed: (key, shape, clat, clon, rot).

    A size that cannot be built gives no row.
    """

    def at(sizes: DataFrame) -> DataFrame:
        return sizes.join(placed.select(F.col("key"), "shape", "clat", "clon", "rot"), "key").select(
            F.concat_ws("/", "key", "side").alias("try"), "key", "side", "shape", "clat", "clon", F.col("size").alias("size_m"), "rot"
        )

    def candidates(tried: DataFrame) -> DataFrame:
        return tried.select(F.col("try").alias("key"), "shape", *P.PLACE)

    def measure(sizes: DataFrame) -> DataFrame:
        tried = written(at(sizes), "tried")
        made, _ = P.routes(candidates(tried), shapes, net)
        km = P.sums(P.steps(written(made, "routes"), net), with_points=False).select(F.col("key").alias("try"), (F.col("length_m") / 1000).alias("km"))
        return tried.join(km, "try").select("key", "side", F.col("size_m").alias("size"), "km")

    def score(sizes: DataFrame) -> DataFrame:
        tried = written(at(sizes), "tried")
        scored = P.quick_scores(candidates(tried), shapes, net).select(F.col("key").alias("try"), "km", "score", "seq", "error_m", "fidelity")
        return tried.join(scored, "try").select("key", "side", F.col("size_m").alias("size"), "km", "score", "seq", "error_m", "fidelity")

    return measure, score


def fit(best: DataFrame, shapes: DataFrame, net: Network, rounds: int = 16) -> DataFrame:
    """The routes of climb() in the size of five between both ends of their band that scores best.

    best: what climb() returns, with low_km and high_km. Returned are its rows with size_m, km, score, seq, error_m and
    fidelity of that size, and fitted; a route of which no size lies in its band stays as it was, not fitted.
    """
    best = written(best, "best")
    routes = best.select(F.col("job").alias("key"), F.col("size_m").alias("size"), F.col("low_km").alias("lo_km"), F.col("high_km").alias("hi_km"))
    measure, score = builds(best.select(F.col("job").alias("key"), "shape", *P.PLACE), shapes, net)
    found = search.fit_band(routes, measure, score, rounds, keep=("seq", "error_m", "fidelity")).withColumnRenamed("key", "job")
    both = best.join(found.select("job", "fitted", *(F.col(c).alias(f"new_{c}") for c in ("size", "km", "score", "seq", "error_m", "fidelity"))), "job")
    renamed = {"size_m": "new_size", "km": "new_km", "score": "new_score", "seq": "new_seq", "error_m": "new_error_m", "fidelity": "new_fidelity"}
    return both.select(*(F.when(F.col("fitted"), F.col(renamed[c])).otherwise(F.col(c)).alias(c) if c in renamed else F.col(c) for c in best.columns), "fitted")


def walks(found: DataFrame, net: Network, attributes: dict[str, Column]) -> DataFrame:
    """What ``scoring`` measures of routes (key, seq): their vertices with the road to the next, and the way before."""
    line = Window.partitionBy("key").orderBy("i")
    before = F.coalesce(F.sum("length").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return P.steps(found, net).withColumn("before_m", before).select("key", "i", "node", "next", "lat", "lon", "length", "before_m", *(c.alias(n) for n, c in attributes.items()))


def plan(
    jobs: DataFrame, shapes: DataFrame, levels: DataFrame, net: Network, places: dict[str, DataFrame], climb_rounds: int = 9, fit_rounds: int = 16, gains: DataFrame | None = None,
    attributes: dict[str, Column] | None = None,
) -> DataFrame:
    """One row for each job: its finished route and score, or what stopped it (``error``); a job's failure touches no other.

    jobs: (job, shape, level, south, west, north, east, low_aspect, high_aspect). shapes: (shape, i, x, y). levels:
    (level, low_km, high_km). places: as scores() takes them. gains: (job, gain), the climb of a job's route, where it is
    known. attributes: expressions of a step's safety_100 and green over the columns of the network's roads. Finished routes
    have place, km, size_m, rot, fitted, the five parts, total and rank among all finished ones, the best total first,
    ties by job; other jobs have these null. A repeated job counts once, a job without a name not at all. An empty table
    gives no rows.
    """
    attributes = attributes or {"safety_100": F.col("safety") * 100, "green": S.is_green(F.col("hw"), F.col("name"))}
    jobs = written(jobs.where("job is not null").dropDuplicates(["job"]), "jobs")
    asked = jobs.join(perimeters(shapes), "shape", "left").join(levels, "level", "left")
    whole = F.col("south").isNotNull() & F.col("west").isNotNull() & (F.col("south") < F.col("north")) & (F.col("west") < F.col("east"))
    why = F.when(F.col("perimeter").isNull(), NO_SHAPE).when(F.col("low_km").isNull() | F.col("high_km").isNull(), NO_LEVEL).when(~F.coalesce(whole, F.lit(False)), NO_MAP)
    asked = written(asked.withColumn("km", (F.col("low_km") + F.col("high_km")) / 2).withColumn("error", why), "asked")
    ready = asked.where("error is null").select("job", "shape", "km", "south", "west", "north", "east", "perimeter")
    found = P.coarse(ready, shapes, net)
    found = P.climb(found, shapes, net, climb_rounds).join(asked.select("job", "low_km", "high_km"), "job")
    found = written(fit(found, shapes, net, fit_rounds), "fitted")
    w = written(walks(found.select(F.col("job").alias("key"), "seq"), net, attributes), "walks")
    gain = F.lit(None).cast("double") if gains is None else F.col("gain")
    terms = found.join(asked.select("job", "low_aspect", "high_aspect"), "job")
    terms = (terms if gains is None else terms.join(gains, "job", "left")).select(F.col("job").alias("key"), "size_m", "low_km", "high_km", "low_aspect", "high_aspect", gain.alias("gain"))
    scored = S.scores(w, found.select(F.col("job").alias("key"), "error_m"), places, degrees(net.roads), terms).drop("km", "error_m").withColumnRenamed("key", "job")
    finished = written(found.select("job", *P.PLACE, "km", "fitted", "fidelity", F.size("seq").alias("n_nodes")).join(scored, "job"), "finished")
    near = _near_roads(asked.where("error is null"), net)
    said = F.coalesce("error", F.when(F.col("total").isNotNull(), None).when(F.col("any").isNull(), NO_ROADS).otherwise(NO_PLACE))
    rows = asked.select("job", "error").join(near, "job", "left").join(finished, "job", "left").withColumn("error", said).drop("any")
    return rows.join(numbered(finished.select("job", "total"), [F.col("total").desc(), "job"], "rank").select("job", "rank"), "job", "left")


def _near_roads(asked: DataFrame, net: Network) -> DataFrame:
    """(job, any) of jobs that have a node within 600 m of one of their 25 centres."""
    fifths = F.explode(F.sequence(F.lit(1), F.lit(5)))
    at = asked.select("job", "south", "west", "north", "east").withColumn("ci", fifths).withColumn("cj", fifths)
    at = at.select(F.concat_ws("/", "job", "ci", "cj").alias("key"), "job", F.expr("south + (north - south) * ci / 6").alias("lat"), F.expr("west + (east - west) * cj / 6").alias("lon"))
    return at.join(nearest(at, "key", net.nodes, 600.0).select("key"), "key", "left_semi").select("job", F.lit(True).alias("any")).distinct()
