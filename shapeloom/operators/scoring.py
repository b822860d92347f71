"""The score of a finished route: five parts from measures of its walk, its target and the places along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeloom.functions.geo import band, haversine
from shapeloom.operators import outline
from shapeloom.operators.network import GREEN, GREENWAY_HINTS, nearest_at_any_distance
from shapeloom.operators.planner import along

# Weights of the parts; metres within which places count.
WEIGHTS = {"shape": 0.3, "safety": 0.25, "distance": 0.2, "district": 0.15, "logistics": 0.1}
SIGNALS, SUPPLY, LANDMARKS, FIRST_STOPS = 35.0, 220.0, 180.0, 1500.0


def shape_part(fit, closure, retrace, size):
    """The shape's part of the score."""
    return 0.50 * fit + 0.20 * band(closure, 30, 400) + 0.15 * band(retrace, 0.05, 0.40) + 0.15 * band(size / 25000.0 * 1000.0, 40, 12)


def safety_part(safety, signals_km, greenway, dead):
    """R2: safety, waiting at signals, greenways and dead ends."""
    return 0.45 * safety + 0.25 * band(signals_km, 1.5, 4) + 0.20 * F.least(F.lit(1.0), greenway / 0.35) + 0.10 * band(dead, 0, 6)


def distance_part(km, low, high, gain):
    """The length within its band, and the climb; an unknown climb counts 0.75."""
    off = F.when(km < low, low - km).otherwise(km - high)
    limit = 50.0 * km / 10.0
    up = F.when(gain.isNull(), 0.75).otherwise(band(gain, limit, limit * 3 + 30))
    return 0.70 * F.when(km.between(low, high), 1.0).otherwise(band(off, 0, 3)) + 0.30 * up


def district_part(aspect, low, high, greenway, marks):
    """The ratio of width to height within the district's band, greenways, and three landmarks."""
    off = F.when(aspect < low, low - aspect).otherwise(aspect - high)
    inside = F.when(aspect.between(low, high), 1.0).otherwise(band(off, 0, 0.9))
    return 0.40 * inside + 0.35 * F.least(F.lit(1.0), greenway / 0.30) + 0.25 * band(F.abs(F.least(marks.cast("double"), F.lit(3.0)) - 3), 0, 3)


def logistics_part(transit, gap_km):
    """The walk to a stop, and the longest way without supply."""
    return 0.55 * band(transit, 400, 1500) + 0.45 * band(gap_km, 3, 6)


def is_green(hw: Column, name: Column) -> Column:
    """Whether a road is a greenway, by its class or its name."""
    return F.coalesce(hw.isin(*GREEN), F.lit(False)) | F.coalesce(name.rlike("|".join(GREENWAY_HINTS)), F.lit(False))


def extents(w: DataFrame) -> DataFrame:
    """(key, closure, aspect): metres from a walk's end to its start; its width at the first vertex over its height."""
    first, last = (lambda c: F.min_by(c, "i")), (lambda c: F.max_by(c, "i"))
    box = w.groupBy("key").agg(
        F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("o"),
        first("lat").alias("lat0"), first("lon").alias("lon0"), last("lat").alias("lat1"), last("lon").alias("lon1"),
    )
    high, wide = haversine("s", "lon0", "n", "lon0"), haversine("lat0", "w", "lat0", "o")
    return box.select("key", haversine("lat0", "lon0", "lat1", "lon1").alias("closure"), F.when(high > 0, wide / high).otherwise(1.0).alias("aspect"))


def supply_gaps(w: DataFrame, places: DataFrame) -> DataFrame:
    """(key, gap_km): the longest way without supply within 220 m, from the start and to the end; all of it without any."""
    near = along(w, places, SUPPLY).select("key", F.col("at_m").alias("x"))
    total = w.groupBy("key").agg(F.sum("length").alias("length_m"))
    some = near.select("key").distinct()
    marks = near.unionByName(some.withColumn("x", F.lit(0.0))).unionByName(total.join(some, "key", "left_semi").select("key", F.col("length_m").alias("x")))
    gap = marks.withColumn("g", F.col("x") - F.lag("x").over(Window.partitionBy("key").orderBy("x"))).groupBy("key").agg((F.max("g") / 1000).alias("gap_km"))
    return total.join(gap, "key", "left").select("key", F.coalesce("gap_km", F.col("length_m") / 1000).alias("gap_km"))


def scores(w: DataFrame, errors: DataFrame, places: dict[str, DataFrame], degrees: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, the five parts, total, and the measures behind them) of walks.

    w: (key, i, node, next, lat, lon, length, before_m, safety_100, green), one row for each vertex with the road to the
    next, its safety in hundredths; a last vertex may have no length. errors: (key, error_m), the distance from the target. places: signals, supply,
    transit and landmarks as (ord, name, lat, lon). degrees: (node, degree). terms: (key, size_m, low_km, high_km,
    low_aspect, high_aspect, gain). A walk without a stop anywhere counts as if it were 9,999 m away; a gain that is not
    known counts 0.75.
    """
    again = F.col("next").isNotNull() & (F.row_number().over(Window.partitionBy("key", F.least("node", "next"), F.greatest("node", "next")).orderBy("i")) > 1)
    length = F.coalesce("length", F.lit(0.0))
    total = F.sum(length)
    share = lambda which: F.sum(F.when(which, length).otherwise(0.0)) / total
    table = w.withColumn("again", again).groupBy("key").agg(
        (total / 1000).alias("km"), (F.sum(F.col("safety_100") * length) / (100.0 * total)).alias("safety_mean"), share(F.col("green")).alias("greenway"), share(F.col("again")).alias("retrace")
    )
    at = lambda name, metres: along(w.where("before_m is not null"), places[name], metres).groupBy("key").agg(F.count("*").alias(name))
    dead = w.join(degrees, "node", "left").groupBy("key").agg(F.count_if(F.col("degree") == 1).alias("dead"))
    start = w.where("i = 0").select("key", "lat", "lon")
    transit = nearest_at_any_distance(start, "key", places["transit"].select(F.col("ord").alias("id"), "lat", "lon"), FIRST_STOPS).select("key", F.col("d").alias("transit"))
    for more in (extents(w), supply_gaps(w, places["supply"]), errors, dead, terms):
        table = table.join(more, "key")
    for more in (transit, at("signals", SIGNALS), at("landmarks", LANDMARKS)):
        table = table.join(more, "key", "left")
    c, none = F.col, F.lit(0)
    parts = {
        "shape": shape_part(outline.fidelity(c("error_m"), c("size_m")), c("closure"), c("retrace"), c("size_m")),
        "safety": safety_part(c("safety_mean"), F.coalesce("signals", none) / F.greatest("km", F.lit(0.1)), c("greenway"), c("dead")),
        "distance": distance_part(c("km"), c("low_km"), c("high_km"), c("gain")),
        "district": district_part(c("aspect"), c("low_aspect"), c("high_aspect"), c("greenway"), F.coalesce("landmarks", none)),
        "logistics": logistics_part(F.coalesce("transit", F.lit(9999.0)), c("gap_km")),
    }
    weighted = 100 * sum(WEIGHTS[k] * parts[k] for k in WEIGHTS)
    return table.select("key", *(v.alias(k) for k, v in parts.items()), weighted.alias("total"), "km", "safety_mean", "greenway", "retrace", "closure", "aspect", "gap_km", "error_m", "dead", "transit", "signals", "landmarks")
