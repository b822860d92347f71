"""What a picture of a route shows: its scale, the places of points on it, and the roads around."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.functions.geo import RADIUS, enu, haversine
from shapeloom.operators.network import own_cell
from shapeloom.operators.notes import MAIN_CLASSES

# Width of a picture, its height as a share of it, the margin, the head; how much more than the route it shows.
WIDTH, SHAPE, MARGIN, HEAD, MORE = 1600, 0.86, 90, 130, 1.15
HEIGHT = int(WIDTH * SHAPE)
#: Metres of the cells in which roads meet pictures.
CELL = 1_000.0
#: Degrees of latitude between the places at which a view looks for its cells: below a cell's height, so that no band is jumped over.
STEP = 0.99 * math.degrees(CELL / RADIUS)


def views(points: DataFrame) -> DataFrame:
    """(key, lat0, lon0, scale, half): the middle of all points (key, lat, lon) of a picture, pixels a metre, and half of
    the metres that it shows of the roads around."""
    box = points.groupBy("key").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    box = box.withColumns({"lat0": (F.col("s") + F.col("n")) / 2, "lon0": (F.col("w") + F.col("e")) / 2})
    box = box.withColumns({"high": haversine("s", "lon0", "n", "lon0"), "wide": haversine("lat0", "w", "lat0", "e")})
    scale = F.least((WIDTH - MARGIN * 2) / F.greatest("wide", F.lit(1.0)), (HEIGHT - HEAD - MARGIN) / F.greatest("high", F.lit(1.0)))
    return box.select("key", "lat0", "lon0", scale.alias("scale"), (F.greatest("wide", "high") * MORE / 2 * MORE).alias("half"))


def pixel(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Where a point lies on the picture of a row with lat0, lon0 and scale."""
    x, y = enu(F.col("lat0"), F.col("lon0"), lat, lon)
    return WIDTH / 2 + x * F.col("scale"), HEAD + (HEIGHT - HEAD) / 2 - y * F.col("scale")


def roads_in_view(shown: DataFrame, roads: DataFrame) -> DataFrame:
    """(key, a, b, ax, ay, bx, by, main): the roads whose first end lies in a view, with the pixels of both ends.

    roads: (a, b, alat, alon, blat, blon, hw). A view is dealt to the cells that it covers, so roads meet views by an
    equi-join; a view across 180 degrees or around a pole shows what lies between its west and east.
    """
    degrees = lambda c: F.degrees(F.col(c) / RADIUS)
    # the longitudes whose great circle along lat0 is as long as half
    wide = 2 * F.degrees(F.asin(F.least(F.sin(F.least(F.col("half") / (2 * RADIUS), F.lit(math.pi / 2))) / F.greatest(F.cos(F.radians("lat0")), F.lit(1e-6)), F.lit(1.0))))
    count = lambda half: F.ceil(2 * half / STEP).cast("int")
    lat = F.explode(F.transform(F.sequence(F.lit(0), count(degrees("half"))), lambda k: F.col("lat0") - degrees("half") + k * STEP))
    rows = shown.withColumn("y", lat)
    # cells are at least as wide as CELL at their own latitude; a step never jumps over one
    across = STEP / F.greatest(F.cos(F.radians("y")), F.lit(1e-6))
    lon = F.explode(F.transform(F.sequence(F.lit(0), F.ceil(2 * wide / across).cast("int") + 1), lambda k: F.col("lon0") - wide + (k - 0.5) * across))
    cells = rows.withColumn("x", lon).withColumn("cell", own_cell(F.col("y"), F.col("x"), CELL)).drop("x", "y").distinct()
    met = roads.withColumn("cell", own_cell(F.col("alat"), F.col("alon"), CELL)).join(cells, "cell")
    inside = (haversine("alat", "lon0", "lat0", "lon0") <= F.col("half")) & (haversine("lat0", "alon", "lat0", "lon0") <= F.col("half"))
    (ax, ay), (bx, by) = pixel(F.col("alat"), F.col("alon")), pixel(F.col("blat"), F.col("blon"))
    return met.where(inside).select("key", "a", "b", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), F.col("hw").isin(*MAIN_CLASSES).alias("main"))
