"""Safety notes of routes: unlit stretches, crossings without signals, and main roads, in order and thinned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapeloom.operators import folds
from shapeloom.operators.planner import along, along_nodes

# Kinds of notes with their texts, in the order in which notes at one place stand; metres of an unlit
# stretch and of a main road that count, and how near a crossing lies to a route; classes of main roads; signalled crossings.
DARK, CROSSING, MAIN = "夜間照明", "無號誌路口", "幹道路段"
DARK_TEXT, CROSSING_TEXT, MAIN_TEXT = "無路燈標記路段約 %d 公尺，夜跑請帶頭燈", "無號誌斑馬線／穿越點%s，過馬路請停看", "%s 為主要幹道（%d 公尺），車流較快請走人行道"
DARK_METRES, MAIN_METRES, NEAR = 120.0, 200.0, 25.0
MAIN_CLASSES, SIGNALLED, UNNAMED = ("primary", "secondary"), ("traffic_signals", "signals"), "此路段"


def sources(w: DataFrame, crossings: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(key, km, src, ord, type, text) of all notes. w: (key, i, lat, lon, length, before_m, hw, lit, name), one row for
    each vertex with the road to the next; crossings: (ord, lat, lon, name, kind). km has two decimals.
    With nodes (id, lat, lon), w has a column node instead of lat and lon."""
    km = lambda metres: F.bround(metres / 1000.0, 2)
    walked = w.where("length is not null")
    line = Window.partitionBy("key").orderBy("i")
    runs = walked.withColumn("run", F.row_number().over(line) - F.row_number().over(Window.partitionBy("key", F.col("lit") == "no").orderBy("i"))).where("lit = 'no'")
    runs = runs.groupBy("key", "run").agg(F.min("i").cast("long").alias("ord"), F.min("before_m").alias("from_m"), F.sum("length").alias("metres")).where(F.col("metres") >= DARK_METRES)
    dark = runs.select("key", km(F.col("from_m")).alias("km"), F.lit(0).alias("src"), "ord", F.lit(DARK).alias("type"), F.format_string(DARK_TEXT, F.bround("metres").cast("long")).alias("text"))
    open_ = crossings.where(~F.coalesce("kind", F.lit("")).isin(*SIGNALLED))
    near = (along(w, open_, NEAR) if nodes is None else along_nodes(w, nodes, open_, NEAR)).join(open_.select("ord", "name"), "ord")
    called = F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit("（"), F.col("name"), F.lit("）"))).otherwise("")
    cross = near.select("key", km(F.col("at_m")).alias("km"), F.lit(1).alias("src"), "ord", F.lit(CROSSING).alias("type"), F.format_string(CROSSING_TEXT, called).alias("text"))
    large = walked.where(F.col("hw").isin(*MAIN_CLASSES) & (F.col("length") >= MAIN_METRES))
    label = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(UNNAMED)
    main = large.select("key", km(F.col("before_m")).alias("km"), F.lit(2).alias("src"), F.col("i").cast("long").alias("ord"), F.lit(MAIN).alias("type"), F.format_string(MAIN_TEXT, label, F.bround("length").cast("long")).alias("text"))
    return dark.unionByName(cross).unionByName(main)


def safety_notes(w: DataFrame, crossings: DataFrame) -> DataFrame:
    """(key, place, km, type, text): the notes of each route by km, those at one place in the order of their kinds.

    A note of the last kept note's kind within 350 m of it is left out. Routes without a note have no row.
    """
    rows = folds.ordered(sources(w, crossings), "key", ["km", "src", "ord"], ["type", "text"])
    kept = rows.select("key", F.posexplode(folds.thin_notes(F.col("xs"))).alias("place", "n"))
    return kept.select("key", (F.col("place") + 1).cast("long").alias("place"), "n.km", "n.type", "n.text")
