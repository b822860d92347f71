"""Queries of the codec, of raster tracing and of the placement search: rows only, tests hold their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from shapeloom.operators import network as N
from shapeloom.operators import raster
from shapeloom.operators.staging import written
from shapeloom.plans.catalog import query
from shapeloom.plans.fixtures import view
from shapeloom.plans.graph_queries import edges
from shapeloom.sources import network_codec


@query()
def io8_io9_io10_network_codec(spark, d):
    """IO8 IO9 IO10 IO24: networks packed by district, sent as base64 text, and read back."""
    n = view(spark, d, "nodes")
    a, b = (n.select(F.col("id").alias(x), F.col("lat").alias(f"{x}lat"), F.col("lon").alias(f"{x}lon")) for x in "ab")
    e = edges(spark, d).join(a, "a").join(b, "b").select(F.floor(F.col("a") / 500).alias("district"), "a", "alat", "alon", "b", "blat", "blon", "length", "safety", (F.col("a") % 64).cast("int").alias("name"), F.col("lanes").cast("int").alias("flags"))
    text = network_codec.encode(e).select("district", F.base64("packed").alias("text"))
    return network_codec.decode(network_codec.from_base64(text, "text"))


@query()
def k10_k17_trace(spark, d):
    """K10 to K17 IO7: outlines of rasters that are drawn from the vectors' values."""
    px = F.transform(F.sequence(F.lit(0), F.lit(32 * 32 - 1)), lambda k: F.when(F.pow(k % 32 - 16, F.lit(2)) + F.pow(F.floor(k / 32) - 16, F.lit(2)) < 60 + 60 * F.abs(F.get("embedding", (k % 8).cast("int")).cast("double")), 0).otherwise(255))
    # an image takes far longer than its vector to read, so the rows of a file are dealt to all tasks
    dealt = view(spark, d, "embeddings").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")
    image = dealt.select(F.col("vec_id").alias("key"), F.lit(32).alias("w"), F.lit(32).alias("h"), F.unhex(F.array_join(F.transform(px, lambda v: F.lpad(F.hex(v), 2, "0")), "")).alias("px"))
    return raster.trace(image)


@query()
def k6_j3_placement_grid(spark, d):
    """Placements of every shape on a grid of centres, then in five sizes, snapped to the network; the best by score.

    All candidates of a round are one DataFrame: placed corner points, a nearest-node join, mean error and count.
    """
    from shapeloom.functions.text import vertices

    nodes = view(spark, d, "nodes")
    shapes = vertices(view(spark, d, "embeddings"))

    def scored(candidates):
        at = shapes.hint("merge").join(candidates, "vec_id")
        pts = at.select("vec_id", "ci", "cj", "size", (24.1 + F.col("ci") * 0.0005 + F.col("y") * F.col("size") / N.METRES).alias("lat"), (120.61 + F.col("cj") * 0.003 + F.col("x") * F.col("size") / N.METRES).alias("lon"))
        near, _ = N.nearest_of_many(pts, nodes, 260.0, 65.0)
        q = near.groupBy("vec_id", "ci", "cj", "size").agg(F.count_distinct("node").alias("n"), F.avg("d").alias("err"))
        return q.where("n >= 4").withColumn("q", 1 - F.col("err") / 260 + F.col("n") / 100)

    def best(q):
        return q.groupBy("vec_id").agg(F.max_by(F.struct("ci", "cj", "size", "n", "err", "q"), F.struct("q", -F.col("ci"), -F.col("cj"))).alias("b")).select("vec_id", "b.*")

    grid = spark.range(5).withColumnRenamed("id", "ci").crossJoin(spark.range(5).withColumnRenamed("id", "cj"))
    start = shapes.select("vec_id").distinct().crossJoin(F.broadcast(grid)).withColumn("size", F.lit(300.0))
    first = written(best(scored(start)), "best")
    moves = spark.createDataFrame([(s,) for s in (0.8, 0.9, 1.0, 1.1, 1.25)], "f double")
    second = first.select("vec_id", "ci", "cj", "size").crossJoin(F.broadcast(moves)).select("vec_id", "ci", "cj", (F.col("size") * F.col("f")).alias("size"))
    return best(scored(second))
