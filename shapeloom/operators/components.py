"""Connected components of an edge table by alternating star contraction, with hubs of their own treatment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeloom.operators.staging import discard, written

#: Edges that a task contracts at once; a bound of its memory.
SLICE = 1 << 20
#: A hub is a node with more than one in so many of all edge ends. There are fewer hubs than this, so they are broadcast.
HUBS = 2048


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """The components of these edges as stars: every node with the smallest of its component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    inner = label != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(nodes[label[inner]])], names=["u", "v"])


def _contract(batches):
    """Edges of a task as stars, in slices of a bounded number of edges. What is connected stays connected."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= SLICE:
            table = pa.Table.from_batches(held)
            yield _stars(table.column("u").to_numpy(), table.column("v").to_numpy())
            held, n = [], 0
    if n:
        table = pa.Table.from_batches(held)
        yield _stars(table.column("u").to_numpy(), table.column("v").to_numpy())


def _is_stars(links: DataFrame) -> bool:
    """Whether every node points at one node only and nothing points at a node that points elsewhere."""
    nothing = F.lit(None).cast("long").alias("v")
    ends = links.select(F.col("u").alias("node"), "v").unionAll(links.select(F.col("v").alias("node"), nothing))
    centre = F.max(F.col("v").isNull()).alias("centre")
    seen = ends.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high"), centre)
    return seen.where("low <> high or (centre and low is not null)").isEmpty()


def _with_least(pairs: DataFrame, n_pairs: int) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (u, v) with m, the least v of each u; and the table that must be discarded afterwards.

    The minimum is combined before it is shuffled. A hub's minimum is broadcast, so its pairs stay where they are:
    fewer than HUBS nodes can have more than one in HUBS of all pairs. All other nodes meet theirs in a shuffle, never by a
    broadcast, so that what a round sends to the driver does not grow with the graph.
    """
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    is_hub = F.col("n") > n_pairs // HUBS
    hubs, others = least.where(is_hub).select("u", "m"), least.where(~is_hub).select("u", "m")
    rest = pairs.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(others.hint("merge"), "u")
    return pairs.join(F.broadcast(hubs), "u").unionByName(rest), least


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (two long columns) is connected with.

    Each task first contracts the edges that it reads; then every node's larger neighbours, and after them its smaller
    ones, point at its smallest neighbour, until all components are stars; the number of rounds grows with the
    logarithm of the longest path. The edge table of a round is written to the shared folder, and deleted once the
    next one is whole; the last one stays for the result. Null ends, loops and repeated edges do no harm; a node with
    only loops is left out. No edges give no rows.
    """
    links = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    links = written(links.where("u is not null and v is not null and u <> v").mapInArrow(_contract, "u long, v long"), "links")
    while not _is_stars(links):
        # large star: every larger neighbour of u is linked with the smallest of u and its neighbours
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near, scratch = _with_least(both, 2 * links.count())
        large = near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")
        large = written(large.distinct(), "large")
        discard(scratch)
        discard(links)
        # small star: u and its smaller neighbours are linked with the smallest of them
        near, scratch = _with_least(large, large.count())
        small = near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = written(small.mapInArrow(_contract, "u long, v long"), "links")
        discard(scratch)
        discard(large)
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def components_of_ranges(edges: DataFrame, left: str, right: str) -> DataFrame:
    """connected_components() of a graph whose edges mostly join ids that are near each other, as those of roads do.

    Ranges of ids are contracted to stars at once. Only nodes that several stars hold, and centres that are nodes of
    another star, tie stars together; they alone go through the rounds. Any other graph has equal results, but gains less.
    """
    ends = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    ends = written(ends, "ends")
    # sorted, so that the slices of a task are ranges as well
    links = written(ends.repartitionByRange("u").sortWithinPartitions("u").mapInArrow(_contract, "u long, v long"), "links")
    discard(ends)
    stars = links.unionAll(links.select(F.col("v").alias("u"), "v"))
    own = written(stars.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x")), "stars")
    several = written(own.where("m < x").select("u", "m"), "several")
    ties = written(stars.join(several, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "ties")
    centres = written(connected_components(ties, "u", "v").select(F.col("node").alias("m"), "component"), "centres")
    for table in (links, several, ties):
        discard(table)
    return own.join(centres, "m", "left").select(F.col("u").alias("node"), F.coalesce("component", "m").alias("component"))
