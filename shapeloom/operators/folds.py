"""Ordered folds over a route or a track, as array aggregation inside one row each: no state leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered(rows: DataFrame, key: str, order: list[str], columns: list[str], out: str = "xs") -> DataFrame:
    """One row for each key with the array of its rows in order; ``order`` must be unique within a key."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias(out))


def climb(values: Column, threshold: float = 5.0) -> Column:
    """Ascent with hysteresis: the reference follows descents at once, a gain counts from ``threshold`` on."""
    seed = F.struct(F.lit(None).cast("double").alias("ref"), F.lit(0.0).alias("gain"))
    step = lambda a, v: F.when(a["ref"].isNull(), F.struct(v.alias("ref"), a["gain"].alias("gain"))).when(v < a["ref"], F.struct(v.alias("ref"), a["gain"].alias("gain"))).when(v - a["ref"] >= threshold, F.struct(v.alias("ref"), (a["gain"] + (v - a["ref"])).alias("gain"))).otherwise(a)
    return F.aggregate(values, seed, step, lambda a: a["gain"])


def collapse_backtracks(nodes: Column) -> Column:
    """Remove A-B-A spurs: a node equal to the last but one takes the last one off the stack."""
    seed = F.array().cast("array<bigint>")
    return F.aggregate(nodes, seed, lambda s, n: F.when((F.size(s) >= 2) & (F.get(s, F.size(s) - 2) == n), F.slice(s, 1, F.size(s) - 1)).otherwise(F.concat(s, F.array(n))))


def cue_rows(steps: Column, least: float = 45.0) -> Column:
    """Segments of a cue sheet from (name, length) in order: array of start_m, road, length_m.

    A change of name closes a segment of at least ``least`` metres; a shorter one takes the new name and goes on. The
    last segment is always closed.
    """
    kind = "array<struct<start_m:double,road:string,length_m:double>>"
    seed = F.struct(F.lit(0.0).alias("acc"), F.lit(None).cast("string").alias("cur"), F.lit(0.0).alias("start"), F.array().cast(kind).alias("rows"))

    def close(a: Column) -> Column:
        return F.concat(a["rows"], F.array(F.struct(a["start"].alias("start_m"), a["cur"].alias("road"), (a["acc"] - a["start"]).alias("length_m"))))

    def step(a: Column, e: Column) -> Column:
        acc = (a["acc"] + e["length"]).alias("acc")
        name = F.coalesce(F.nullif(e["name"], F.lit("")), F.lit("-")).alias("cur")
        change = a["cur"].isNotNull() & (a["cur"] != name)
        return (
            F.when(a["cur"].isNull(), F.struct(acc, name, a["acc"].alias("start"), a["rows"].alias("rows")))
            .when(change & (a["acc"] - a["start"] >= least), F.struct(acc, name, a["acc"].alias("start"), close(a).alias("rows")))
            .otherwise(F.struct(acc, name, a["start"].alias("start"), a["rows"].alias("rows")))
        )

    return F.aggregate(steps, seed, step, lambda a: F.when(a["cur"].isNull(), a["rows"]).otherwise(close(a)))


def thin_notes(notes: Column, gap: float = 0.35) -> Column:
    """Drop a note of the last kept note's kind within ``gap`` km of it. ``notes``: (km, type, ...) in order."""
    kind = lambda s: s["type"]
    seed = F.slice(notes, 1, 0)

    def step(s: Column, n: Column) -> Column:
        last = F.get(s, F.size(s) - 1)
        return F.when((F.size(s) > 0) & (kind(last) == kind(n)) & (F.abs(last["km"] - n["km"]) < gap), s).otherwise(F.concat(s, F.array(n)))

    return F.aggregate(notes, seed, step)
