"""Searches over sizes: every round measures the candidates of all routes in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.operators.staging import discard, written

#: A function from (key, side, size) to (key, side, size, km); a size that cannot be built gives no row or a null.
Measure = Callable[[DataFrame], DataFrame]
#: Halvings that are measured together.
AT_ONCE = 4


def _halves(depth: int) -> list[tuple[int, Column]]:
    """The middles of (lo, hi) and of the halves that so many halvings can lead to: numbers 2n and 2n + 1 follow n."""
    made, spans = [], {1: (F.col("lo"), F.col("hi"))}
    for n in range(1, 1 << depth):
        lo, hi = spans.pop(n)
        mid = (lo + hi) / 2
        made.append((n, mid))
        spans |= {2 * n: (lo, mid), 2 * n + 1: (mid, hi)}
    return made


def bisect(goals: DataFrame, measure: Measure, rounds: int = 16) -> DataFrame:
    """(key, side, size): the tried size whose length is nearest to ``goal``, by halving (lo, hi) of each row.

    goals: (key, side, goal, lo, hi, start). A size that is too short or cannot be built raises lo. Of equally near
    sizes the first stays; where no size can be built, ``start`` is returned. AT_ONCE halvings are measured together, all
    sizes that they can lead to: a measure costs far more than its sizes. Only those on the way of halving count.
    """
    state = written(goals.withColumn("size", F.col("start")).withColumn("off", F.lit(1e9)).drop("start"), "bisect")
    for done in range(0, rounds, AT_ONCE):
        depth = min(AT_ONCE, rounds - done)
        tried = state.select("key", "side", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), mid.alias("mid")) for n, mid in _halves(depth)))).alias("t"))
        # a row for each size: its number stands before its side
        km = measure(tried.select("key", F.concat_ws(":", "t.n", "side").alias("side"), F.col("t.mid").alias("size"))).where("km is not null")
        n, side = F.substring_index("side", ":", 1).cast("int"), F.expr("substring(side, locate(':', side) + 1)")
        kms = km.groupBy("key", side.alias("side")).agg(F.map_from_entries(F.collect_list(F.struct(n.alias("n"), F.col("km").cast("double").alias("km")))).alias("kms"))

        def halve(a: Column, _: Column) -> Column:
            mid, km = (a["lo"] + a["hi"]) / 2, F.col("kms")[a["n"]]
            off = F.abs(km - F.col("goal"))
            nearer, short = F.coalesce(off < a["off"], F.lit(False)), F.coalesce(km < F.col("goal"), F.lit(True))
            return F.struct(
                F.when(short, mid).otherwise(a["lo"]).alias("lo"), F.when(short, a["hi"]).otherwise(mid).alias("hi"), F.when(nearer, mid).otherwise(a["size"]).alias("size"),
                F.when(nearer, off).otherwise(a["off"]).alias("off"), (a["n"] * 2 + F.when(short, 1).otherwise(0)).alias("n"),
            )

        start = F.struct(*(F.col(c).cast("double").alias(c) for c in ("lo", "hi", "size", "off")), F.lit(1).alias("n"))
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, halve)
        old, state = state, written(state.join(kms, ["key", "side"], "left").select("key", "side", "goal", walked.alias("w")).select("key", "side", "goal", "w.lo", "w.hi", "w.size", "w.off"), "bisect")
        discard(old)
    return state.select("key", "side", "size")


def fit_band(routes: DataFrame, measure: Measure, score: Measure, rounds: int = 16, margin: float = 0.15, steps: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, size, km, score, the columns of ``keep``, fitted): the best of ``steps`` sizes between those that meet both ends of a band.

    routes: (key, size, lo_km, hi_km). score adds a column ``score``, and those of ``keep``, to what measure returns. Only sizes within the
    band count; of equal scores the smallest size wins; without any the route keeps its size and ``fitted`` is false.
    """
    ends = F.explode(F.array(F.struct(F.lit("lo").alias("side"), (F.col("lo_km") + margin).alias("goal")), F.struct(F.lit("hi").alias("side"), (F.col("hi_km") - margin).alias("goal"))))
    goals = routes.select("key", ends.alias("e"), (F.col("size") * 0.3).alias("lo"), (F.col("size") * 3.0).alias("hi"), F.col("size").alias("start")).select("key", "e.side", "e.goal", "lo", "hi", "start")
    span = bisect(goals, measure, rounds).groupBy("key").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    tries = span.select("key", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("k"), "least", "most")
    tries = tries.select("key", F.col("k").cast("string").alias("side"), (F.col("least") + (F.col("most") - F.col("least")) * F.col("k") / (steps - 1)).alias("size"))
    found = score(tries).join(routes.select("key", "lo_km", "hi_km"), "key").where("km between lo_km and hi_km")
    best = found.groupBy("key").agg(F.max_by(F.struct("size", "km", "score", *keep), F.struct("score", -F.col("size"))).alias("b"))
    kept = routes.select("key", F.col("size").alias("old")).join(best, "key", "left")
    return kept.select("key", F.coalesce("b.size", "old").alias("size"), "b.km", "b.score", *(f"b.{c}" for c in keep), F.col("b").isNotNull().alias("fitted"))
