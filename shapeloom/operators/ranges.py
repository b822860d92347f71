"""Numbers in an order over all rows of a table, without taking them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeloom.operators.staging import written


def numbered(rows: DataFrame, order: list[Column | str], name: str, first: int = 1) -> DataFrame:
    """``rows`` with a dense number in ``order``, from ``first``: places within ranges, after all of the ranges before.

    Ranges are those of a range partitioning, so none is larger than a task of a sort. The driver holds one count a
    range. The order should leave no ties: tied rows are numbered in any order.
    """
    parts = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, counts = first, {}
    for r in sorted(parts.groupBy("_range").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_range"]):
        counts[r["_range"]] = before
        before += r["n"]
    if not counts:
        return parts.select(*rows.columns, F.lit(0).cast("long").alias(name))
    starts = F.create_map(*(F.lit(x) for pair in counts.items() for x in pair))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return parts.select(*rows.columns, (place + starts[F.col("_range")] - 1).cast("long").alias(name))
