"""Lookups in tables that are often, but not always, small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.operators.staging import written

#: Bytes up to which the side that is looked into is sent to every executor.
BROADCAST = 8 << 20


def first_of(rows: DataFrame, key: str, order: list[str | Column], columns: list[str]) -> DataFrame:
    """(key, columns) of the first row of each key in an order; rows with a null key are left out."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")).select(key, "_first.*")


def measured_bytes(rows: DataFrame) -> int:
    """Bytes of a table's values as text, counted, not guessed from its plan."""
    return rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))))).first()[0] or 0


def lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, order: list[str | Column], columns: list[str], found: str = "found", most: int = BROADCAST) -> DataFrame:
    """``rows`` with the columns of the first row of ``table`` under their key, and whether there is any.

    Names that the table doesn't know, and null ones, stay as rows with nulls. The table's first rows are written once
    and counted: up to ``most`` bytes they are broadcast, beyond that both sides are shuffled by the key.
    """
    firsts = written(first_of(table, table_key, order, columns), "lookup").withColumnRenamed(table_key, "_key").withColumn(found, F.lit(True))
    if measured_bytes(firsts) <= most:
        firsts = F.broadcast(firsts)
    joined = rows.join(firsts, F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumn(found, F.coalesce(found, F.lit(False)))
