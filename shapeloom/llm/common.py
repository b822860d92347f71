"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.operators.staging import discard, written

__all__ = ["SPACES", "discard", "id_and_text", "shuffle_partitions", "words_column", "written"]

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, so that extra columns of any name do no harm."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def words_column(text, pattern: str = SPACES):
    """The words of a text as an array without empty strings; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern), lambda w: w != "")
