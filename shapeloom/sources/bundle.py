"""Texts of a route (track, report, cue sheet) written side by side, one folder for each route and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_bundle(texts: DataFrame, path: str) -> None:
    """Write (slug, kind, content), each pair as one file under ``slug=.../kind=...``.

    Tasks write their own files; nothing passes through the driver. Null contents are written as empty texts. Pairs
    are expected to be distinct; a repeated one gives one more line in the same file.
    """
    rows = texts.select("slug", "kind", F.coalesce("content", F.lit("")).alias("value"))
    rows.repartition("slug", "kind").write.mode("overwrite").partitionBy("slug", "kind").text(path)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(slug, kind, content) of a saved bundle, without the line feed that ends a file."""
    rows = spark.read.schema("value string, slug string, kind string").text(path, wholetext=True)
    return rows.select("slug", "kind", F.regexp_replace("value", "\n\\z", "").alias("content"))
