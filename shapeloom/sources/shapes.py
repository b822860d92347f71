"""Shape files: a folder of JSON documents with one closed outline each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, name string, pts array<array<double>>, aspect double, spurs array<array<int>>, note string, fits array<string>, broken string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "broken").option("pathGlobFilter", "*.json").json(path)
    whole = F.col("broken").isNull() & F.col("key").isNotNull() & F.col("name").isNotNull() & (F.coalesce(F.size("pts"), F.lit(0)) > 0)
    return rows.select("*", F.col("_metadata.file_name").alias("file"), whole.alias("whole"))


def read_shapes(spark: SparkSession, path: str, default_fits: tuple[str, ...] = ()) -> DataFrame:
    """Shapes (key, name, pts, aspect, spurs, note, fits) of a folder; of equal keys that of the last file name.

    Missing fields take a default: aspect 1, no spurs, an empty note, ``default_fits``. Outlines are closed. Files that
    cannot be read, or without key, name or points, are left out; ``broken_shapes`` lists them.
    """
    last = F.max_by(F.struct("name", "pts", "aspect", "spurs", "note", "fits"), "file").alias("s")
    rows = _files(spark, path).where("whole").groupBy("key").agg(last)
    pts, first = F.col("s.pts"), F.get("s.pts", F.lit(0))
    closed = F.when(F.element_at(pts, -1) == first, pts).otherwise(F.concat(pts, F.array(first)))
    fits = F.array(*map(F.lit, default_fits)).cast("array<string>")
    return rows.select(
        "key", "s.name", closed.alias("pts"), F.coalesce("s.aspect", F.lit(1.0)).alias("aspect"), F.coalesce("s.spurs", F.array().cast("array<array<int>>")).alias("spurs"),
        F.coalesce("s.note", F.lit("")).alias("note"), F.when(F.coalesce(F.size("s.fits"), F.lit(0)) > 0, F.col("s.fits")).otherwise(fits).alias("fits"),
    )


def broken_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason) of the files that ``read_shapes`` leaves out."""
    missing = F.concat_ws(", ", *(F.when(F.col(c).isNull(), c) for c in ("key", "name", "pts")))
    reason = F.when(F.col("broken").isNotNull(), "not a shape in JSON").otherwise(F.concat(F.lit("missing: "), missing))
    return _files(spark, path).where("not whole").select("file", reason.alias("reason"))
