"""Tables that cut a lineage: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session with a local master gets a temporary folder, as in tests. On a cluster every executor
    would write to a disk of its own, so the setting is asked for.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="shapeloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a statement at its end, and not where the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, clean: bool = False) -> DataFrame:
    """``df`` as a table of the shared folder. It stays until discard() is called with what is returned.

    clean: the shuffle files of ``df`` are deleted once the table is whole, so that those of several tables don't add up.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    if clean:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that written() returned. Nothing that still reads it may be left."""
    spark, path = table.sparkSession, getattr(table, "written_to", None)
    if path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
        table.written_to = None


#: Rows of numbers that one task takes.
ROWS = 1_000_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks to which so many rows are dealt: as many as a shuffle has, and more where a task would take over ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
