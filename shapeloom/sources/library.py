"""A stored table that is changed by whole rewrites: rows by key, appended, replaced and deleted.

Every change writes a new version beside the old one, and readers take the newest version that is complete: a job that
dies leaves the library as it was, and a change that is made again, or that changes nothing, gives the same table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapeloom.operators.staging import written

#: Only keys that begin so may be deleted.
DELETABLE = "user_"


class Library:
    """Rows by ``key`` in a folder that all executors share, kept in ``order`` (columns, each with "desc" or "asc")."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "key", order: tuple[tuple[str, str], ...] = ()):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), StructType.fromDDL(schema), key
        self.order = [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in order] + [F.col(key)]
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, version: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{version:09d}")

    def versions(self) -> list[int]:
        """All complete versions, the newest last."""
        if not self._files.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._folder)]
        found = sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d{9}", n))
        marker = self.spark._jvm.org.apache.hadoop.fs.Path
        return [v for v in found if self._files.exists(marker(self._at(v), "_SUCCESS"))]

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or a given one; no rows before the first."""
        known = self.versions()
        version = version or (known[-1] if known else None)
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{version:09d}")

    def _rewrite(self, rows: DataFrame) -> None:
        known = self.versions()
        following = self._at(known[-1] + 1 if known else 1)
        # what a job that died has left there
        self._files.delete(following, True)
        rows.select(*self.schema.names).orderBy(*self.order).write.parquet(following.toString())

    def _one_each(self, rows: DataFrame) -> DataFrame:
        """One row of each key: of repeated ones the first in the order of all columns; null keys are left out."""
        rest = [c for c in self.schema.names if c != self.key]
        rows = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min(F.struct(*rest)).alias("_row"))
        return rows.select(self.key, "_row.*").select(*(F.col(f.name).cast(f.dataType) for f in self.schema))

    def append_missing(self, rows: DataFrame) -> int:
        """Add the rows whose key the library doesn't have; the number added."""
        old = self.read()
        new = self._one_each(rows).join(old.select(self.key), self.key, "left_anti").select(*self.schema.names)
        count = new.count()
        if count:
            self._rewrite(old.unionByName(new))
        return count

    def upsert(self, rows: DataFrame) -> int:
        """Add rows and replace those of the same key; the number of rows that are new or differ."""
        old, new = self.read(), self._one_each(rows)
        count = new.exceptAll(old).count()
        if count:
            self._rewrite(old.join(new.select(self.key), self.key, "left_anti").select(*self.schema.names).unionByName(new))
        return count

    def delete(self, keys: DataFrame, guard: str = DELETABLE) -> DataFrame:
        """Delete the rows of keys (key) that begin with ``guard``; returns (key, outcome): deleted, guarded, or unknown."""
        old = self.read()
        asked = keys.select(F.col(keys.columns[0]).cast("string").alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
        known = old.select(F.col(self.key).cast("string").alias(self.key), F.lit(True).alias("_known"))
        outcome = F.when(F.col("_known").isNull(), "unknown").when(F.startswith(self.key, F.lit(guard)), "deleted").otherwise("guarded")
        # written, for the answer must not change with the table that it speaks of
        said = written(asked.join(known, self.key, "left").select(self.key, outcome.alias("outcome")), "deleted")
        gone = said.where("outcome = 'deleted'").select(self.key)
        if not gone.isEmpty():
            self._rewrite(old.join(gone, self.key, "left_anti").select(*self.schema.names))
        return said

    def vacuum(self, keep: int = 2) -> list[int]:
        """Delete all but the newest complete versions; the numbers of those deleted."""
        gone = self.versions()[:-keep] if keep else self.versions()
        for version in gone:
            self._files.delete(self._at(version), True)
        return gone
