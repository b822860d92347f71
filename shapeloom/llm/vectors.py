"""Vectors as whole numbers: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components at and beyond this size, after scaling, are an error: their products would not fit 64 bits.
LARGEST = 2**27


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int, keep: dict[str, Column]) -> DataFrame:
    """(vec_id, the kept columns, ints): each component x as floor(scale * x), x as a double.

    Rows whose vector is null or holds null or non-finite components are left out. A finite component whose scaled
    value reaches 2**27 raises an error.
    """
    whole = rows.select(F.col(id_col).cast("long").alias("vec_id"), *(c.alias(n) for n, c in keep.items()), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    too_large = F.raise_error(F.lit(f"a component of a vector reaches 2**27 after scaling by {scale}"))
    ints = F.transform("vec", lambda x: F.when(F.abs(x * F.lit(float(scale))) < LARGEST, F.floor(x * F.lit(float(scale))).cast("int")).otherwise(too_large))
    return whole.where(F.col("vec").isNotNull() & ~bad).select("vec_id", *keep, ints.alias("ints"))


def longest(vectors: DataFrame) -> int:
    """The largest number of components; shorter vectors count as if zeros followed."""
    return vectors.agg(F.max(F.size("ints")).alias("n")).first().n or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of whole numbers as the rows of a matrix, with zeros behind shorter lists."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.int64)
    if len(column) and (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out
