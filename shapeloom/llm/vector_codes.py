"""Codes of vectors by product quantisation, with entries searched by a VA-file.

A vector is cut into parts, each of which is coded by the nearest entry of its part's codebook. Codebooks are learnt in
rounds: every round is one pass of Spark over the vectors that sums up, task by task, what each entry won, and adds these
sums in a shuffle; the driver holds nothing but the codebooks, whose size does not depend on the data.

The search for the nearest entry filters first. Each coordinate of the entries is quantised into cells of a few bits. For
each part of a vector, tables give the least and the greatest squared distance to each cell, and their sums bound the
distance to each entry. Entries whose lower bound exceeds the smallest upper bound are out; the rest are refined with
distances of whole numbers, so that bounds never change a result, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeloom.llm.common import discard, written
from shapeloom.llm.vectors import integer_vectors, longest, matrix

#: Rows that are compared at once, and bits of a cell.
ROWS, BITS = 4096, 3
_FAR = np.iinfo(np.int64).max


class Cells:
    """The quantised coordinates of one part's entries (entries x width)."""

    def __init__(self, entries: np.ndarray):
        self.entries, count = entries, 1 << BITS
        low = entries.min(axis=0)
        step = (entries.max(axis=0) - low) // count + 1
        self.cell = (entries - low) // step
        self.first = low[:, None] + np.arange(count) * step[:, None]
        self.last = self.first + step[:, None] - 1

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances (queries x entries), from the lookup tables of each query."""
        low = np.zeros((len(queries), len(self.entries)), np.int64)
        high = np.zeros_like(low)
        for k in range(self.entries.shape[1]):
            below, above = self.first[k] - queries[:, k, None], queries[:, k, None] - self.last[k]
            low += (np.maximum(np.maximum(below, above), 0) ** 2)[:, self.cell[:, k]]
            high += (np.maximum(np.abs(below), np.abs(above)) ** 2)[:, self.cell[:, k]]
        return low, high

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each query, ties to the lower index, and its squared distance."""
        low, high = self.bounds(queries)
        open_ = low <= high.min(axis=1)[:, None]
        query, entry = np.nonzero(open_)
        distance = np.full(low.shape, _FAR)
        distance[query, entry] = ((queries[query] - self.entries[entry]) ** 2).sum(axis=1)
        best = distance.argmin(axis=1)
        return best, distance[np.arange(len(queries)), best]


def _assigned(parts: np.ndarray, cells: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of each part (rows x parts) of vectors (rows x parts x width)."""
    found = [c.nearest(parts[:, p]) for p, c in enumerate(cells)]
    return np.stack([x for x, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _pieces(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            yield rows, matrix(rows.column("ints"), parts * width).reshape(rows.num_rows, parts, width)


def _sums(vectors: DataFrame, books: np.ndarray) -> list:
    """For each entry that some part is nearest to: its components' sums and the number of these parts."""
    parts, _, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, values in _pieces(batches, parts, width):
            index, _ = _assigned(values, cells)
            for p in range(parts):
                np.add.at(total[p], index[:, p], values[:, p])
                count[p] += np.bincount(index[:, p], minlength=len(count[p]))
        part, entry = np.nonzero(count)
        one = lambda x: pa.array(np.repeat(x, width), pa.int64())
        place, sums = np.tile(np.arange(width), len(part)), total[part, entry].ravel()
        yield pa.RecordBatch.from_arrays([one(part), one(entry), pa.array(place, pa.int64()), pa.array(sums, pa.int64()), one(count[part, entry])], names=["part", "entry", "place", "total", "n"])

    sums = vectors.select("ints").mapInArrow(add, "part long, entry long, place long, total long, n long")
    return sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()


def learn(vectors: DataFrame, parts: int, entries: int, rounds: int, width: int) -> np.ndarray:
    """Codebooks (parts x entries x width) from (vec_id, ints), beginning with the vectors of the smallest ids."""
    first = vectors.where("vec_id is not null").orderBy("vec_id", "ints").limit(entries).select("ints").collect()
    if not first:  # none but vectors without an id
        first = vectors.orderBy("ints").limit(entries).select("ints").collect()
    begun = matrix(pa.array([r.ints for r in first], pa.list_(pa.int32())), parts * width).reshape(len(first), parts, width)
    books = np.ascontiguousarray(begun.swapaxes(0, 1))
    for _ in range(rounds):
        following = books.copy()
        for r in _sums(vectors, books):
            following[r.part, r.entry, r.place] = r.total // r.n
        books = following
    return books


def encode(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), one row for each row whose vector is whole.

    Left out are rows with a null vector or with null or non-finite components. Vectors whose length is no multiple of
    ``parts``, or smaller than the longest, count as if zeros followed. Rows without an id are coded, and begin a
    codebook only where no row has one. Repeated rows are coded alike and each count; among repeated ids the smaller
    vector comes first. With fewer rows than ``entries`` a codebook has as many entries as there are rows. A table
    without rows gives none. Extra columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries: an index is two hex digits")
    vectors = written(integer_vectors(rows, id_col, vec_col, scale, {"label": F.col(label_col)}), "vectors")
    if vectors.isEmpty():
        return vectors.select("vec_id", "label", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    width = -(-longest(vectors) // parts)
    books = learn(vectors, parts, entries, rounds, width)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch, values in _pieces(batches, parts, width):
            index, distance = _assigned(values, cells)
            codes = [x.tobytes().hex() for x in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    coded = written(vectors.mapInArrow(code, f"vec_id long, label {kind}, code string, error long"), "codes")
    discard(vectors)
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
