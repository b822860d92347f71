"""Hard negatives of anchors among labelled vectors, by exact integer products behind an orthogonal rotation.

Vectors are rotated onto the principal axes of their second moments, so that few leading components carry most of a
product. A product is accumulated over leading components; what is left of it is bounded by the product of both
vectors' remaining norms, plus a slack for rounding. Pairs whose bounds cannot matter are discarded early, and the
survivors are verified by products of whole numbers, so the rotation never changes a result.

Spark deals out the work as a grid: anchors and rows are packed into blocks, and each block of anchors meets each block
of rows once. First come the positives, then the negatives whose scores lie in the band that a positive sets; each task
gives its best few for each anchor, and a window merges them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeloom.llm import kernels as K
from shapeloom.llm.common import discard, shuffle_partitions, written
from shapeloom.llm.vectors import integer_vectors, longest, matrix

#: Anchors and rows of a block, and rows of it that are compared at once.
ANCHORS, ROWS, AT_ONCE = 2048, 16_384, 1024
#: Bytes of anchors, and places for their best, that a task holds.
HELD, PLACES = 1 << 26, 1 << 20
#: Relative slack for the rounding of a partial product; bounds are compared as doubles.
SLACK = 1e-9
#: Below this share of pairs left, pairs are followed one by one.
FEW = 0.05
_NONE = np.iinfo(np.int64).min
BLOCK = "block long, labels array<long>, ids binary, marks binary, ints binary"
HIT = "block long, row int, place int, other long, score long"


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """The principal axes of all vectors, as columns, the leading one first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width).astype(np.float64)
            total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    moments = np.zeros((width, width))
    for r in vectors.select("ints").mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        moments[r.i, r.j] = moments[r.j, r.i] = r.v
    return np.ascontiguousarray(np.linalg.eigh(moments)[1][:, ::-1])


def _blocks(vectors: DataFrame, size: int, width: int) -> DataFrame:
    """Vectors in blocks of ``size`` at most, those of a label together where they can be; a hot label fills many."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, waiting, count = TaskContext.get().partitionId(), 0, [], 0
        column = lambda rows, name: pa.concat_arrays([b.column(name) for b in rows])

        def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            marks = np.asarray(column(rows, "label"), np.int64)
            bodies = (np.asarray(column(rows, "vec_id"), np.int64), marks, matrix(column(rows, "ints"), width).astype(np.int32))
            head = [pa.array([part << 32 | made], pa.int64()), pa.array([np.unique(marks).tolist()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*head, *(pa.array([x.tobytes()], pa.binary()) for x in bodies)], names=["block", "labels", "ids", "marks", "ints"])

        for batch in batches:
            while batch.num_rows:
                waiting.append(batch.slice(0, size - count))
                batch, count = batch.slice(size - count), count + waiting[-1].num_rows
                if count == size:
                    yield block(waiting)
                    made, waiting, count = made + 1, [], 0
        if count:
            yield block(waiting)

    dealt = vectors.repartitionByRange("label", "vec_id").select("vec_id", "label", "ints")
    return dealt.mapInArrow(pack, BLOCK)


def _grid(anchors: DataFrame, rows: DataFrame, width: int, condition: Column | None) -> DataFrame:
    """Each block of anchors beside each block of rows, once.

    A task holds some of the anchors' blocks, of about HELD bytes at most, and reads rows one block after another. Blocks
    stay single: copies of them, one for each meeting, would go to the driver in a broadcast, or fill the disk.
    """
    across, tasks = max(1, anchors.count()), -(-shuffle_partitions(rows.sparkSession) // max(1, rows.count()))
    parts = min(across, max(tasks, -(-across * ANCHORS * (4 * width + 16) // HELD)))
    left = rows.select(*(F.col(c).alias(f"r_{c}") for c in rows.columns))
    right = anchors.select(*(F.col(c).alias(f"a_{c}") for c in anchors.columns)).repartition(parts).hint("shuffle_replicate_nl")
    return left.crossJoin(right) if condition is None else left.join(right, condition)


class _Side:
    """One side of a meeting, unpacked: ids, labels, whole numbers, and these rotated."""

    def __init__(self, row: dict, prefix: str, width: int, axes: np.ndarray):
        self.ids, self.labels = (np.frombuffer(row[prefix + c].as_buffer(), np.int64) for c in ("ids", "marks"))
        self.ints = np.frombuffer(row[prefix + "ints"].as_buffer(), np.int32).reshape(len(self.ids), width)
        self.turned = self.ints.astype(np.float64) @ axes
        squares = np.cumsum(self.turned[:, ::-1] ** 2, axis=1)[:, ::-1]
        #: the norm of the components from each place on
        self.rest = np.sqrt(np.concatenate([squares, np.zeros((len(self.ids), 1))], axis=1))


def _survivors(a: _Side, r: _Side, i: np.ndarray, j: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of the rows i of a and j of r whose bounds keep() accepts to the last component, with their exact products.

    keep(i, low, high) is asked with broadcasting indices of a and bounds of the products.
    """
    width = a.ints.shape[1]
    stages = sorted({max(1, width // 4), max(1, width // 2), width})
    slack = SLACK * a.rest[i, 0][:, None] * r.rest[j, 0][None, :]
    partial, begin, at = np.zeros((len(i), len(j))), 0, None
    for end in stages:
        if at is None:
            partial += a.turned[i, begin:end] @ r.turned[j, begin:end].T
            spread = a.rest[i, end][:, None] * r.rest[j, end][None, :] + slack
            left = keep(i[:, None], j[None, :], partial - spread, partial + spread)
            if end == width or np.count_nonzero(left) < FEW * left.size:
                p, q = np.nonzero(left)
                at, partial = (i[p], j[q]), partial[p, q]
        else:
            ai, rj = at
            partial = partial + np.einsum("ij,ij->i", a.turned[ai, begin:end], r.turned[rj, begin:end])
            spread = a.rest[ai, end] * r.rest[rj, end] + SLACK * a.rest[ai, 0] * r.rest[rj, 0]
            left = keep(ai, rj, partial - spread, partial + spread)
            at, partial = (ai[left], rj[left]), partial[left]
        begin = end
    ai, rj = at
    if len(ai) and a.rest[ai, 0].max() * r.rest[rj, 0].max() >= 2.0**62:
        raise OverflowError("an inner product of these vectors may not fit 64 bits")
    scores = [np.einsum("ij,ij->i", a.ints[ai[s : s + 65_536]].astype(np.int64), r.ints[rj[s : s + 65_536]].astype(np.int64)) for s in range(0, len(ai), 65_536)]
    return ai, rj, np.concatenate(scores) if scores else np.zeros(0, np.int64)


class _Best:
    """The best ``most`` of each key so far, a row's place: higher scores first, ties by smaller id."""

    def __init__(self, rows: int, places: int, most: int):
        self.places, self.most, self.last = places, most, np.full(rows * places, _NONE)
        self.key, self.other, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, other: np.ndarray, score: np.ndarray) -> None:
        key, other, score = np.concatenate([self.key, key]), np.concatenate([self.other, other]), np.concatenate([self.score, score])
        order = np.lexsort((other, -score, key))
        key, other, score = key[order], other[order], score[order]
        begin, size = K.groups_of(key)
        place = np.arange(len(key)) - np.repeat(begin, size)
        full = place == self.most - 1
        self.last[key[full]] = score[full]
        kept = place < self.most
        self.key, self.other, self.score = key[kept], other[kept], score[kept]


def _hits(block: int, best: _Best, places: int) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(best.key), block), pa.int64()), pa.array(best.key // places, pa.int32()), pa.array(best.key % places, pa.int32()), pa.array(best.other, pa.int64()), pa.array(best.score, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "row", "place", "other", "score"])


def _meetings(grid: DataFrame, width: int, axes: np.ndarray, begin: Callable, meet: Callable) -> DataFrame:
    """The best of all anchors: begin(row) makes what a task keeps of a block of anchors, its _Best first; meet() adds to it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, r, r_block = {}, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                block, own = row["a_block"].as_py(), row["r_block"].as_py()
                if own != r_block:
                    r, r_block = _Side(row, "r_", width, axes), own
                a = _Side(row, "a_", width, axes)
                if block not in kept:
                    kept[block] = begin(a, row)
                meet(a, r, *kept[block])
                if sum(len(best.last) for best, *_ in kept.values()) > PLACES:
                    yield from (_hits(i, best, best.places) for i, (best, *_) in kept.items())
                    kept.clear()
            K.tidy()
        yield from (_hits(i, best, best.places) for i, (best, *_) in kept.items())

    return grid.mapInArrow(each, HIT)


def _ranked(hits: DataFrame, most: int) -> DataFrame:
    """The best of each anchor's place over all meetings, with their rank from 1."""
    order = Window.partitionBy("block", "row", "place").orderBy(F.col("score").desc(), "other")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _positives(grid: DataFrame, width: int, axes: np.ndarray, most: int) -> DataFrame:
    def begin(a: _Side, row: dict) -> tuple[_Best]:
        return (_Best(len(a.ids), 1, most),)

    def meet(a: _Side, r: _Side, best: _Best) -> None:
        keep = lambda i, j, low, high: (high >= best.last[i]) & (a.ids[i] != r.ids[j])
        for label in np.intersect1d(a.labels, r.labels):
            i, others = np.flatnonzero(a.labels == label), np.flatnonzero(r.labels == label)
            for at in range(0, len(others), AT_ONCE):
                ai, rj, score = _survivors(a, r, i, others[at : at + AT_ONCE], keep)
                best.add(ai, r.ids[rj], score)

    return _ranked(_meetings(grid, width, axes, begin, meet), most)


def _negatives(grid: DataFrame, width: int, axes: np.ndarray, positives: int, most: int, band: tuple[int, int]) -> DataFrame:
    low_percent, high_percent = band

    def begin(a: _Side, row: dict) -> tuple[_Best, np.ndarray, np.ndarray]:
        # for each anchor and positive the smallest and largest whole score in its band; places without a positive are empty
        least, largest = np.full((len(a.ids), positives), 1), np.zeros((len(a.ids), positives), np.int64)
        for p in row["a_positives"].as_py():
            least[p["row"], p["rank"] - 1] = -(-low_percent * p["score"] // 100)
            largest[p["row"], p["rank"] - 1] = high_percent * p["score"] // 100
        return _Best(len(a.ids), positives, most), least, largest

    def meet(a: _Side, r: _Side, best: _Best, least: np.ndarray, largest: np.ndarray) -> None:
        full = least <= largest
        anchors = np.flatnonzero(full.any(axis=1))

        def keep(i, j, low, high):
            needed = np.maximum(least, best.last.reshape(least.shape))
            # over all pairs of blocks only the span of an anchor's bands is asked, for its few pairs each band
            if low.ndim == 2:
                from_, to = np.where(full, needed, np.iinfo(np.int64).max).min(axis=1), np.where(full, largest, _NONE).max(axis=1)
                return (high >= from_[i]) & (low <= to[i]) & (a.labels[i] != r.labels[j])
            left = False
            for k in range(positives):
                left = left | ((high >= needed[i, k]) & (low <= largest[i, k]))
            return left & (a.labels[i] != r.labels[j])

        for at in range(0, len(r.ids) if len(anchors) else 0, AT_ONCE):
            ai, rj, score = _survivors(a, r, anchors, np.arange(at, min(at + AT_ONCE, len(r.ids))), keep)
            which, k = np.nonzero((score[:, None] >= least[ai]) & (score[:, None] <= largest[ai]))
            best.add(ai[which] * positives + k, r.ids[rj[which]], score[which])

    return _ranked(_meetings(grid, width, axes, begin, meet), most)


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 3,
    band: tuple[int, int] = (50, 95),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor.

    ``anchor`` says of (vec_id, label) whether a row is an anchor; ``label`` is a whole number, by default the column of
    that name. An anchor's positives are its first rows of the same label and another id, its negatives for a positive
    the first rows of other labels whose score lies in ``band``, in percent of the positive's score. Higher inner
    products come first, ties by smaller id. Left out are rows with a null id, label or vector and vectors with null or
    non-finite components. Repeated rows each count, as anchors too; rows with an anchor's own id are no positives of
    it. Shorter vectors count as if zeros followed. An anchor without positives, or a positive without negatives in its
    band (a negative positive score sets an empty one), gives no row, and nor does an empty table. A product that could
    pass 2**62 is an error. Extra columns are not read.
    """
    label = F.col("label") if label is None else label
    whole = integer_vectors(rows, id_col, vec_col, scale, {"label": label.cast("long")}).where("vec_id is not null and label is not null")
    vectors = written(whole, "vectors")
    width = max(1, longest(vectors))
    axes = rotation(vectors, width)
    row_blocks, anchor_blocks = written(_blocks(vectors, ROWS, width), "rows"), written(_blocks(vectors.where(anchor), ANCHORS, width), "anchors")
    discard(vectors)
    found = written(_positives(_grid(anchor_blocks, row_blocks, width, F.arrays_overlap("a_labels", "r_labels")), width, axes, positives), "positives")
    by_block = found.groupBy("block").agg(F.collect_list(F.struct("row", "rank", "score")).alias("positives"))
    hits = _negatives(_grid(anchor_blocks.join(by_block.hint("merge"), "block"), row_blocks, width, None), width, axes, positives, negatives, band)
    named = anchor_blocks.select("block", "ids").mapInArrow(_anchor_ids, "block long, row int, anchor_id long")
    pairs = found.join(named.hint("merge"), ["block", "row"]).select("block", "row", (F.col("rank") - 1).alias("place"), "anchor_id", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    best = hits.select("block", "row", "place", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(best, ["block", "row", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _anchor_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, body in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            ids = np.frombuffer(body, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block), pa.int64()), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids)], names=["block", "row", "anchor_id"])
