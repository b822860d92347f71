"""Documents packed into compressed chunks: the unit in which operators ask other partitions about their texts.

A chunk holds some megabytes of whole texts. Chunks are written once to the shared folder, so that a chunk that is
read again after the loss of an executor is the same chunk. An operator sends a chunk's questions (hashes) to the
buckets of a hash partitioning, packed into one binary value for each chunk and bucket, and answers come back by
chunk. A value that is frequent in the corpus is sent once by a chunk, however many documents hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeloom.llm import kernels as K
from shapeloom.llm.common import shuffle_partitions, written

#: Bytes of text in a chunk, about, and chunks whose values a bucket holds.
CHUNK, CHUNKS_PER_BUCKET = 3_000_000, 6
SCHEMA = "chunk long, ids binary, flags binary, sizes binary, body binary"


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze, made = zstandard.ZstdCompressor(level=3), 0
    part = TaskContext.get().partitionId()
    for batch in batches:
        ids, texts, flags = batch.column(0), batch.column(1), batch.column(2)
        for a, b in K.slices(texts, CHUNK):
            body, offsets = K.text_bytes(texts[a:b])
            known = ids[a:b].is_valid().to_numpy(zero_copy_only=False)
            own = ids[a:b].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            marks = flags[a:b].fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint8) | (~known).astype(np.uint8) << 7
            row = [(part << 32) + made, own.tobytes(), marks.tobytes(), np.diff(offsets).tobytes(), squeeze.compress(body.tobytes())]
            made += 1
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names=["chunk", "ids", "flags", "sizes", "body"])


def chunked(docs: DataFrame, flag=None) -> DataFrame:
    """The chunk table of (doc_id, text), written to the shared folder. flag: a number below 128 for each document."""
    flag = F.lit(0) if flag is None else flag
    return written(docs.select("doc_id", "text", F.coalesce(flag, F.lit(0)).cast("int").alias("flag")).mapInArrow(pack, SCHEMA), "chunks")


def bucket_count(chunks: DataFrame) -> int:
    """Buckets of a hash partitioning of the chunks' values: a bucket's share is bounded at every size of the corpus."""
    return max(shuffle_partitions(chunks.sparkSession), -(-chunks.count() // CHUNKS_PER_BUCKET))


class Chunk:
    """One chunk, unpacked: ids, known (false where the id was null), flags, body, offsets."""

    def __init__(self, chunk, ids, flags, sizes, body):
        self.chunk = chunk
        self.ids = np.frombuffer(ids, np.int64)
        marks = np.frombuffer(flags, np.uint8)
        self.known, self.flags = marks < 128, marks & 127
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, np.int64))]).astype(np.int64)
        self.body = np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=int(self.offsets[-1]) + 1), np.uint8)

    @classmethod
    def each(cls, table) -> Iterator[Chunk]:
        for row in zip(*(table.column(c).to_pylist() for c in ("chunk", "ids", "flags", "sizes", "body")), strict=True):
            yield cls(*row)

    def text(self, i: int) -> bytes:
        return self.body[self.offsets[i] : self.offsets[i + 1]].tobytes()


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The range of each bucket that occurs, in values sorted by bucket; takes no time for buckets that don't."""
    for begin, size in zip(*K.groups_of(bucket), strict=True):
        yield int(bucket[begin]), slice(int(begin), int(begin + size))
