"""Substring dedup by fixed-block anchors.

Each document's non-overlapping blocks of half a window are the reference blocks; a rolling window of the same
length probes them at every word. A repeated passage of a full window holds a whole reference block of either
document, so a passage without a block that is found elsewhere cannot repeat. Around each hit all full windows are
compared, and windows that repeat one after another make up the maximal exact repeat.

Both rounds ask by hash: a chunk of documents sends each of its hashes once to the hash's bucket, the bucket answers
the chunks that share it. So a passage that a third of all documents hold costs a bucket one entry a chunk, and no
pairs of documents are ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shapeloom.llm import kernels as K
from shapeloom.llm.chunks import Chunk, bucket_count, bucket_of, by_bucket, chunked
from shapeloom.llm.common import id_and_text

_U = np.uint64
#: A probe is sent as 30 bits of its hash beside its bucket, and two marks. A false hit only adds windows to compare.
_RESIDUE, _ALIGNED, _SEVERAL = _U((1 << 30) - 1), 1 << 30, 1 << 31


def _probes(chunk: Chunk, window: int):
    """Hashes of rolling blocks of documents that hold a window, their word index, words, row offsets."""
    words, offsets = K.word_hashes(chunk.body, chunk.offsets)
    half = window // 2
    hashes, at, bounds = K.ngram_hashes(words, offsets, half)
    return hashes, at, bounds, words, offsets


def _long(chunk: Chunk, offsets: np.ndarray, window: int) -> np.ndarray:
    return chunk.known & (np.diff(offsets) >= window)


def _ask_blocks(window: int, buckets: int):
    def run(batches):
        for batch in batches:
            for chunk in Chunk.each(batch):
                hashes, at, bounds, _, offsets = _probes(chunk, window)
                row = K.row_of(bounds)
                keep = _long(chunk, offsets, window)[row]
                hashes, at, row = hashes[keep], at[keep], row[keep]
                bucket, residue = bucket_of(hashes, buckets), hashes & _RESIDUE
                key = (bucket.astype(_U) << _U(30)) | residue
                order = np.argsort(key, kind="stable")
                key, row = key[order], row[order]
                aligned = ((at[order] - offsets[row]) % (window // 2)) == 0
                begin, size = K.groups_of(key)
                if not len(begin):
                    continue
                ids = chunk.ids[row]
                several = np.minimum.reduceat(ids, begin) < np.maximum.reduceat(ids, begin)
                found = np.logical_or.reduceat(aligned, begin)
                record = (key[begin] & _RESIDUE).astype(np.uint32) | found.astype(np.uint32) * np.uint32(_ALIGNED) | several.astype(np.uint32) * np.uint32(_SEVERAL)
                parts = list(by_bucket((key[begin] >> _U(30)).astype(np.int64), buckets))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32()), pa.array([chunk.chunk] * len(parts), pa.int64()), pa.array([record[s].tobytes() for _, s in parts], pa.binary())], names=["bucket", "chunk", "asked"])

    return run


def _answer_blocks(table: pa.Table) -> pa.Table:
    """To each chunk the blocks that are a reference block somewhere and occur in more than one document."""
    asked = [np.frombuffer(x, np.uint32) for x in table.column("asked").to_pylist()]
    sizes = [len(x) for x in asked]
    records, row = np.concatenate(asked), np.repeat(np.arange(len(asked)), sizes)
    residue = records & np.uint32(_RESIDUE)
    order = np.argsort(residue, kind="stable")
    begin, size = K.groups_of(residue[order])
    marks = np.bitwise_or.reduceat(records[order], begin)
    live = ((marks & np.uint32(_ALIGNED)) > 0) & (((marks & np.uint32(_SEVERAL)) > 0) | (size > 1))
    keep = np.repeat(live, size)
    return _replies(table, row[order][keep], residue[order][keep])


def _replies(table: pa.Table, row: np.ndarray, *columns: np.ndarray) -> pa.Table:
    order = np.argsort(row, kind="stable")
    row, columns = row[order], [c[order] for c in columns]
    begin, size = K.groups_of(row)
    chunk, bucket = table.column("chunk").to_pylist(), table.column("bucket").to_pylist()
    hit = [int(row[b]) for b in begin]
    return pa.table(
        {"chunk": pa.array([chunk[i] for i in hit], pa.int64()), "bucket": pa.array([bucket[i] for i in hit], pa.int32())}
        | {f"said{k}": pa.array([c[b : b + n].tobytes() for b, n in zip(begin, size, strict=True)], pa.binary()) for k, c in enumerate(columns)}
    )


def _ask_windows(window: int, buckets: int):
    half = window // 2

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        live = [(np.uint64(b) << _U(30)) | np.frombuffer(x, np.uint32).astype(_U) for b, x in zip(right.column("bucket").to_pylist(), right.column("said0").to_pylist(), strict=True)]
        out: list[tuple] = []
        for chunk in Chunk.each(left) if live else ():
            known = np.sort(np.concatenate(live))
            hashes, at, bounds, words, offsets = _probes(chunk, window)
            mine = (bucket_of(hashes, buckets).astype(_U) << _U(30)) | (hashes & _RESIDUE)
            place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            hit = known[place] == mine
            sums = np.concatenate([[0], np.cumsum(hit)])
            wide, start, wide_bounds = K.ngram_hashes(words, offsets, window)
            row = K.row_of(wide_bounds)
            # the blocks of a window that starts at a word are those from this word to half a window further
            first = bounds[:-1][row] + (start - offsets[row])
            keep = (sums[first + window - half + 1] > sums[first]) & _long(chunk, offsets, window)[row]
            wide, ids = wide[keep], chunk.ids[row[keep]]
            bucket = bucket_of(wide, buckets)
            order = np.lexsort((ids, wide, bucket))
            bucket, wide, ids = bucket[order], wide[order], ids[order]
            begin, _ = K.groups_of(wide)
            bucket, wide, ids = bucket[begin], wide[begin], ids[begin]
            out += [(b, chunk.chunk, wide[s].tobytes(), ids[s].tobytes()) for b, s in by_bucket(bucket, buckets)]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({n: pa.array([x[k] for x in out], t) for k, (n, t) in enumerate(zip(("bucket", "chunk", "asked", "ids"), kinds, strict=True))})

    return run


def _answer_windows(table: pa.Table) -> pa.Table:
    """To each chunk the smallest document of a window, where that is smaller than the chunk's own smallest."""
    asked = [np.frombuffer(x, _U) for x in table.column("asked").to_pylist()]
    hashes, ids = np.concatenate(asked), np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
    row = np.repeat(np.arange(len(asked)), [len(x) for x in asked])
    order = np.argsort(hashes, kind="stable")
    hashes, ids, row = hashes[order], ids[order], row[order]
    begin, size = K.groups_of(hashes)
    least = np.repeat(np.minimum.reduceat(ids, begin), size)
    keep = least < ids
    return _replies(table, row[keep], hashes[keep], least[keep])


RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"


def _remove(window: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        said = [np.frombuffer(x, _U) for x in right.column("said0").to_pylist()]
        least = [np.frombuffer(x, np.int64) for x in right.column("said1").to_pylist()]
        out: list[tuple] = []
        for chunk in Chunk.each(left):
            words, offsets = K.word_hashes(chunk.body, chunk.offsets)
            wide, start, bounds = K.ngram_hashes(words, offsets, window)
            row = K.row_of(bounds)
            keep = chunk.known[row]
            wide, start, ids = wide[keep], start[keep], chunk.ids[row[keep]]
            keys = np.concatenate([wide, *said])
            firsts = np.concatenate([ids, *least])
            order = np.argsort(keys, kind="stable")
            begin, size = K.groups_of(keys[order])
            smallest = np.empty(len(keys), np.int64)
            if len(begin):
                smallest[order] = np.repeat(np.minimum.reduceat(firsts[order], begin), size)
            again = start[smallest[: len(wide)] < ids]
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, again, 1)
            np.add.at(edge, again + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            count = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
            for i in range(len(chunk.ids)):
                tokens, spans = chunk.text(i).split(), []
                n = len(tokens)
                if count[i]:
                    own = gone[offsets[i] : offsets[i + 1]]
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                    tokens = [w for w, x in zip(tokens, own.tolist(), strict=True) if not x]
                out.append((int(chunk.ids[i]) if chunk.known[i] else None, n, int(count[i]), spans, b" ".join(tokens).decode()))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), span, pa.string())
        return pa.table({n: pa.array([x[k] for x in out], t) for k, (n, t) in enumerate(zip(("doc_id", "n_words", "n_removed", "removed", "kept_text"), kinds, strict=True))})

    return run


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that lies in a window of ``window`` words which also starts in a document with a smaller id.

    Returns one row for each row of ``docs``: doc_id, n_words, n_removed, removed (maximal runs of removed words, as
    word positions, end exclusive) and kept_text (kept words joined by one space).
    A null text is an empty one; both give no words. A row without an id neither removes words nor loses any. Rows
    that repeat an id do not remove words of each other. Windows are judged on the input. An even ``window`` of two
    or more is needed. Other columns are not read. No rows give no rows.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be an even number of words")
    chunks = chunked(id_and_text(docs, id_col, text_col))
    buckets = bucket_count(chunks)
    by_chunk = chunks.groupBy("chunk")
    blocks = chunks.mapInArrow(_ask_blocks(window, buckets), "bucket int, chunk long, asked binary")
    hits = blocks.groupBy("bucket").applyInArrow(_answer_blocks, "chunk long, bucket int, said0 binary")
    windows = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(_ask_windows(window, buckets), "bucket int, chunk long, asked binary, ids binary")
    firsts = windows.groupBy("bucket").applyInArrow(_answer_windows, "chunk long, bucket int, said0 binary, said1 binary")
    return by_chunk.cogroup(firsts.groupBy("chunk")).applyInArrow(_remove(window), RESULT)
