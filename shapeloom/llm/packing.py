"""Best-fit packing that lower bounds certify.

Documents become token ids; what is longer than a sequence is cut. Pieces are dealt into partitions, each packed by
best-fit decreasing. Dual feasible functions give a lower bound of every partition's bins. A partition that meets its
bound is certified and keeps its bins but for a few of the least filled, which are handed on. From the others, all bins
that are not full are opened again. Open pieces are dealt anew into as many groups as their number asks for, so a
group's size stays bounded, until the bound over all pieces is met, one group holds them, or a round gains (next to)
nothing; then the better of the last two packings stays and the gap to the bound is logged.
"""

from __future__ import annotations

import base64
import bisect
import logging
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeloom.llm.common import id_and_text, written
from shapeloom.llm.kernels import tidy

#: Tokens of a sequence; pieces of a group, about; and bins that a certified group hands on.
LENGTH, PER_GROUP, HANDED = 2048, 20_000, 8
#: Rounds in a row that save no bin, each with another deal of the open pieces, before the exchange ends above the bound.
PATIENCE = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_loaded: dict[tuple[str, bool], object] = {}


def encoder(path: str, added: bool = False):
    """The tokenizer of a file as a function of one text. Kept for each Python worker.

    With ``added``, the file's added tokens are found in a text, as tokenizers does by default; without, they are text
    like any other. A text that holds none has the same ids either way.

    The byte-level BPE is run by tiktoken from the same vocabulary's ranks, where the file has a sister ``.tiktoken``:
    the ids are those of tokenizers (a test holds them against each other) at six times its speed. A text that
    tiktoken's pattern engine gives up on is encoded by tokenizers.
    """
    if (path, added) not in _loaded:
        from pathlib import Path

        names = tuple(t.content for t in _plain(path, added).get_added_tokens_decoder().values()) if added else ()
        slow = lambda text: _tokenizer(path, added).encode(text, add_special_tokens=False).ids
        sister = Path(path).with_suffix(".tiktoken")
        if sister.exists():
            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sister.open("rb"))}
            fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

            def encode(text: str) -> list[int]:
                if any(name in text for name in names):
                    return slow(text)
                try:
                    return fast(text)
                except (ValueError, RuntimeError):
                    return slow(text)

            _loaded[path, added] = encode
            tidy()
        else:
            _loaded[path, added] = slow
    return _loaded[path, added]


def _plain(path: str, added: bool):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = not added
    return plain


@lru_cache(2)
def _tokenizer(path: str, added: bool):
    """The file's own tokenizer, loaded by a worker only where a text asks for it."""
    return _plain(path, added)


def _cut(path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added=True)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end], "<u4")
                first = len(ids) % length or length
                at = [0, *range(first, len(ids) + 1, length)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of dual feasible functions over the counts of each length."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1))


def bound_of_counts(count: np.ndarray) -> int:
    """The lower bound from the number of pieces of each length from 0 to the capacity."""
    capacity = len(count) - 1
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # above capacity - k: a bin of its own; below k: nothing; between: its length
    ahead, mass = np.cumsum(count[::-1])[::-1], np.concatenate([[0], np.cumsum(count * size)])
    for k in range(1, capacity // 2 + 1):
        large = int(ahead[capacity - k + 1])
        best = max(best, large + -(-int(mass[capacity - k + 1] - mass[k]) // capacity))
    # multiples: (k+1)x a whole number of capacities counts itself, else rounds down to k parts
    for k in range(1, 20):
        scaled = (k + 1) * size
        part = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * part).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the place of each length, and the room left in each bin. Ties keep their order."""
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            left = rooms[at]
            b = free[left].pop()
            if not free[left]:
                rooms.pop(at)
        else:
            b, left = len(room), capacity
            room.append(capacity)
        bins[i], places[i] = b, capacity - left
        left -= n
        room[b] = left
        if left:
            if not free[left]:
                bisect.insort(rooms, left)
            free[left].append(b)
    return bins, places, np.array(room, np.int64)


def _pack(capacity: int):
    """Pack one group. open: whether a piece's bin is given to the next exchange."""

    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "piece", "ids_crc32", "start"], ascending=[False, True, True, True, True], kind="stable")
        lengths = pieces["length"].to_numpy(np.int64)
        bins, places, room = best_fit(lengths, capacity)
        handed = room > 0
        if len(room) <= lower_bound(lengths, capacity):
            handed[np.argsort(-room, kind="stable")[HANDED:]] = False
        return pieces.assign(bin=bins, offset=places, open=handed[bins])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = 0, per_group: int = PER_GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the tokens of every whole text into sequences of at most ``length`` tokens.

    A document is its ids by the tokenizer file ``tokenizer``, its added tokens included, then ``end``. Only a longer
    one is cut, into pieces of ``length``; the first piece may be shorter. Returns one row for each piece: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset. A null text is an empty one: a piece of one token. Null ids
    pass through; repeated rows are documents of their own. Other columns are not read. No rows give no rows. The
    number of sequences and the lower bound over all pieces are logged.
    """
    pieces = written(id_and_text(docs, id_col, text_col).mapInArrow(_cut(tokenizer, length, end), PIECES), "pieces")
    columns = [f.name for f in pieces.schema]
    alone = pieces.where(F.col("length") == length)
    rest = pieces.where(F.col("length") < length)
    # one row for each length that occurs
    counts = np.zeros(length + 1, np.int64)
    for n, k in pieces.groupBy("length").count().collect():
        counts[n] = k
    bound, total = bound_of_counts(counts), int(counts[length])
    # full pieces have numbers below 0, by their place in the written table; packed sequences have others
    done = [alone.select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, held, held_bins, held_left, turn, vain = int(counts[:length].sum()), None, 0, 0, 0, 0
    while left:
        groups = -(-left // per_group)
        if turn >= 2000 or groups >= 4_000_000:
            raise ValueError("numbers of sequences would not be unique: take larger groups")
        key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(groups)).cast("int")
        packed = rest.select(*columns).withColumn("group", key).groupBy("group").applyInPandas(_pack(length), f"{PIECES}, group int, bin long, offset long, open boolean")
        # rounds, groups and bins are numbered apart: no two sequences share a number
        number = (F.lit(turn + 1).cast("long") * 4_000_000 + F.col("group")) * 100_000_000 + F.col("bin")
        packed = written(packed.select(*columns, number.alias("sequence_id"), "offset", "open"), "packed")
        found = {r["open"]: (r.bins, r.n) for r in packed.groupBy("open").agg(F.count_distinct("sequence_id").alias("bins"), F.count("*").alias("n")).collect()}
        (shut, _), (ajar, left) = found.get(False, (0, 0)), found.get(True, (0, 0))
        better = held is None or shut + ajar < held_bins
        vain = 0 if better else vain + 1
        if groups == 1 or total + shut + ajar <= bound or vain >= PATIENCE:
            done.append((packed if better else held).select(*columns, "sequence_id", "offset"))
            total += shut + ajar if better else held_bins
            break
        if not better:
            # what was held stays, and is dealt anew
            turn, left = turn + 1, held_left
            continue
        done.append(packed.where(~F.col("open")).select(*columns, "sequence_id", "offset"))
        total += shut
        held = rest = packed.where("open")
        held_bins, held_left, turn = ajar, left, turn + 1
    logging.getLogger(__name__).info("%d sequences, lower bound %d, gap %d", total, bound, total - bound)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
