"""Vectorised helpers that run inside tasks: words and word n-grams of an Arrow column of texts as 64-bit hashes.

A word's hash is a polynomial over its bytes modulo 2**64, taken from running sums, so one pass serves all words;
an n-gram's hash is the same over word hashes. Both are mixed afterwards.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _LIBC = ctypes.CDLL(None)
except OSError:  # no such library to be found on this system
    _LIBC = None
_M_BYTE, _M_WORD = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Texts are worked on in slices of about so many bytes; a longer text is a slice of its own.
SLICE = 1_200_000
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def tidy() -> None:
    """Give freed memory back to the system, so that a worker that is used again begins small."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > 8 * SLICE:
            return made[0], made[1]
        _powers[base] = (made[0], made[1])
    return _powers[base]


def _ranges(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each range the sum of values[i] * base**(i - start)."""
    up, down = _power(base, len(values) + 1)
    sums = np.empty(len(values) + 1, _U)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > most:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def lower_bytes(body: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[body]


def word_places(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends; a word does not reach into the next row."""
    word = ~_SPACE[body]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = word[heads]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(body: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offsets of each row's words."""
    if not len(body):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    starts, ends = word_places(body, offsets)
    hashes = _ranges(_BYTE[_LOWER[body] if lower else body], _M_BYTE, starts, ends)
    hashes += (ends - starts).astype(_U) * _U(0xA0761D6478BD642F)
    return mix(hashes), np.searchsorted(starts, offsets).astype(np.int64)


def word_beginnings(body: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each number of bytes, hashes of the beginnings of all words, A-Z lower-cased; 0 for a shorter word."""
    if not len(body):
        return [np.zeros(0, _U) for _ in sizes]
    starts, ends = word_places(body, offsets)
    values = _BYTE[_LOWER[body]]
    made = []
    for n in sizes:
        found = mix(_ranges(values, _M_BYTE, starts, np.minimum(starts + n, ends)) + _U(n * 0xE7037ED1A0B428DB % (1 << 64)))
        made.append(np.where(ends - starts >= n, found, _U(0)))
    return made


def ngram_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row, the word index of each, and the offsets of each row's runs."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if not bounds[-1]:
        return np.zeros(0, _U), np.zeros(0, np.int64), bounds
    starts = np.arange(bounds[-1], dtype=np.int64) + np.repeat(offsets[:-1] - bounds[:-1], counts)
    return mix(_ranges(words, _M_WORD, starts, starts + n) + _U(n)), starts, bounds


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin in a sorted array, and how long they are."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return begin, np.diff(np.append(begin, len(keys)))
