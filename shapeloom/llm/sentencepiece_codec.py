"""SentencePiece encoding and decoding of a merge-type (BPE) model, by a table over the prefixes of a text.

Merging is local: a sequence of pieces is the encoding of its text exactly where each neighbouring pair is the encoding
of its own two pieces' text. So each prefix of a text has one last piece, the one that ends there, and that goes with the
last piece of the prefix before it. An automaton finds the pieces that end at each place, the test of pairs picks the
right one, the table keeps it, and the encoding is read off the table from the end.

Where no piece of the vocabulary holds two neighbouring characters, a text can be cut between them: before white space,
and between words and most marks. The ids of such parts are remembered; a text without a cut is one part, and takes time
in proportion to its length all the same.
"""

from __future__ import annotations

import array
import codecs
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeloom.llm import kernels as K
from shapeloom.llm.common import id_and_text

SPACE = "▁"
#: Parts of texts and pairs of pieces that a worker remembers, and characters of the longest such part.
WORDS, PAIRS, LONGEST_WORD = 200_000, 400_000, 48


def _chunks(beside: set[str]) -> re.Pattern:
    """Parts of a normalised text that no piece reaches beyond. ``beside`` has the pairs of neighbours within pieces.

    A part is white space and marks with the word behind them; it goes on where a mark follows words in some piece. A
    character without neighbours is a part of its own.
    """
    known = {c for pair in beside for c in pair}
    letters = {c for c in known if c.isalpha()}
    if any(y == SPACE != x for x, y in beside) or not letters:
        return re.compile("(?s).+")
    among = lambda chars: "".join(map(re.escape, sorted(chars)))
    word, mark = f"[{among(letters)}]", f"[{among(known - letters - {SPACE})}]"
    joined = {y for x, y in beside if x in letters} - letters
    more = f"(?:[{among(joined)}]{mark}*{word}*)*" if joined else ""
    return re.compile(f"[^{among(known | {SPACE})}]+|{SPACE}*(?:{mark}+{word}*|{word}+){more}|{SPACE}+")


class Automaton:
    """Finds the pieces that end at a place: a state for each beginning of a piece, the longest that fits counts.

    Pieces of a state are kept longest first. Steps are looked up once and remembered.
    """

    def __init__(self, pieces: dict[str, int]):
        self.steps: list[dict[str, int]] = [{}]
        self.found: list[tuple[tuple[int, int], ...]] = [()]
        below, own = [0], {}
        for piece, i in pieces.items():
            state = 0
            for c in piece:
                if c not in self.steps[state]:
                    self.steps[state][c] = len(self.steps)
                    self.steps.append({})
                state = self.steps[state][c]
            own[state] = (i, len(piece))
        self.found *= len(self.steps)
        below *= len(self.steps)
        edges = [dict(s) for s in self.steps]
        waiting = [0]
        for state in waiting:
            for c, after in edges[state].items():
                if state:
                    at = below[state]
                    while at and c not in edges[at]:
                        at = below[at]
                    below[after] = edges[at].get(c, 0)
                self.found[after] = ((own[after],) if after in own else ()) + self.found[below[after]]
                waiting.append(after)
        self.edges, self.below = edges, below

    def step(self, state: int, c: str) -> int:
        """The state after a character that the state has no step for as yet."""
        at = state
        while at and c not in self.edges[at]:
            at = self.below[at]
        after = self.edges[at].get(c, 0)
        # characters of no piece are not remembered: there are too many
        if after:
            self.steps[state][c] = after
        return after


class Pairs(dict):
    """Whether a pair of pieces is the encoding of its own text, as far as asked. A key holds both pieces' numbers."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, key: int) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        pair = [self.model.piece(i) for i in divmod(key, self.model.base)]
        self[key] = fits = self.model.merged("".join(pair)) == pair
        return fits


class Model:
    """A merge-type model without user-defined or unused pieces. Its texts are normalised as its file says."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        known = range(lib.get_piece_size())
        special = [i for i in known if lib.is_control(i) or lib.is_unknown(i)]
        self.base = len(known)
        self.pieces = {i: lib.id_to_piece(i) for i in known if i not in special and not lib.is_byte(i)}
        self.scores = {p: lib.get_score(i) for i, p in self.pieces.items()}
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(lib.is_byte(i) for i in self.bytes)
        # a piece that merging its own characters doesn't make is no encoding of anything
        self.automaton = Automaton({p: i for i, p in self.pieces.items() if len(p) == 1 or self.merged(p) == [p]})
        self.pairs = Pairs(self)
        self.chunks = _chunks({x + y for piece in self.scores for x, y in zip(piece, piece[1:], strict=False)})
        #: ids of parts of texts, those met lately and those met before
        self.newer, self.older = {}, {}
        self.surface = [b""] * len(known)
        for i, piece in self.pieces.items():
            self.surface[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes if self.has_bytes else []):
            self.surface[i] = bytes([b])
        self.silent = {i for i in special if i != self.unknown}
        self.surface[self.unknown] = lib.decode([self.unknown]).encode()
        #: whether the first white space was put there by the model
        self.adds_space = lib.normalize("a").startswith(SPACE)

    def piece(self, i: int) -> str:
        """The piece of a number; numbers beyond the vocabulary are characters outside of it."""
        return self.pieces[i] if i < self.base else chr(i - self.base)

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by the rule itself: the best pair first, ties from the left."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def ids_of(self, parts: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each part of normalised texts: the last piece of each prefix, then the way back from the end.

        Parts are taken in order, so that the table of a prefix serves all that begin with it.
        """
        steps, found, pairs, base = self.automaton.steps, self.automaton.found, self.pairs, self.base
        made, states, last, lengths, before = {}, [0], [], [], ""
        for part in sorted(parts):
            same = 0
            for x, y in zip(before, part, strict=False):
                if x != y:
                    break
                same += 1
            del states[same + 1 :], last[same:], lengths[same:]
            state, place, before = states[-1], same, part
            for c in part[same:] if same else part:
                place += 1
                state = steps[state].get(c) or self.automaton.step(state, c)
                states.append(state)
                for i, length in found[state]:
                    if length == place or pairs[last[-length] * base + i]:
                        last.append(i)
                        lengths.append(length)
                        break
                else:
                    last.append(base + ord(c))
                    lengths.append(1)
            out, at = [], len(part) - 1
            while at >= 0:
                out.append(last[at])
                at -= lengths[at]
            out.reverse()
            made[part] = tuple(out if max(out) < base else self._known(out))
        return made

    def _known(self, ids: list[int]) -> Iterator[int]:
        """Ids where numbers beyond the vocabulary stand for characters outside of it."""
        before = 0
        for i in ids:
            if i < self.base:
                yield i
            elif self.has_bytes:
                yield from (self.bytes[b] for b in chr(i - self.base).encode())
            elif before < self.base:
                yield self.unknown
            before = i

    def encode(self, texts: list[str]) -> list[array.array]:
        """The ids of each text, with an end id."""
        parts = [self.chunks.findall(self.library.normalize(text)) for text in texts]
        newer, older = self.newer, self.older
        met = set().union(*parts)
        ids = {p: newer[p] if p in newer else older[p] for p in met if p in newer or p in older}
        ids |= self.ids_of(met.difference(ids))
        made = [array.array("i", chain.from_iterable(map(ids.__getitem__, p))) for p in parts]
        for x in made:
            x.append(self.end)
        newer.update((p, i) for p, i in ids.items() if len(p) <= LONGEST_WORD)
        if len(newer) > WORDS:
            self.newer, self.older = {}, newer
        return made

    def decode(self, ids) -> str:
        """The text of any ids. A byte that is no part of a character becomes U+FFFD; special ids are silent."""
        ids = list(ids)
        while ids and ids[-1] in self.silent:
            ids.pop()
        # a silent id ends a run of bytes
        cuts = [k for k, i in enumerate(ids) if i in self.silent] if not self.silent.isdisjoint(ids) else []
        runs = [b"".join(map(self.surface.__getitem__, ids[a:b])) for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)]
        if self.adds_space:
            first = next((i for i in ids if self.surface[i]), None)
            if first in self.pieces and self.surface[first][:1] == b" ":
                k = next(k for k, run in enumerate(runs) if run)
                runs[k] = runs[k][1:]
        return "".join(run.decode("utf-8", "each-byte") for run in runs)


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each-byte", _each_byte)


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    """A worker's model, made once."""
    return Model(path)


def _lists(sizes: list[int], flat: array.array) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))


def _encoded(docs: DataFrame, path: str, decoded: bool) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for a, b in K.slices(batch.column("text")):
                part, flat, sizes, texts = batch.slice(a, b - a), array.array("i"), [], []
                for ids in model.encode([text or "" for text in part.column("text").to_pylist()]):
                    flat.extend(ids)
                    sizes.append(len(ids))
                    if decoded:
                        texts.append(model.decode(ids))
                columns = {"doc_id": part.column("doc_id"), "ids": _lists(sizes, flat)} | ({"text": pa.array(texts, pa.string())} if decoded else {})
                yield pa.RecordBatch.from_pydict(columns)
        K.tidy()

    return docs.mapInArrow(each, "doc_id long, ids array<int>" + ", text string" * decoded)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text as the model's library gives them, with an end id only.

    A null text counts as empty, and both have the end id alone. Rows without an id and repeated rows are encoded like
    all others; an empty table gives none. Extra columns are not read.
    """
    return _encoded(id_and_text(docs, id_col, text_col), path, False)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of each row's ids. No ids, and null, give an empty text; null among ids is left out.

    An id that the model doesn't have is an error. Rows without an id and repeated rows are decoded like all others.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        known = range(len(model.surface))
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                ids = [i for i in ids or () if i is not None]
                if not all(i in known for i in ids):
                    raise ValueError(f"the model has no id outside 0 to {len(known) - 1}")
                texts.append(model.decode(ids))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    kept = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return kept.mapInArrow(each, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, text, ids_sha256, decoded_sha256): encode(), and what decode() makes of the ids, in one pass."""
    found = _encoded(id_and_text(docs, id_col, text_col), path, True)
    digest = lambda c: F.sha2(c, 256)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text", digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256")
    )
