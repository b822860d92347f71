"""Language-model scoring by deleted interpolation.

P(w | u) = a[b] * c(u, w) / c(u) + b[b] * c(w) / N + c[b] / (V + 1)

The maximum-likelihood estimates of bigram and unigram and a uniform one are mixed with weights that belong to the
bucket b of the context's frequency c(u). The weights maximise the likelihood of held-out counts, found by
expectation-maximisation: each training token is scored by the counts of all others (its own occurrence deleted).

Counts cover all training texts. A chunk of documents asks the buckets of a hash partitioning for each distinct
n-gram once, and sends its own training count with the question; the bucket adds the counts up and answers. So the
counts are gathered and looked up by one exchange, and frequent n-grams cost a bucket one entry a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeloom.llm import kernels as K
from shapeloom.llm.chunks import Chunk, bucket_count, bucket_of, by_bucket, chunked
from shapeloom.llm.common import id_and_text, written

_U = np.uint64
#: Hashes of the token that ends a text and of the context that begins one.
_END, _START = _U(0x1F83D9ABFB41BD6B), _U(0x5BE0CD19137E2179)
#: Context buckets: 0 for an unseen context, then one for each power of two up to the last.
BUCKETS = 24
#: Held-out counts are gathered in cells: eighths of an octave of the ratio of an estimate to the uniform one.
_STEP, _CELLS = 8, 600


def _tokens(chunk: Chunk):
    """Hashes of all tokens, of their contexts' n-grams, and the offsets of each text's tokens."""
    words, offsets = K.word_hashes(chunk.body, chunk.offsets, lower=True)
    n = len(offsets) - 1
    bounds = offsets + np.arange(n + 1)
    token = np.empty(bounds[-1], _U)
    ends = bounds[1:] - 1
    token[ends] = _END
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner] = words
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[bounds[:-1]] = _START
    return token, context, K.mix(context * _U(0x9E3779B97F4A7C15) ^ K.mix(token + _U(0x2545F4914F6CDD1D))), bounds


def _questions(hashes: np.ndarray, train: np.ndarray, buckets: int):
    """Distinct hashes ordered by bucket, the place of each token in them, and their training counts."""
    bucket = bucket_of(hashes, buckets)
    order = np.lexsort((hashes, bucket))
    ordered = hashes[order]
    begin, _ = K.groups_of(ordered)
    rank = np.empty(len(hashes), np.int64)
    rank[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(ordered))))
    counts = np.add.reduceat(train[order].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
    return ordered[begin], bucket[order][begin], rank, counts


def _planes(hashes: np.ndarray) -> bytes:
    """The low six bytes of each hash, byte by byte, so that the leading bytes of sorted hashes compress."""
    return hashes.view(np.uint8).reshape(-1, 8)[:, 5::-1].T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 5::-1] = planes.T
    return out.view(_U).ravel()


def _small(counts: np.ndarray) -> bytes:
    """Counts, most of them small, as compressed bytes: all low bytes first."""
    return zstandard.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _large(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _ask(buckets: int):
    def run(batches):
        for batch in batches:
            for chunk in Chunk.each(batch):
                token, _, pair, bounds = _tokens(chunk)
                train = np.repeat(chunk.flags == 0, np.diff(bounds))
                rows = []
                for kind, hashes in ((1, token), (2, pair)):
                    asked, bucket, _, counts = _questions(hashes, train, buckets)
                    low = asked & _U((1 << 48) - 1)
                    for b, s in by_bucket(bucket, buckets):
                        order = np.argsort(low[s], kind="stable")
                        rows.append((b, chunk.chunk, kind, _planes(low[s][order]), _small(counts[s][order])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "kind", "asked", "counts"]
                )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Total counts to each chunk, in the order of its question; from the unigrams also a row with tokens and types."""
    kind, bucket = np.array(table.column("kind").to_pylist()), table.column("bucket").to_pylist()[0]
    chunk = table.column("chunk").to_pylist()
    rows = []
    for k in np.unique(kind).tolist():
        mine = np.flatnonzero(kind == k).tolist()
        asked = [_unplaned(table.column("asked")[i].as_py()) for i in mine]
        hashes = np.concatenate(asked)
        counts = np.concatenate([_large(table.column("counts")[i].as_py()) for i in mine]).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        begin, size = K.groups_of(hashes[order])
        total = np.add.reduceat(counts[order], begin)
        back = np.empty(len(hashes), np.int64)
        back[order] = np.repeat(total, size)
        at = 0
        for i, own in zip(mine, asked, strict=True):
            rows.append((chunk[i], bucket, k, _small(back[at : at + len(own)]), 0, 0))
            at += len(own)
        if k == 1:
            rows.append((-1, bucket, 0, b"", int(total.sum()), int((total > 0).sum())))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(("chunk", "bucket", "kind", "counts", "tokens", "types"), kinds, strict=True))})


def _counted(chunk: Chunk, answers: pa.Table, buckets: int):
    """For each token c(w), c(u), c(u, w), and the offsets of each text's tokens."""
    token, context, pair, bounds = _tokens(chunk)
    said = {(k, b): x for k, b, x in zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), strict=True)}
    counted = []
    for kind, hashes in ((1, token), (2, pair)):
        asked, bucket, rank, _ = _questions(hashes, np.zeros(len(hashes), bool), buckets)
        low, total = asked & _U((1 << 48) - 1), np.empty(len(asked), np.int64)
        for b, s in by_bucket(bucket, buckets):
            total[np.arange(s.start, s.stop)[np.argsort(low[s], kind="stable")]] = _large(said[kind, b])
        counted.append(total[rank])
    word, both = counted
    before = np.empty_like(word)
    before[1:] = word[:-1]
    # the context that begins a text is as frequent as the token that ends one
    before[bounds[:-1]] = word[bounds[1:] - 1]
    return word, before, both, bounds


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than its whole logarithm to base two."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _held_out(buckets: int, tokens: int, types: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        cells = []
        for chunk in Chunk.each(left):
            word, before, both, bounds = _counted(chunk, right, buckets)
            keep = np.repeat(chunk.flags == 0, np.diff(bounds))
            word, before, both = word[keep] - 1, before[keep] - 1, both[keep] - 1
            with np.errstate(divide="ignore"):
                one = np.log2(word / max(1, tokens - 1) * (types + 1))
                two = np.log2(both / np.maximum(before, 1) * (types + 1))
            cell = [np.where(np.isfinite(x), np.clip(np.round(np.nan_to_num(x, neginf=0) * _STEP) + _CELLS // 2, 1, _CELLS - 1), 0).astype(np.int64) for x in (one, two)]
            cells.append((_bucket(before) * _CELLS + cell[0]) * _CELLS + cell[1])
        found, n = np.unique(np.concatenate(cells), return_counts=True) if cells else (np.zeros(0, np.int64),) * 2
        return pa.table({"cell": pa.array(found.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    return run


def interpolation_weights(cells: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket by expectation-maximisation over held-out counts."""
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    weights[0] = [0.0, 0.7, 0.3]
    bucket, one, two = cells // _CELLS**2, cells // _CELLS % _CELLS, cells % _CELLS
    ratio = [np.where(x == 0, 0.0, 2.0 ** ((x - _CELLS // 2) / _STEP)) for x in (two, one)] + [np.ones(len(cells))]
    value = np.stack(ratio, axis=1)
    for _ in range(rounds):
        share = weights[bucket] * value
        share *= (counts / share.sum(axis=1))[:, None]
        total = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], axis=1) + weights * 1e-3
        weights = total / total.sum(axis=1, keepdims=True)
    return np.maximum(weights, [0.0, 1e-9, 1e-9])


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(buckets: int, tokens: int, types: int, weights: np.ndarray):
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for chunk in Chunk.each(left):
            word, before, both, bounds = _counted(chunk, right, buckets)
            base = np.log10((word + 1) / (tokens + types + 1))
            # a context whose every count is 0 falls back on the others' share
            mix = weights[_bucket(before)]
            seen = before > 0
            two = np.where(seen, both / np.maximum(before, 1), 0.0)
            p = mix[:, 0] * two + mix[:, 1] * word / max(1, tokens) + mix[:, 2] / (types + 1)
            p = np.where(seen, p, p / np.maximum(mix[:, 1] + mix[:, 2], 1e-300))
            n = np.diff(bounds)
            sums = [np.add.reduceat(x, bounds[:-1]) for x in ((word > 0).astype(np.int64), base, np.log10(p))]
            ids = pa.array(chunk.ids, pa.int64(), mask=~chunk.known)
            columns = (ids, chunk.flags == 1, n, sums[0], np.full(len(n), tokens, np.int64), sums[1], sums[2])
            parts.append(pa.table({name: pa.array(c, t) if not isinstance(c, pa.Array) else c for name, c, t in zip(names, columns, kinds, strict=True)}))
        return pa.concat_tables(parts) if parts else pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})

    return run


def score_texts(docs: DataFrame, folds: int = 7, held_out_fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text by a bigram model with deleted interpolation, learnt from the texts outside one fold.

    A document's fold is crc32(id as text) mod ``folds``; ``held_out_fold`` is not learnt from. Tokens are words with
    A-Z lower-cased and one end. Returns for each row of ``docs``: doc_id, held_out, n_tokens, n_known (tokens that
    occur in training), train_tokens, base_score (add-one unigram) and score (the model's log10 probability).
    A null text is an empty one: only the end is scored. A row without an id is in no fold: it is learnt from and
    scored. Rows that repeat an id all count. Without training tokens every count is 0 and each estimate uniform.
    Other columns are not read. No rows give no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out_fold).cast("int")
    chunks = chunked(rows, out)
    buckets = bucket_count(chunks)
    asked = chunks.mapInArrow(_ask(buckets), "bucket int, chunk long, kind int, asked binary, counts binary")
    answers = written(asked.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, kind int, counts binary, tokens long, types long"), "counts")
    size = answers.where("chunk = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()
    replies = answers.where("chunk >= 0").select("chunk", "bucket", "kind", "counts").groupBy("chunk")
    both = chunks.groupBy("chunk").cogroup(replies)
    # a fixed number of cells, whatever the size of the corpus
    cells = both.applyInArrow(_held_out(buckets, size.n, size.v), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = interpolation_weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64))
    return both.applyInArrow(_scores(buckets, size.n, size.v, weights), RESULT)
