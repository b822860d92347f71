"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (one to three letters, with the spaces between words) in order.
A document's own most frequent n-grams are compared with each profile by the out-of-place distance: the sum of the
differences in rank, with the profile's length for an n-gram that it lacks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shapeloom.llm import kernels as K
from shapeloom.llm.common import discard, written

#: N-grams of a profile; n-grams up to so many letters; distinct n-grams that a task gathers before it sends them on.
PROFILE, ORDER, FLUSH = 400, 3, 250_000
#: Languages whose profiles fit into a task.
LANGUAGES = 2000
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    if "letters" not in _tables:
        table = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables["letters"] = table
    return _tables["letters"]


def ngrams(text: str | None) -> np.ndarray:
    """Codes of a text's n-grams, in any order; runs of what is no letter count as one space."""
    if not text:
        return np.zeros(0, np.int64)
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not codes.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[(codes > 0) | np.concatenate([[True], codes[:-1] > 0])]
    two = (codes[:-1] << 21) | codes[1:]
    return np.concatenate([codes[codes > 0], two, (two[:-1] << 21) | codes[2:]][:ORDER])


def _counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    grams = np.sort(grams)
    begin = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[begin], np.diff(np.append(begin, len(grams)))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[begin], np.add.reduceat(counts, begin)


def _learn(batches):
    held: dict[str, list] = {}

    def out(lang: str):
        grams, counts = _merge(held.pop(lang))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    for batch in batches:
        waiting: dict[str, list] = {}
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            own = waiting.setdefault(lang, [])
            own.append(ngrams(text.as_py()))
            if sum(map(len, own[-64:])) > 500_000 or len(own) >= 64:
                held.setdefault(lang, []).append(_counted(np.concatenate(own)))
                own.clear()
        for lang, own in waiting.items():
            if own:
                held.setdefault(lang, []).append(_counted(np.concatenate(own)))
        for lang in list(held):
            held[lang] = [_merge(held[lang])] if held[lang] and sum(len(p[0]) for p in held[lang]) else []
            if not held[lang]:
                held.pop(lang)
            elif len(held[lang][0][0]) > FLUSH:
                yield out(lang)
    for lang in list(held):
        yield out(lang)
    K.tidy()


def profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): the profile of each language in ``docs`` (text, lang), rank from 0; ties by the n-gram's code."""
    counts = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_learn, "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return total.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


def _predict(langs: list[str], grams: np.ndarray, ranks: np.ndarray, size: int):
    """A function from texts to structs of lang_pred and score. Only texts go to Python; other columns stay where they are."""

    def run(texts: pa.Array) -> pa.Array:
        preds, scores = [], []
        for scalar in texts:
            found = ngrams(scalar.as_py())
            if not len(found) or not langs:
                preds.append("und")
                scores.append(0.0)
                continue
            own, counts = _counted(found)
            if len(own) > size:
                # the most frequent, ties by code
                least = np.partition(counts, len(counts) - size)[len(counts) - size]
                keep = counts >= least
                own, counts = own[keep], counts[keep]
            top = own[np.argsort(-counts, kind="stable")[:size]]
            at = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
            theirs = np.where((grams[at] == top)[:, None], ranks[at], size)
            place = np.arange(len(top))[:, None]
            apart = np.where(theirs == size, size, np.abs(theirs - place)).sum(axis=0)
            best = int(np.argmin(apart))
            preds.append(langs[best])
            scores.append(float(1.0 - apart[best] / (size * len(top))))
        K.tidy()
        return pa.StructArray.from_arrays([pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return run


def identify(docs: DataFrame, folds: int = 5, held_out_fold: int = 0, size: int = PROFILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """The language of every whole text, learnt from the rows outside one fold that name their language.

    A row's fold is crc32(id as text) mod ``folds``. Returns for each row of ``docs``: doc_id, held_out, lang_pred (a
    learnt language; the first by name where two are equally near), score (1 less the distance over the greatest
    possible one). A text that is null or has no letter is ``und`` with score 0, and so is every text where nothing
    could be learnt. A row without an id is in no fold. Repeated rows all count. The columns named in ``keep`` are
    passed on as they are; no other column is read. No rows give no rows. More than LANGUAGES languages are an error,
    as the profiles of all of them are held in memory.
    """
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    fold = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held_out_fold, F.lit(False))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), fold.alias("held_out"), *(c for c in keep if c != text_col))
    known = docs.where(~fold).select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # some hundred n-grams for each language
    table = written(profiles(known, size), "profiles")
    if table.select("lang").distinct().count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    profile = table.toPandas()
    discard(table)
    langs = sorted(profile["lang"].unique())
    grams = np.unique(profile["gram"].to_numpy(np.int64))
    ranks = np.full((len(grams), len(langs)), size, np.int64)
    for k, lang in enumerate(langs):
        own = profile[profile["lang"] == lang]
        ranks[np.searchsorted(grams, own["gram"].to_numpy(np.int64)), k] = own["rank"].to_numpy(np.int64)
    # called once a row: without this, a filter on the result would have it made once more before the filter
    predict = F.arrow_udf(_predict(langs, grams, ranks, size), "struct<lang_pred:string,score:double>").asNondeterministic()
    found = docs.select(doc_id.alias("doc_id"), fold.alias("held_out"), predict(text).alias("found"), *keep)
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", *keep)
