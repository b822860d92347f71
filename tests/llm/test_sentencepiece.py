"""Encoding and decoding against the library."""

import hashlib
import random

import pytest
import sentencepiece

from shapeloom.llm import queries
from shapeloom.llm.sentencepiece_codec import decode, encode, load, round_trip

MODEL = load(queries.PIECES)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
ALPHABET = list("ab ▁\n\t<>/s.0é日本😀́​\x00Zqxü''\"---==##\U0001d4d0ﬁ½") + ["  ", "   ", "the", "ing", "tion", "</s>", "<0x0A>", " ⁇ "]


def hostile(rng):
    text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60)))
    return " " * rng.randrange(70) + text + " " * rng.randrange(40) if rng.random() < 0.2 else text


def test_texts_of_all_kinds():
    rng = random.Random(8)
    texts = ["", " ", "\n", "a  b", "▁", "x" * 5000, " " * 333, "zq" * 40_000, "word " * 4000, *(hostile(rng) for _ in range(4000))]
    for text, ids in zip(texts, MODEL.encode(texts), strict=True):
        assert list(ids) == LIBRARY.encode(text, add_eos=True), text
        assert MODEL.decode(ids) == LIBRARY.decode(ids.tolist()), text


def test_any_ids_are_decoded():
    rng = random.Random(9)
    kinds = [lambda: rng.choice([0, 1, 2]), lambda: rng.randrange(3, 259), lambda: rng.randrange(32_000), lambda: rng.choice([259, 28_705, 35])]
    for _ in range(4000):
        ids = [rng.choice(kinds)() for _ in range(rng.randrange(12))]
        assert MODEL.decode(ids) == LIBRARY.decode(ids), ids


def test_pairs_are_those_that_merging_leaves():
    rng = random.Random(10)
    pieces = list(MODEL.pieces)
    for _ in range(2000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        text = MODEL.pieces[a] + MODEL.pieces[b]
        if text.startswith("▁") and "▁▁" not in text:
            assert MODEL.pairs[a * MODEL.base + b] == (LIBRARY.encode(text[1:].replace("▁", " "), out_type=str) == [MODEL.pieces[a], MODEL.pieces[b]])


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (None, "b c"), (3, "a"), (3, "a"), (4, "w " * 20_000)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, ids int, decoded_sha256 string, n_tokens int")
    got = encode(docs, queries.PIECES)
    assert sorted((str(r.doc_id), r.ids) for r in got.collect()) == sorted((str(i), LIBRARY.encode(t or "", add_eos=True)) for i, t in rows)
    assert sorted((str(r.doc_id), r.text) for r in decode(got, queries.PIECES).collect()) == sorted((str(i), t or "") for i, t in rows)
    whole = round_trip(docs, queries.PIECES).collect()
    assert sorted((str(r.doc_id), r.text) for r in whole) == sorted((str(i), t or "") for i, t in rows)
    assert round_trip(docs.where("false"), queries.PIECES).collect() == [] == decode(got.where("false"), queries.PIECES).collect()
    odd = spark.createDataFrame([(1, None), (2, []), (3, [264, None, 287])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode(odd, queries.PIECES).collect()} == {1: "", 2: "", 3: LIBRARY.decode([264, 287])}
    with pytest.raises(Exception, match="no id outside"):
        decode(spark.createDataFrame([(1, [40_000])], "doc_id long, ids array<int>"), queries.PIECES).collect()


def test_query_equals_the_library(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op12_sentencepiece(spark, "/root/testdata/sf0.001").collect():
        ids = LIBRARY.encode(texts[r.doc_id], add_eos=True)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), LIBRARY.decode(ids))]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *digest)
