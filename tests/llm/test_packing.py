import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from shapeloom.llm import packing
from shapeloom.llm.queries import TOKENIZER


def test_added_tokens_are_those_of_an_unmodified_tokenizer(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  \n y", "<|endoftext", "plain text", ""]
    plain = Tokenizer.from_file(TOKENIZER)
    want = {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 0]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENIZER).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def checked(rows, length):
    """Sequences hold their pieces without gaps or overlaps; the number of sequences, and pieces of each round's group."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= length
    return len(sequences), Counter(r.sequence_id // 100_000_000 for r in rows)


def test_certified_groups_keep_their_bins(spark):
    """Pieces of more than half a sequence: every group meets its bound, so they never gather in one group."""
    docs = spark.createDataFrame([(i, " a" * (33 + i % 28)) for i in range(400)], "doc_id long, text string")
    rows = packing.pack(docs, TOKENIZER, 64, per_group=20).collect()
    assert len(rows) == 400
    n, groups = checked(rows, 64)
    assert n == 400 and max(groups.values()) <= 80


#: Bins above the bound that are left at groups of 20 pieces.
GAP = 3


def test_open_groups_stay_bounded(spark):
    """Thirds and a bit: no group meets its bound; groups stay bounded all the same, and the bins near the bound."""
    docs = spark.createDataFrame([(i, " a" * (14 + i * 7919 % 31)) for i in range(600)], "doc_id long, text string")
    rows = packing.pack(docs, TOKENIZER, 64, per_group=20).collect()
    n, groups = checked(rows, 64)
    bound = packing.lower_bound(np.array([r.length for r in rows]), 64)
    assert sorted(r.doc_id for r in rows) == list(range(600))
    assert bound <= n <= bound + GAP and max(groups.values()) <= 80
