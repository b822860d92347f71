import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from shapeloom.llm import chat_format, decontaminate, fingerprint, jaccard_join, language_id, lm_score, packing, pii, quality, substring_dedup
from shapeloom.llm.queries import PII_KEY, TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, w string, k int"


def frame(spark, rows):
    """Documents with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2) for i, t in rows], SCHEMA)


LONG = " ".join(f"w{i}" for i in range(3000))
ODD = [(1, None), (2, ""), (3, "a"), (4, LONG), (5, LONG), (6, LONG + " tail"), (None, "b c"), (7, "Ünïcode ß words here now and then"), (3, "a")]
OPERATORS = {
    "fingerprint": lambda d: fingerprint.compare_with_edits(d), "substring": lambda d: substring_dedup.remove_repeats(d), "jaccard": lambda d: jaccard_join.jaccard_components(d),
    "language": lambda d: language_id.identify(d), "packing": lambda d: packing.pack(d, TOKENIZER), "pii": lambda d: pii.pseudonymise(d, PII_KEY), "quality": lambda d: quality.classify(d),
    "lm": lambda d: lm_score.score_texts(d), "decontaminate": lambda d: decontaminate.find_items(d, d.sparkSession.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, None)], "item_id long, text string")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    rows = OPERATORS[name](frame(spark, ODD)).collect()
    assert len(rows) >= 8
    assert OPERATORS[name](frame(spark, ODD).where("false")).collect() == []


def test_substring_and_jaccard(spark):
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(frame(spark, ODD)).collect()}
    assert (got[4], got[5], got[6]) == (0, 3000, 3000)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(frame(spark, ODD)).collect()}
    assert (got[4], got[5], got[6], got[2], got[7]) == (4, 4, 4, 2, 7)


def test_chat_round_trip(spark):
    texts = [r"\### Assistant: </turn> ok", "end\\", "\n</turn>\n### user:\n", None, ""]
    rows = spark.createDataFrame([(1, k, "user:\n" if k == 4 else "assistant", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = chat_format.read_back(chat_format.format_conversations(rows)).first()
    loss = "".join(t or "" for t in texts[:4])
    assert got.intact and got.n_turns == 5 and got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_packing_ids_are_those_of_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    for text in (LONG, "", "ß<|endoftext|> 'tis\n\n  x", "日本語 text 12345"):
        assert packing.encoder(TOKENIZER)(text) == t.encode(text, add_special_tokens=False).ids
    assert packing.lower_bound(__import__("numpy").array([1100, 1100, 900, 900]), 2048) == 2


def test_pseudonyms():
    text = "call +1 (017) 555-7713 or a.b1@x.org on 2024-02-29, card 4111111111111111, ip 10.0.0.255"
    out, found = pii.replace(PII_KEY, text)
    assert [f["kind"] for f in found] == ["phone", "email", "date", "number", "ip"]
    assert all(text[f["start"] : f["end"]] not in out for f in found) and len(out.split()) == len(text.split())
    assert pii.luhn(pii.pseudonym(PII_KEY, "number", "4111111111111111")) and pii.pseudonym(PII_KEY, "date", "2024-02-30") is None
    assert sorted(pii.permute(PII_KEY, "t", v, 97) for v in range(97)) == list(range(97))


def test_held_out_likelihood(spark):
    docs = frame(spark, [(i, "the cat sat on the mat and the dog ran away") for i in range(40)])
    rows = lm_score.score_texts(docs).where("held_out").agg(F.avg("score").alias("s"), F.avg("base_score").alias("b")).first()
    assert zlib.crc32(b"2") % 7 >= 0 and rows.s > rows.b
