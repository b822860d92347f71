import hashlib
import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from shapeloom.llm import chat_format, oracle, queries

SCHEMA = "conv_id long, turn long, role string, text string, formatted int, body string"
PIECES = ["###", "</turn>", "\\", "\n", " ", "### user:\n", "\n</turn>\n", "a", "b:", "%3A", "é日"]


def hostile(seed, n):
    rng = random.Random(seed)
    said = lambda: "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))
    return [(i % 40, i // 40, rng.choice(["user", "assistant", "system", "odd:%\nrole"]), said()) for i in range(n)]


def plain(rows):
    """The digests by hand, for rows in order."""
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = [r[3] or "" for r in own if r[2] == "assistant"]
        out[conv] = (len(own), digest("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len("".join(loss)), digest("".join(loss)))
    return out


def test_hostile_texts_read_back(spark):
    rows = hostile(1, 2000) + [(None, 1, "user", "x"), (None, 1, "user", "x"), (50, None, None, None), (50, 2, "assistant", None), (51, 1, "assistant", "word ### " * 20_000)]
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(4)
    got = chat_format.read_back(chat_format.format_conversations(frame)).collect()
    assert all(r.intact for r in got)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == plain(rows)
    assert chat_format.format_conversations(frame.where("false")).collect() == []


def test_escapes_only_where_needed(spark):
    texts = ["a ### b", "x </turn> y", "\n</turn>\n", "\\###", "\\</turn>", "\\### and\n</turn>\n", "</turn>\nrest", "rest\n</turn>"]
    frame = spark.createDataFrame([(k, 1, "user", t) for k, t in enumerate(texts)], "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r.formatted for r in chat_format.format_conversations(frame).collect()}
    head, end = "### user:\n", "\n</turn>\n"
    want = ["a ### b", "x </turn> y", "\n\\</turn>\n", "\\\\###", "\\\\</turn>", "\\\\### and\n\\</turn>\n", "\\</turn>\nrest", "rest\n\\</turn>"]
    assert [got[k] for k in range(len(texts))] == [head + w + end for w in want]


def test_sql_follows_the_same_rule(spark, tmp_path, monkeypatch):
    rows = hostile(3, 600)
    table = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
    table.to_parquet(tmp_path / "conversations.parquet")
    with duckdb.connect() as db:
        db.register("conversations", table)
        want = {r[0]: r[1:6] for r in db.sql(oracle.SQL["op1_chat_format"]).fetchall()}
    got = {r.conv_id: tuple(r)[1:6] for r in queries.op1_chat_format(spark, str(tmp_path)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}
    assert got == want and got[-7][0] == 2


def test_loss_spans_are_code_points(spark):
    frame = spark.createDataFrame([(1, 1, "user", "é"), (1, 2, "assistant", "日本 ok")], "conv_id int, turn int, role string, text string")
    row = chat_format.format_conversations(frame).select("formatted", F.col("loss_spans")[0].alias("s")).first()
    assert row.formatted[row.s.start : row.s.start + row.s.length] == "日本 ok"
