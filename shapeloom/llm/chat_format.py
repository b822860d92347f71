"""Chat formatting with a grammar that is read back: DataFrame functions only.

    conversation = { turn }
    turn         = "### " role ":\n" text "\n</turn>\n"

In a role, "%", ":" and line feeds are written as "%25", "%3A" and "%0A". In a text, "###" and "</turn>" are control
strings. A text is first rendered as it is and read back by the grammar's parser. As long as that does not give the
text again, it is escaped further: first every "</turn>", then every control string, with the backslashes before it,
gets one backslash more, which the parser takes away. The last form reads back as any text: a real marker begins a line,
so no backslash ever stands before one. The parser is a split at real turn ends and one pattern a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ":\n", "\n</turn>\n"
_CONTROL = r"(\\*)(###|</turn>)"
_ENDS = r"(\\*)(</turn>)"
_ESCAPED = r"\\(\\*)(###|</turn>)"


def escape(text: Column, what: str = _CONTROL) -> Column:
    return F.regexp_replace(text, what, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def encoded(role: Column) -> Column:
    """A role without colons and line feeds."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")), F.lit("\n"), F.lit("%0A"))


def decoded(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), encoded(role), F.lit(COLON), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, by the grammar alone."""
    pieces = F.split(formatted, r"\Q" + END + r"\E", -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    cut = lambda p: F.instr(p, COLON)
    return F.transform(
        turns,
        lambda p: F.struct(
            decoded(F.substring(p, len(HEAD) + 1, cut(p) - len(HEAD) - 1)).alias("role"),
            unescape(F.substring(p, cut(p) + len(COLON), F.length(p))).alias("text"),
        ),
    )


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """One formatted text for each conversation, with the places that a loss mask keeps.

    Returns conv_id, formatted, n_turns, loss_spans (array of start, length: code points of ``formatted``, from 0, of
    each text of ``learn_role``, escapes included) and intact (whether the text that is read back equals the rows).
    Rows are ordered by turn, then role, then text, nulls first, so ties have one order; repeated rows are repeated
    turns. A null role or text is an empty one. Rows without a conversation id make up one conversation with a null
    id. Other columns are not read. No rows give no rows. A conversation is one text, so its rows meet in one task.
    """
    clean = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")

    def identical(body: Column) -> Column:
        """Whether a turn with this body reads back as the row."""
        parsed = parse(render(F.col("role"), body))
        return (F.size(parsed) == 1) & (parsed[0]["role"] == F.col("role")) & (parsed[0]["text"] == text)

    ends = escape(text, _ENDS)
    body = F.when(~text.rlike(_CONTROL) | identical(text), text).when(identical(ends), ends).otherwise(escape(text))
    turns = clean.withColumn("body", body).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "body"))).alias("turns"))
    rendered = turns.withColumn("formatted", F.array_join(F.transform("turns", lambda t: render(t["role"], t["body"])), ""))
    head = lambda t: F.length(render(t["role"], F.lit(""))) - len(END)
    places = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<learn:boolean,start:long,length:long>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + head(t) + F.length(t["body"]) + len(END)).cast("long").alias("at"),
            F.concat(acc["spans"], F.array(F.struct((t["role"] == learn_role).alias("learn"), (acc["at"] + head(t)).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length")))).alias("spans"),
        ),
        lambda acc: F.transform(F.filter(acc["spans"], lambda s: s["learn"]), lambda s: F.struct(s["start"], s["length"])),
    )
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rendered.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), places.alias("loss_spans"), (parse(F.col("formatted")) == source).alias("intact"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest columns of the formatted texts, taken from the texts and their loss spans alone."""
    turns = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumn("loss", loss).select(
        "conv_id",
        F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "intact",
    )
