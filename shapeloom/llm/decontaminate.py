"""Benchmark decontamination by a prefix-filtered set join: DataFrame functions only.

An item's windows of ten words must occur in a document whole. The tokens of a window are its words, ordered by
rarity in the documents; as all of them must occur, a prefix of one token, the rarest, is necessary. Documents meet
items on these tokens alone. A meeting fixes the place of the window in the document, so length and position
bound it at once: the equal words to the left and right must make up a window. They are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeloom.llm.common import words_column, written

#: What parts words: all of ASCII but letters and digits.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a table of item tokens up to which it is broadcast; beyond, documents' tokens are shuffled to it.
BROADCAST_ROWS = 100_000


def exact_lower(word):
    """A-Z lower-cased, and nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The words of each document that lie in an occurrence of an item's window.

    A window is ``window`` consecutive item words; an item of fewer words, but not none, is one window. Returns one
    row for each document: doc_id, of (xxhash64 of its text, a null text being empty), n_words, n_hit, hits (word
    positions in order), items (ids as strings, in order).
    A null text or one without words has none; a null item text is no window; a null item id reads ''. Repeated items
    count once by id. Rows that repeat both id and text are one document; a null id is an id. Other columns are not
    read. An empty benchmark hits nothing; no documents give no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_column(F.col(item_text_col).cast("string"), GAPS).alias("iw")).where(F.size("iw") > 0)
    items = items.select("item", F.transform("iw", exact_lower).alias("iw")).distinct()
    # lower() folds more letters than A-Z; what meets by it is compared exactly below
    item_words = items.select("item", "iw", F.posexplode("iw").alias("ip", "w")).select("item", "iw", "ip", F.xxhash64(F.lower("w")).alias("t"))
    split = docs.select("doc_id", F.xxhash64("text").alias("of"), F.split("text", GAPS).alias("ws"))
    token = F.xxhash64(F.lower("w"))
    vocabulary = written(item_words.select("t").distinct(), "vocabulary")
    known = F.broadcast(vocabulary) if _small(vocabulary) else vocabulary
    rarity = split.select(F.explode("ws").alias("w")).select(token.alias("t")).join(known, "t", "left_semi").groupBy("t").agg(F.count("*").alias("n"))
    # each window's rarest word, leftmost first; one that no document holds rules the window out
    ranked = item_words.join(rarity, "t", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lined = ranked.groupBy("item", "iw").agg(F.sort_array(F.collect_list(F.struct("ip", "n", "t"))).alias("line"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("iw") - window, F.lit(0)))
    rarest = F.transform(starts, lambda s: F.array_min(F.transform(F.slice("line", s + 1, F.lit(window)), lambda x: F.struct(x["n"].alias("n"), x["ip"].alias("ip"), x["t"].alias("t")))))
    prefix = lined.select("item", "iw", F.explode(F.array_distinct(rarest)).alias("r")).where("r.n > 0")
    left, right = F.greatest(F.col("r.ip") - window + 1, F.lit(0)), F.least(F.col("r.ip") + window, F.size("iw"))
    tokens = prefix.select(F.col("r.t").alias("t"), "item", F.least(F.size("iw"), F.lit(window)).alias("need"), (F.col("r.ip") - left).alias("before"), F.slice("iw", left + 1, right - left).alias("iw"))
    tokens = written(tokens, "tokens")

    # positions from 1; position 0 stands for the document itself. A text that begins with a gap has '' as first word
    shift = F.when(F.get("ws", F.lit(0)) == "", 1).otherwise(0)
    words = F.size("ws") - shift - F.when((F.size("ws") > 1) & (F.element_at("ws", -1) == ""), 1).otherwise(0)
    # the sequence refers to the text's hash, or it would be taken again for each word
    zero = F.col("of").bitwiseAND(F.lit(0).cast("long")).cast("int")
    numbered = split.select("doc_id", "of", "ws", F.explode(F.sequence(zero, F.size("ws"))).alias("p"))
    around = F.slice("ws", F.greatest(F.col("p") - window + 1, F.lit(1)), F.col("p") + window - F.greatest(F.col("p") - window + 1, F.lit(1)))
    word = F.get("ws", F.col("p") - 1)
    probe = numbered.select("doc_id", "of", "ws", "p", F.when((F.col("p") > 0) & (word != ""), F.xxhash64(F.lower(word))).alias("pt"))
    if _small(tokens):
        met = probe.join(F.broadcast(tokens), F.col("pt") == F.col("t"), "left")
    else:
        # only keys travel; a document's words come back to its meetings
        keys = probe.select("doc_id", "of", "p", "pt").where("pt is not null").join(tokens, F.col("pt") == F.col("t"))
        keys = keys.unionByName(probe.where("p = 0").select("doc_id", "of", "p", "pt"), allowMissingColumns=True)
        texts = split.select(F.col("doc_id").alias("d"), F.col("of").alias("o"), "ws").dropDuplicates(["d", "o"])
        met = keys.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("of") == F.col("o")))
    met = met.where("t is not null or p = 0").select(
        "doc_id", "of", (F.col("p") - 1 - shift).alias("p"), F.when(F.col("p") == 0, words.cast("long")).alias("n"), "item", "need", "before", "iw",
        F.when(F.col("p") > 0, F.transform(around, exact_lower)).alias("around"), F.least(F.col("p") - 1, F.lit(window - 1)).alias("at"),
    )
    # the run of equal words about the meeting
    equal = met.withColumn("e", F.transform("iw", lambda w, k: F.coalesce((F.col("at") - F.col("before") + k >= 0) & (F.get("around", F.col("at") - F.col("before") + k) == w), F.lit(False))))
    wrong = lambda side: F.filter(F.transform("e", lambda e, k: F.when(~e & side(k), k)), lambda k: k.isNotNull())
    low = F.coalesce(F.array_max(wrong(lambda k: k < F.col("before"))), F.lit(-1)) + 1
    high = F.coalesce(F.array_min(wrong(lambda k: k >= F.col("before"))), F.size("e")) - 1
    runs = equal.withColumn("low", low).withColumn("high", high)
    good = F.col("n").isNull() & (F.col("high") >= F.col("before")) & (F.col("high") - F.col("low") + 1 >= F.col("need"))
    # no filter here: Spark would move it, with its array functions, to where every word of a document passes
    first = F.col("p") - F.col("before")
    spans = runs.select("doc_id", "of", "n", F.when(good, F.col("item")).alias("item"), F.when(good, F.sequence(first + F.col("low"), first + F.col("high"))).alias("hit"))
    found = spans.groupBy("doc_id", "of").agg(F.max("n").alias("n_words"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hits"), F.sort_array(F.collect_set("item")).alias("items"))
    return found.select("doc_id", "of", "n_words", F.size("hits").cast("long").alias("n_hit"), "hits", "items")
