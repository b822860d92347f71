"""The queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from shapeloom.llm import chat_format, decontaminate, fingerprint, hard_negatives, jaccard_join, language_id, lm_score, packing, pii, quality, sentencepiece_codec, substring_dedup, vector_codes

#: The tokenizer's file, and the key of the pseudonyms, which an owner of real data replaces by a secret.
TOKENIZER, PII_KEY = public_tokenizers.path("byte_bpe_50k.json"), b"shapeloom example key"
#: The SentencePiece model's file.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(extra)))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.compare_with_edits(_table(spark, sf_dir, "documents"))
    own, edited, following = (F.col(c) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.as_text(own).alias("fingerprint"), fingerprint.as_text(edited).alias("edited_fingerprint"),
        fingerprint.likeness(own, edited).alias("near_edited"), fingerprint.likeness(own, following).alias("near_next"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), 50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"), 5, 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER, 2048)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY)
    return found.select("doc_id", "text", F.size("found").cast("long").alias("n_found"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), 3, 90, 100)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(_table(spark, sf_dir, "documents"), 7, 2)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    changed = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=changed)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_codec.round_trip(_table(spark, sf_dir, "documents"), PIECES)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_fingerprint, op3_quality, op4_substring_dedup, op5_language_id, op6_packing, op7_pii, op8_decontaminate, op9_jaccard_join, op10_lm_score, op11_hard_negatives,
        op12_sentencepiece, op13_vector_codes,
    )
}
