"""A training-data pipeline over ``documents``: language, near duplicates, benchmark passages, personal data, packing.

Every stage takes and, but for the last, returns the columns of documents. Rows without an id, with null or empty texts
and repeated rows are let through or dropped as each stage's docstring says; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm.common import discard, written
from shapeloom.llm.decontaminate import find_items
from shapeloom.llm.jaccard_join import jaccard_components
from shapeloom.llm.language_id import identify
from shapeloom.llm.packing import pack
from shapeloom.llm.pii import pseudonymise
from shapeloom.llm.queries import PII_KEY, TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learnt language, with the predicted language as ``lang``.

    Rejected are texts that are null or without a letter, and texts that share no n-gram with any profile (score 0).
    The decision stays with its row: rows without an id and repeated rows are judged like all others.
    """
    found = identify(docs, keep=("text", "source", "n_chars")).where("lang_pred <> 'und' and score > 0")
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, a similarity of 0.8): the one with the smallest id.

    Rows that repeat an id are one document, of which the row with the smallest text (then language, source) stays; a
    null text comes first. Rows without an id are linked with nothing and all stay, and so do documents without words.
    """
    first = jaccard_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    rest = [c for c in COLUMNS if c != "doc_id"]
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
    return kept.select("doc_id", "row.*").select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    A document is judged by its id and text together, a null id included, so repeated rows go or stay together. Null
    and empty texts hold nothing and stay. An empty benchmark keeps all.
    """
    hit = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0")
    hit = hit.select(F.col("doc_id").alias("hit_id"), F.col("of").alias("hit_of"))
    text = F.coalesce(F.col("text"), F.lit(""))
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64(text) == F.col("hit_of"))
    return docs.join(hit, same, "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data. Null ids, null texts and repeated rows stay as they are."""
    clean = pseudonymise(docs, PII_KEY, keep=("lang", "source"))
    return clean.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens: one row for each piece. A null or empty text is one token; repeated rows are all packed."""
    return pack(docs, TOKENIZER)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("packing", packing)]
#: SQL can express neither the profiles nor the tokens; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            before, docs = docs, written(kept, name)
            # the given table was not written here, and stays
            discard(before)
    return kept
