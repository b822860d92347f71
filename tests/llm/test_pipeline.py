import random

from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def shingles(text, n=5):
    w = text.split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    """A copy at a similarity of 0.82 goes, one at 0.78 stays, whether words are appended or changed."""

    def base(name):
        return [f"{name}{k}" for k in range(104)]

    changed = {k: [f"new{x}" if x in range(10, 10 + 20 * k, 20) else w for x, w in enumerate(base("c"))] for k in (2, 3)}
    texts = [base("a"), base("a") + [f"x{k}" for k in range(22)], base("b"), base("b") + [f"y{k}" for k in range(28)], base("c"), changed[2], changed[3]]
    texts = [" ".join(t) for t in texts]

    def likeness(i, j):
        a, b = shingles(texts[i]), shingles(texts[j])
        return len(a & b) / len(a | b)

    assert [round(likeness(*p), 2) for p in ((0, 1), (2, 3), (4, 5), (4, 6), (5, 6))] == [0.82, 0.78, 0.82, 0.74, 0.9]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, enumerate(texts[:6])), "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3, 4]


def kept(stage, spark, rows, folder=""):
    return sorted(stage(spark, documents(spark, rows), folder).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))


ODD = [(None, None), (None, "the cat sat on the mat"), (1, None), (2, ""), (3, "..."), (4, "the cat sat on the mat"), (4, "the cat sat on the mat"), (5, "the dog ran " * 20_000)]


def test_language_rejects_texts_without_letters_and_strange_scripts(spark):
    rows = ODD + [(k, "the cat and the dog ran to the house " * 3) for k in range(10, 30)] + [(40, "日本語の文")]
    docs = documents(spark, rows)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 11, "zz").when(F.col("doc_id") < 11, None).when(F.col("doc_id") != 40, F.col("lang")))
    got = corpus_pipeline.language(spark, docs, "").collect()
    assert got[0].__fields__ == corpus_pipeline.COLUMNS
    assert sorted((r.doc_id or 0) for r in got) == sorted([0, 4, 4, 5, *range(10, 30)])
    assert {r.lang for r in got} <= {"en", "zz"} and corpus_pipeline.language(spark, docs.where("false"), "").collect() == []


def test_near_duplicates_keeps_one_row_of_each_group(spark):
    got = kept(corpus_pipeline.near_duplicates, spark, [*ODD, (6, "the dog ran " * 20_000), (7, "other words of its own here"), (7, "a text of the same id here")])
    assert [(r.doc_id, (r.text or "")[:8]) for r in got] == [(1, ""), (2, ""), (3, "..."), (4, "the cat "), (5, "the dog "), (7, "a text o"), (None, ""), (None, "the cat ")]
    assert kept(corpus_pipeline.near_duplicates, spark, []) == []


def test_benchmark_drops_contaminated_rows_only(spark, tmp_path):
    spark.createDataFrame([("a", " ".join(f"q{k}" for k in range(12))), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    passage = "so " + " ".join(f"Q{k}" for k in range(10))
    got = kept(corpus_pipeline.benchmark, spark, [*ODD, (8, passage), (8, "clean text"), (None, passage), (9, " ".join(f"q{k}" for k in range(9)))], str(tmp_path))
    assert [(r.doc_id, (r.text or "")[:6]) for r in got] == [(1, ""), (2, ""), (3, "..."), (4, "the ca"), (4, "the ca"), (5, "the do"), (8, "clean "), (9, "q0 q1 "), (None, ""), (None, "the ca")]


def test_personal_data_keeps_every_row(spark):
    got = kept(corpus_pipeline.personal_data, spark, [*ODD, (8, "write to a.b@example.org")])
    assert len(got) == len(ODD) + 1 and [r.text for r in got if r.doc_id == 4] == ["the cat sat on the mat"] * 2
    own = next(r for r in got if r.doc_id == 8)
    assert own.text.startswith("write to ") and "a.b@" not in own.text and own.n_chars == len(own.text)
    assert next(r for r in got if r.doc_id == 1).n_chars is None


def test_packing_packs_every_row(spark):
    got = kept(lambda s, d, f: corpus_pipeline.packing(s, d, f).withColumn("text", F.lit("")), spark, ODD)
    assert len([r for r in got if r.piece == 0]) == len(ODD) and [r.length for r in got if r.doc_id in (1, 2)] == [1, 1]


def test_the_whole_pipeline(spark, tmp_path):
    """All stages one after another: each planted row is dropped by the stage that it was planted for."""
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice(["the", "cat", "dog", "house", "ran", "sat", "over", "under", "green", "tree"]) + rng.choice(["", "s", "ed"]) for _ in range(60))
    clean = {k: prose() for k in range(40)}
    passage = " ".join(f"item{k}" for k in range(15))
    rows = [*clean.items(), (50, None), (51, "12 34"), (52, clean[3] + " end"), (53, clean[5] + " " + passage), (54, clean[7].replace("the", "a") + " write to jo@example.org " + prose())]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {*clean, 54} and sum(r.length for r in got) > 60 * 41
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "personal_data", "packing"]
