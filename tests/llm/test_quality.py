import random

import numpy as np
import pyarrow as pa

from shapeloom.llm import kernels, quality

SCHEMA = "doc_id long, text string, toxic int, keep string"
SYLLABLES = ["ka", "lo", "mi", "ner", "sta", "ren", "tu", "vel", "dor", "ish"]


def corpus(rng, n):
    """(id, text, toxic, bad): prose of made-up words, some with listed insults or with insults of its own language, some junk."""
    rows = []
    for i in range(n):
        words = [("the " if rng.random() < 0.2 else "") + "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(40, 200))]
        toxic, bad = 0, 0
        if i % 9 == 0:
            toxic = 1
            for _ in range(4):
                mark = rng.choice(["idiot", "stupid", "scum"]) if i % 2 else "qwurg" + rng.choice(SYLLABLES)
                words[rng.randrange(len(words))] = mark
        text = ". ".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12)) + "."
        if i % 10 == 4:
            bad, text = 1, rng.choice([" ".join(["SPAM"] * 120), " ".join(w.upper() + "%%%" for w in words), "| " * 300, "buy now " * 80, " ".join(rng.sample(words, 12) * 9).upper()])
        rows.append((i, text, toxic if not bad else 0, bad))
    return rows


def test_held_out_recall_of_toxic_and_of_bad_texts(spark):
    rows = corpus(random.Random(2), 1500)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t, _, _ in rows], SCHEMA).repartition(4)
    labels = spark.createDataFrame([(i, x) for i, _, x, _ in rows if i % 7], "doc_id long, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [r for r in rows if r[0] % 7 == 0]
    share = lambda found, of: sum(found) / max(1, sum(of))
    assert len(got) == 1500
    assert share([got[i].toxic for i, _, x, _ in held if x], [x for _, _, x, _ in held]) >= 0.95
    assert share([not got[i].keep for i, _, _, b in held if b], [b for *_, b in held]) >= 0.95
    clean = [i for i, _, x, b in held if not x and not b]
    assert sum(got[i].keep for i in clean) / len(clean) >= 0.97
    # without labels only listed insults are found
    plain = {r.doc_id: r.toxic for r in quality.classify(docs).collect()}
    assert all(plain[i] for i, _, x, b in rows if x and not b and i % 2) and not any(plain[i] for i in clean)


def test_labellers():
    texts = ["you st00pid 1di0t", "sooo stuuupid", "a1b2c3 nothing here", "stupid", "", None, "Klass 100%"]
    none = [np.zeros(0, np.uint64)] * 2
    votes = quality.toxic_votes(pa.array(texts), none)
    assert votes[:, 3].tolist() == [2, 2, 1, 1, 1, 1, 1] and votes[:, 0].tolist() == [1, 1, 1, 2, 1, 1, 1] and not votes[:, 1:3].any()
    known = kernels.word_hashes(*kernels.text_bytes(pa.array(["here"])))[0]
    assert quality.toxic_votes(pa.array(texts), [np.sort(known), none[1]])[:, 1].tolist() == [1, 1, 2, 1, 1, 1, 1]
    assert quality.quality_votes(b"") == [2, 0, 0, 0, 0, 0, 0]


def test_expectation_maximisation_finds_the_accuracies():
    """Three labellers of known accuracy on 20,000 texts, a fifth of them bad."""
    rng = np.random.default_rng(4)
    bad = rng.random(20_000) < 0.2
    right = np.array([0.95, 0.8, 0.65])
    votes = np.where(rng.random((20_000, 3)) < right, bad[:, None], ~bad[:, None]).astype(int) + 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    chance, table = quality.posteriors(patterns, counts.astype(float), 0.1)
    assert np.abs(table[1, :, 2] - right).max() < 0.05 and np.abs((chance * counts).sum() / 20_000 - 0.2) < 0.03


def test_odd_rows(spark):
    long = "word " * 20_000 + "idiot"
    rows = [(1, None), (2, ""), (3, "the cat sat"), (3, "the cat sat"), (None, "the cat sat"), (4, long), (3, "another text")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(3, 0), (3, 0), (None, 1), (4, None), (99, 1)], "doc_id long, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 7 and got[0].__fields__ == ["doc_id", "quality", "quality_posterior", "toxicity", "toxic_posterior", "toxic", "keep"]
    assert all(0 <= r[c] <= 1 for r in got for c in ("quality", "quality_posterior", "toxicity", "toxic_posterior"))
    alike = {tuple(r)[1:] for r in got if r.doc_id is None} | {tuple(r)[1:] for r in got if r.doc_id == 3}
    assert len(alike) <= 2 and next(r for r in got if r.doc_id == 4).toxic
    assert quality.classify(docs.where("false"), labels).collect() == [] == quality.classify(docs.where("false")).collect()
    assert len(quality.classify(docs, labels.where("false")).collect()) == 7
