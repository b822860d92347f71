"""The digests of queries without SQL, against plain versions on a small fixture with every kind of odd row."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from shapeloom.llm import decontaminate, fingerprint, language_id, lm_score, packing, queries, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LANGS = {"xx": "ka lo mi ner sta".split(), "yy": "bru gol fen ty wop".split(), "zz": "éa ñu ôi çe ße".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(id, text, lang): prose in three languages, copies, edits, a text of 20,000 words, null, empty, ties and repeats."""
    rng, made = random.Random(12), []
    for i in range(120):
        lang = rng.choice(list(LANGS))
        made.append((i, prose(rng, lang, rng.choice([3, 10, 40, 150])), lang))
    copied = [(200 + k, made[k][1], made[k][2]) for k in range(0, 40, 4)]
    edited = [(300 + k, made[k][1] + " " + prose(rng, made[k][2], 4), made[k][2]) for k in range(0, 40, 5)]
    long = (400, prose(rng, "xx", 20_000), "xx")
    odd = [(500, None, "xx"), (501, "", "yy"), (502, "  \n\t ", None), (503, "123 !!", "zz"), (504, "日本 ü", None), (7, made[7][1], made[7][2])]
    return made + copied + edited + [long] + odd


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    frame = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)
    frame.repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


def collected(rows):
    """Rows by id; repeated ids give lists of equal length."""
    out = defaultdict(list)
    for r in rows:
        out[r.doc_id].append(r)
    return out


def shingles(text, n):
    w = text.split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_op2_edits_and_likeness(spark, rows, folder):
    got = collected(queries.op2_fingerprint(spark, folder).collect())
    line = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (-r[0], r[1]))
    assert sum(map(len, got.values())) == len(rows)
    apart, prints = [], {}
    for k, (i, text) in enumerate(line):
        after = line[(k + 1) % len(line)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        own = [r for r in got[i] if r.n_chars == len(text)]
        digests = {r.edited_sha256 for r in own}
        assert hashlib.sha256(edited.encode()).hexdigest() in digests
        if len(own) == 1:
            r = own[0]
            for near, other in ((r.near_edited, edited), (r.near_next, after)):
                a, b = shingles(text, 5), shingles(other, 5)
                true = 1.0 if a == b else len(a & b) / len(a | b)
                apart.append(abs(near - true))
                assert 0 <= near <= 1
            assert (r.fingerprint == r.edited_fingerprint) or shingles(text, 5) != shingles(edited, 5)
            prints.setdefault(text, set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean(apart) < 0.03 and max(apart) < 0.25


def test_fingerprints_are_those_of_a_plain_minhash(spark, rows):
    """Likeness of all pairs of some texts within the error of 256 bins; equal texts alike; no words, no fingerprint."""
    some = [r for r in rows if r[0] < 60 or r[0] >= 200][:100]
    frame = spark.createDataFrame([(i, t) for i, t, _ in some], "doc_id long, text string")
    made = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(frame).collect()}
    bins = lambda f: np.array([x >> s & 255 for x in f for s in range(0, 64, 8)])
    apart = []
    for i, a, _ in some[:40]:
        for j, b, _ in some[40:]:
            x, y = shingles(a or "", 5), shingles(b or "", 5)
            if x and y:
                estimate = ((bins(made[i]) == bins(made[j])).mean() - 1 / 256) / (1 - 1 / 256)
                apart.append(abs(estimate - len(x & y) / len(x | y)))
    assert np.mean(apart) < 0.03


def rank_order(counts, size):
    return {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])}


def grams(text):
    """Letter n-grams by the plain rule, as tuples of code points with 0 for a gap."""
    low = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text or ""]
    if not any(low):
        return Counter()
    line = [0]
    for c in low + [0]:
        if c or line[-1]:
            line.append(c)
    code = lambda g: sum(c << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    found = Counter(code((c,)) for c in line if c)
    for n in (2, 3):
        found.update(code(tuple(line[k : k + n])) for k in range(len(line) - n + 1))
    return found


def test_op5_against_plain_profiles(spark, rows, folder):
    got = collected(queries.op5_language_id(spark, folder).collect())
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    total = defaultdict(Counter)
    for i, text, lang in rows:
        if not out(i) and lang and text is not None:
            total[lang].update(grams(text))
    profiles = {lang: rank_order(c, language_id.PROFILE) for lang, c in total.items()}
    right = 0
    for i, text, lang in rows:
        found = rank_order(grams(text), language_id.PROFILE)
        size = language_id.PROFILE
        far = {x: sum(abs(p[g] - k) if g in p else size for g, k in found.items()) for x, p in profiles.items()}
        best = min(sorted(far), key=far.get) if found else "und"
        for r in got[i]:
            assert (r.held_out, r.lang_pred) == (out(i), best), (i, text)
            assert math.isclose(r.score, 1 - far[best] / (size * len(found)) if found else 0.0, abs_tol=1e-9)
        right += best == lang
    assert right >= 0.95 * sum(lang is not None and bool(grams(t)) for _, t, lang in rows)


def test_op6_pieces_and_places(spark, rows, folder):
    got = queries.op6_packing(spark, folder).collect()
    plain = Tokenizer.from_file(queries.TOKENIZER)
    want = []
    for i, text, _ in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 2048
    bound = packing.lower_bound(np.array([r.length for r in got]), 2048)
    assert bound <= len(sequences) <= bound + 1


def test_op10_counts_and_base(spark, rows, folder):
    got = collected(queries.op10_lm_score(spark, folder).collect())
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*(t or "").translate(lower).split(), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [tokens(t) for i, t, _ in rows if not held(i)]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    gain = []
    for i, text, _ in rows:
        own = tokens(text)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(w in c for w in own), n)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
        gain.append((got[i][0].score - base) * (not held(i)))
    assert sum(gain) > 0


def test_op10_score_against_a_plain_model(spark, rows, folder):
    """Deleted interpolation by hand, with exact ratios where the operator has cells of an eighth of an octave."""
    got = collected(queries.op10_lm_score(spark, folder).collect())
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [*(t or "").translate(lower).split(), "</s>"]
    train = [tokens(t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip(["</s>", *t], t))
    n, v = sum(one.values()), len(one)
    bucket = lambda c: min(math.frexp(c)[1], lm_score.BUCKETS - 1)
    weights = {b: [0.4, 0.4, 0.2] if b else [0.0, 0.7, 0.3] for b in range(lm_score.BUCKETS)}
    seen = [(bucket(one[u] - 1), (k - 1) / max(one[u] - 1, 1), (one[w] - 1) / (n - 1), k) for (u, w), k in two.items()]
    for _ in range(60):
        total = {b: [x * 1e-3 for x in weights[b]] for b in weights}
        for b, p2, p1, k in seen:
            parts = [x * y for x, y in zip(weights[b], (p2, p1, 1 / (v + 1)))]
            for j in range(3):
                total[b][j] += k * parts[j] / sum(parts)
        weights = {b: [x / sum(t) for x in t] for b, t in total.items()}
    for i, text, _ in rows:
        own, score = tokens(text), 0.0
        for u, w in zip(["</s>", *own], own):
            a, b, c = weights[bucket(one[u])]
            low = b * one[w] / n + c / (v + 1)
            score += math.log10(a * two[u, w] / one[u] + low if one[u] else low / (b + c))
        for r in got[i]:
            assert math.isclose(r.score, score, rel_tol=0.02), (i, r.score, score)
    # the probabilities of all words after a context, and of an unseen one, add up to one
    for u in list(one)[:20]:
        a, b, c = weights[bucket(one[u])]
        assert math.isclose(sum(a * two[u, w] / one[u] + b * one[w] / n + c / (v + 1) for w in one) + c / (v + 1), 1.0)


BENCH = [("i1", " ".join(f"q{k}" for k in range(14))), ("i2", "only four words here"), ("i3", ""), ("i4", None), ("i5", " ".join(["same"] * 12)), (None, "Short ITEM of five words")]


def plain_hits(text, window=10):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low)) if w]
    words, hit, items = split(text), set(), set()
    for item, body in BENCH:
        own = split(body)
        for s in range(max(1, len(own) - window + 1)) if own else ():
            part = own[s : s + window]
            for p in range(len(words) - len(part) + 1):
                if words[p : p + len(part)] == part:
                    hit |= set(range(p, p + len(part)))
                    items.add(item or "")
    return len(words), sorted(hit), sorted(items)


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_op8_broadcast_and_shuffled_against_plain(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast_rows)
    rng, texts = random.Random(8), [None, "", "...", BENCH[0][1], "x " + BENCH[0][1].upper() + " y", " ".join(["same"] * 40), "a short item OF five words, only four words here"]
    for _ in range(60):
        words = [f"q{rng.randrange(16)}" for _ in range(rng.randrange(30))]
        at = rng.randrange(len(words) + 1)
        texts.append(" ".join(words[:at] + BENCH[rng.choice([0, 1, 4, 5])][1].split()[rng.randrange(3) :] + words[at:]))
    texts.append("filler " * 20_000 + BENCH[0][1])
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[3]), (4, "q1 q2"), (5, texts[3])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, item string, w int")
    bench = spark.createDataFrame([(*b, 1) for b in BENCH + BENCH[:2]], "item_id string, text string, doc_id int")
    got = decontaminate.find_items(docs, bench).collect()
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, tuple(r.hits), tuple(r.items)) for r in got)
    want = set()
    for i, t in rows:
        n, hits, items = plain_hits(t)
        want.add((i is None, i or 0, n, len(hits), tuple(hits), tuple(items)))
    assert found == sorted(want)
    assert decontaminate.find_items(docs.where("false"), bench).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.find_items(docs, bench.where("false")).collect())


def test_op4_against_plain(spark):
    rng = random.Random(9)
    shared = [[f"s{rng.randrange(50)}" for _ in range(n)] for n in (9, 10, 25, 60)]
    texts = []
    for _ in range(80):
        parts = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(12))], rng.choice(shared)[rng.randrange(2) :], [f"w{rng.randrange(400)}" for _ in range(rng.randrange(12))], rng.choice(shared)]
        texts.append(" ".join(w for p in parts for w in p))
    rows = list(enumerate(texts)) + [(90, None), (91, ""), (None, texts[0]), (92, " ".join(f"u{k}" for k in range(20_000))), (93, texts[5]), (93, texts[5])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, chunk int").repartition(4)
    got = collected(substring_dedup.remove_repeats(docs, 10).collect())
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for p in range(len(w) - 9) if i is not None else ():
            key = tuple(w[p : p + 10])
            first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w, gone = (t or "").split(), set()
        for p in range(len(w) - 9) if i is not None else ():
            if first[tuple(w[p : p + 10])] < i:
                gone |= set(range(p, p + 10))
        for r in got[i]:
            assert (r.n_words, r.n_removed, r.kept_text) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
            assert sum(s["end"] - s["start"] for s in r.removed) == len(gone)
