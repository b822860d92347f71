import random

from shapeloom.llm import jaccard_join


def shingles(text, n=3):
    w = text.split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def templated(n, own, seed, copies=()):
    """Documents of one template with words of their own, and near copies of some of them."""
    rng = random.Random(seed)
    template = [f"t{k}" for k in range(277)]
    texts = [template + [f"o{i}x{k}" for k in range(rng.choice(own))] for i in range(n)]
    texts += [texts[i] + ["more"] for i in copies]
    return [" ".join(t) for t in texts]


def visits(monkeypatch, spark, texts):
    """Components, and the seats of the second round."""
    seen, links = [], jaccard_join._links

    def spy(docs, seats, shingle, num, den, visitors_only):
        if visitors_only:
            seen.append(seats.collect())
        return links(docs, seats, shingle, num, den, visitors_only)

    monkeypatch.setattr(jaccard_join, "_links", spy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 3, 90, 100).collect()}
    return got, seen[0] if seen else []


def plain(texts, n=3, num=90):
    sets, up = [shingles(t, n) for t in texts], list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if sets[j] and a and 100 * both >= num * (len(a) + len(sets[j]) - both):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in range(len(texts))}


def test_templated_documents_do_not_visit_all_blocks(spark, monkeypatch):
    """Similarity of about 0.85 and no link: without a main component nearly all were guests of all blocks."""
    texts = templated(900, [25], 1)
    monkeypatch.setattr(jaccard_join, "CROWDED", 1)
    got, seats = visits(monkeypatch, spark, texts)
    assert got == {i: i for i in range(900)} and sum(not s.home for s in seats) == 0


def test_sub_blocks_find_every_link(spark, monkeypatch):
    """Heavy, light and lonely documents with near copies, in small blocks and sub-blocks, against all pairs."""
    texts = templated(240, [8, 14, 16, 18, 20, 25, 34], 2, copies=range(0, 240, 5))
    for name, value in (("BLOCK", 16), ("GUESTS", 32), ("CROWDED", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    got, seats = visits(monkeypatch, spark, texts)
    assert got == plain(texts) and len(set(got.values())) > 2
    blocks = {}
    for s in seats:
        key = (s.cluster, s.cls, s.blk, s.heavy, s.slot)
        blocks[key] = blocks.get(key, 0) + (not s.home)
    assert max(blocks.values()) <= 4 * 32


def test_unrelated_documents_do_not_meet_and_a_star_is_found(spark, monkeypatch):
    """10,000 unrelated documents of one size, and 5,000 copies that each link with one document and not with each other."""
    rng, met = random.Random(3), []
    word = lambda: f"w{rng.randrange(100_000)}"
    texts = [" ".join(word() for _ in range(60)) for _ in range(10_000)]
    base = [word() for _ in range(60)]
    texts.append(" ".join(base))
    for k in range(5_000):
        at = 6 + k % 48
        texts.append(" ".join([*base[:at], f"own{k}", *base[at + 1 :]]))
    write = jaccard_join.written

    def spy(table, label):
        made = write(table, label)
        if label == "meetings":
            met.append(made.where("doc < 10000 and pivot < 10000").count())
        return made

    monkeypatch.setattr(jaccard_join, "written", spy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {i: min(i, 10_000) for i in range(15_001)} and met[0] < 10


def test_every_link_of_random_sets(spark):
    """Sets of all sizes from the smallest on, at similarities about the bound, against all pairs."""
    rng = random.Random(11)
    texts = []
    for k in range(60):
        words = [f"v{rng.randrange(10_000)}" for _ in range(rng.choice([7, 8, 9, 12, 20, 40, 90, 200]))]
        texts.append(" ".join(words))
        for _ in range(3):
            changed = list(words)
            for _ in range(rng.randrange(1, 2 + len(words) // 30)):
                changed[rng.randrange(len(changed))] = f"c{rng.randrange(10_000)}"
            texts.append(" ".join(changed + [f"t{k}"] * rng.randrange(3)))
    for shingle, num in ((5, 80), (3, 90), (2, 60)):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, shingle, num, 100).collect()}
        assert got == plain(texts, shingle, num), (shingle, num)


def test_documents_of_a_common_passage_do_not_meet(spark, monkeypatch):
    """800 documents that are half a common passage, of which ten have a near copy: only the copies' originals meet."""
    rng, met = random.Random(5), []
    passage = [f"p{k}" for k in range(150)]
    texts = [" ".join([f"o{rng.randrange(10**9)}" for _ in range(150)] + passage) for _ in range(800)]
    texts += [texts[i] + " more" for i in range(0, 800, 80)]
    write = jaccard_join.written

    def spy(table, label):
        made = write(table, label)
        if label == "meetings":
            met.append(made.count())
        return made

    monkeypatch.setattr(jaccard_join, "written", spy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == plain(texts, 5, 80) and len(set(got.values())) == 800 and met[0] < 20


def test_common_tokens_reads_all_documents(spark):
    """Tokens that documents share have their count's digits; others have 0. Nulls, empty texts and no rows do no harm."""
    texts = ["a b c d e"] * 5 + ["f g h i j", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    table = jaccard_join.common_tokens(docs, 5)
    assert len(table) == jaccard_join.ENTRIES and table.sum() == 3 == table.max()
    assert jaccard_join.common_tokens(docs.limit(0), 5).sum() == 0
