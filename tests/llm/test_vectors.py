"""Hard negatives and vector codes against brute force, with odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.llm import hard_negatives, queries, vector_codes
from shapeloom.llm.vectors import integer_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, ints int, block string, cell int, code string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    """Embeddings with extra columns of clashing names."""
    return spark.createDataFrame([(i, v, c, 1, "x", 2, "y") for i, v, c in rows], SCHEMA)


def kept(rows):
    return [(i, np.array(v, np.float32).astype(float), c) for i, v, c in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]


def mined(rows, every, positives=5, negatives=3, band=(50, 95)):
    """All products, anchor by anchor."""
    rows = [r for r in kept(rows) if r[0] is not None and r[2] is not None]
    width = max((len(v) for _, v, _ in rows), default=0)
    ints = [(i, [int(np.floor(256 * x)) for x in v] + [0] * (width - len(v)), c) for i, v, c in rows]
    out = []
    for a, va, ca in ints:
        if a % every:
            continue
        score = sorted((-sum(x * y for x, y in zip(va, v)), i, c) for i, v, c in ints)
        for s, p, _ in [x for x in score if x[2] == ca and x[1] != a][:positives]:
            fitting = [(n, t) for t, n, c in score if c != ca and band[0] * -s <= 100 * -t <= band[1] * -s][:negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(fitting)]
    return sorted(out)


def vectors(rng, n, width, spread):
    """Vectors around a few centres, so that leading components matter; many equal ones and equal scores."""
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(3)]
    rows = [(i, [x + rng.gauss(0, spread) for x in centres[i % 3]], rng.choice([0, 0, 1, 2, None])) for i in range(n)]
    same = rows[n // 2][1]
    return [(i, same if i % 4 == 0 else v, c) for i, v, c in rows]


ODD = [(100, None, 1), (101, [], 1), (102, [0.5, None], 1), (103, [NAN, 1.0], 0), (104, [INF, 1.0], 0), (None, [0.3, 0.2], 1), (110, [1.5], 0), (110, [1.5], 0), (5, [0.25, -0.5, 2.0], 0)]


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_hard_negatives_equal_all_products(spark, spread, monkeypatch):
    rows = vectors(random.Random(2), 90, 11, spread) + ODD
    for name, size in (("ANCHORS", 7), ("ROWS", 20), ("AT_ONCE", 6), ("FEW", 0.4)):
        monkeypatch.setattr(hard_negatives, name, size)
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, got)) == mined(rows, 5) and len(got) > 100
    few = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 3 == 0, positives=2, negatives=1, band=(10, 60)).collect()
    assert sorted(map(tuple, few)) == mined(rows, 3, 2, 1, (10, 60))


@pytest.mark.parametrize("places", [1, 1 << 20])
def test_blocks_meet_without_copies_for_each_meeting(spark, places, monkeypatch):
    """No block goes to the driver or is repeated before it meets; however little a task may hold, results are equal."""
    rows = vectors(random.Random(3), 120, 5, 0.5)
    for name, size in (("ANCHORS", 4), ("ROWS", 6), ("HELD", 200), ("PLACES", places)):
        monkeypatch.setattr(hard_negatives, name, size)
    plans, real = [], hard_negatives._meetings
    monkeypatch.setattr(hard_negatives, "_meetings", lambda grid, *a: plans.append(grid._jdf.queryExecution().executedPlan().toString()) or real(grid, *a))
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 3 == 0).collect()
    assert sorted(map(tuple, got)) == mined(rows, 3) and len(got) > 50
    assert len(plans) == 2 and all("CartesianProduct" in p and "Broadcast" not in p and "Generate" not in p for p in plans)


def test_hard_negatives_of_tables_without_any(spark):
    for rows in ([], [(1, None, 1)], [(50, [1.0, 2.0], 1)], [(50, [1.0], 1), (51, [1.0], 1)], [(50, [1.0], 1), (51, [0.7], 0)], [(50, [-1.0], 1), (51, [1.0], 1), (52, [0.5], 0)]):
        assert hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0).collect() == []
    # a positive's score of 0 takes negatives of score 0 only
    rows = [(50, [1.0, 0.0], 1), (51, [0.0, 1.0], 1), (52, [0.0, 3.0], 0), (53, [1.0, 0.0], 0)]
    assert [tuple(r) for r in hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()] == [(50, 51, 1, 52, 0, 0)]


def coded(rows, parts=8, entries=16, rounds=6):
    rows = kept(rows)
    width = -(-max(len(v) for _, v, _ in rows) // parts)
    ints = [[int(np.floor(4096 * x)) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in rows]
    order = sorted((i, v) for (i, _, _), v in zip(rows, ints) if i is not None)[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in order] for p in range(parts)]
    near = lambda v, p: min((sum((x - y) ** 2 for x, y in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            won = [[] for _ in books[p]]
            for v in ints:
                won[near(v, p)[1]].append(cut(v, p))
            new.append([[sum(c) // len(w) for c in zip(*w)] if w else e for w, e in zip(won, books[p])])
        books = new
    found = [[near(v, p) for p in range(parts)] for v in ints]
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, c), e in zip(rows, error):
        total[c] = total.get(c, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i is not None, i or 0), "".join(f"{k:02x}" for _, k in f), e, total[c], digest) for (i, _, c), f, e in zip(rows, found, error))


@pytest.mark.parametrize(("n", "width"), [(70, 16), (9, 8), (40, 13), (1, 3)])
def test_vector_codes_equal_all_distances(spark, n, width):
    rows = vectors(random.Random(3), n, width, 0.6) + (ODD if n > 30 else [])
    got = vector_codes.encode(frame(spark, rows)).collect()
    assert sorted(((r.vec_id is not None, r.vec_id or 0), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == coded(rows)


def test_vector_codes_of_tables_without_any(spark):
    assert vector_codes.encode(frame(spark, [])).collect() == [] == vector_codes.encode(frame(spark, [(1, None, 1), (2, [NAN], 1)])).collect()
    assert {r.code for r in vector_codes.encode(frame(spark, [(1, [], 1), (2, [], None)])).collect()} == {"00" * 8}
    assert len(vector_codes.encode(frame(spark, [(None, [1.0], 1), (None, [2.0], 1)])).collect()) == 2
    with pytest.raises(ValueError, match="256"):
        vector_codes.encode(frame(spark, []), entries=300)


def test_bounds_hold_for_all_entries():
    rng = np.random.default_rng(1)
    for _ in range(20):
        entries, queries_ = rng.integers(-3000, 3000, (16, 6)), rng.integers(-4000, 4000, (50, 6))
        low, high = vector_codes.Cells(entries).bounds(queries_)
        exact = ((queries_[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (low <= exact).all() and (exact <= high).all()
        best, distance = vector_codes.Cells(entries).nearest(queries_)
        assert (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_components_that_are_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="2\\*\\*27"):
        integer_vectors(frame(spark, [(1, [1e30], 1)]), "vec_id", "embedding", 256, {}).collect()


def test_queries_read_whole_tables(spark):
    """The query op11 on the smallest tables, as its contract says."""
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    changed = [(i, v, (c + 1) % 10 if i % 7 == 0 else c) for i, v, c in rows]
    assert sorted(map(tuple, queries.op11_hard_negatives(spark, "/root/testdata/sf0.001").collect())) == mined(changed, 50)
