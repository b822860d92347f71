"""Work that grows with the rows and not with pairs of rows."""

import numpy as np
import pandas as pd
import pytest

from shapeloom.operators import network, outline
from shapeloom.plans import catalog


def refused(*_, **__):
    raise AssertionError("a row for each pair of near points")


def test_nearest_at_any_distance_meets_places_not_pairs(spark, monkeypatch):
    """Crowds at one place, a far point, a point without a place; equally near nodes give the smallest id."""
    monkeypatch.setattr(network, "within", refused)
    points = spark.createDataFrame([(k, 24.0, 120.0) for k in range(500)] + [(900, -40.0, -75.0), (901, None, 120.0)], "ord long, lat double, lon double")
    nodes = spark.createDataFrame([(k, 24.001, 120.0) for k in range(9, 400)] + [(7, 50.0, 10.0)], "id long, lat double, lon double")
    got = {r.ord: r.node for r in network.nearest_at_any_distance(points, "ord", nodes, 500.0).collect()}
    assert set(got) == {*range(500), 900} and {got[k] for k in range(500)} == {9} and got[900] == 7
    assert network.nearest_at_any_distance(points, "ord", nodes.where("false"), 500.0).collect() == []


def test_placements_meet_places_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(network, "within", refused)
    assert catalog.queries()["k6_j3_placement_grid"](spark, "/root/testdata/sf0.001").count() > 0


def test_arrays_of_nodes_are_never_broadcast(spark):
    """However small the nodes are, nine arrays of each would go through the driver."""
    points = spark.createDataFrame([(k, 24.0, 120.0) for k in range(3)], "ord long, lat double, lon double")
    nodes = spark.range(50).selectExpr("id", "24 + id * 1e-5d as lat", "120d as lon")
    met = network._with_nearest(points, network.by_cell(nodes, 65.0), 65.0)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert [(r.ord, r.m.node) for r in met.collect()] == [(k, 0) for k in range(3)]


def test_errors_of_many_outlines_at_once():
    """Outlines of one to seven points, without a length too: as one after another, in steps of a few rows."""
    rng = np.random.default_rng(3)
    lines = [rng.random((1 + k % 7, 2)) + (24, 120) for k in range(60)] + [np.full((4, 2), 24.0)]
    goals = [np.round(x, 2)[: 1 + k % 5] for k, x in enumerate(lines)]
    scaled = lambda x, o: np.radians(x - o) * 6371008.8 * np.array([1.0, np.cos(np.radians(o[0]))])
    want = []
    for r, t in zip(lines, goals, strict=True):
        a, b = outline.resample(r, 24), outline.resample(t, 24)
        want.append(outline.apart(scaled(a, a[0]), scaled(b, a[0])))
    columns = [pd.Series([x[:, k] for x in rows]) for rows in (lines, goals) for k in (0, 1)]
    assert outline._errors(24)(*columns).to_list() == pytest.approx(want, rel=1e-12, abs=1e-9)


def test_districts_are_made_once(spark):
    """What reads them reads a table, not the making of roads again."""
    from shapeloom.plans.element_queries import districts

    assert getattr(districts(spark, "/root/testdata/sf0.001"), "written_to", None)


def test_only_hubs_are_broadcast(spark):
    from shapeloom.operators import components

    pairs = spark.range(400).selectExpr("id div 2 as u", "id as v")
    near, scratch = components._with_least(pairs, 400)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 2 and near.count() == 400
    components.discard(scratch)


def test_a_pair_that_meets_in_several_buckets_is_given_once():
    import pyarrow as pa

    from shapeloom.llm import jaccard_join as J

    sig, doc = np.array([9, 9], np.uint64).tobytes(), np.array([5, 2], np.int64).tobytes()
    rows = pa.RecordBatch.from_arrays([pa.array([-3, 1, 1, 4], pa.int32()), pa.array([np.array([2], np.int64).tobytes(), sig, sig, sig]), pa.array([np.array([5], np.int64).tobytes(), doc, doc, doc])], names=["bucket", "sig", "doc"])
    assert [b.to_pylist() for b in J._meetings(iter([rows, rows]))] == [[{"doc": 5, "pivot": 2}]]
    assert list(J._meetings(iter([]))) == []


def test_outlines_are_cut_once_for_all_halvings(monkeypatch):
    """One walk over the cuts gives what a walk for each eps gave."""
    from shapeloom.operators import raster

    def plain(points, eps):
        if len(points) < 3:
            return points.tolist()
        line, span = points[-1] - points[0], points[1:-1] - points[0]
        size = float(np.hypot(*line))
        away = np.abs(line[0] * span[:, 1] - line[1] * span[:, 0]) / size if size else np.hypot(*span.T)
        k = int(np.argmax(away))
        return plain(points[: k + 2], eps)[:-1] + plain(points[k + 1 :], eps) if away[k] > eps else [points[0].tolist(), points[-1].tolist()]

    rng = np.random.default_rng(5)
    lines = [np.cumsum(rng.integers(-1, 2, (n, 2)), axis=0).astype(float) for n in (2, 3, 40, 200)] + [np.zeros((5, 2))]
    for line in [*lines, np.vstack([lines[3], lines[3][:1]])]:
        for eps in (0.0, 0.5, 1.0, 3.3):
            assert raster.simplify(line, eps).tolist() == plain(line, eps)
    walks, real = [], np.argmax
    monkeypatch.setattr(raster.np, "argmax", lambda x: walks.append(1) or real(x))
    assert abs(len(raster.to_points(lines[3], 40)) - 40) <= 10 and len(walks) < len(lines[3])
