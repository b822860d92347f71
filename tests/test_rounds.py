"""Rounds of searches: what a round can lead to is measured at once, and comes out as one after another."""

import random

from pyspark.sql import functions as F

from shapeloom.operators import network, planner, search

KINDS = "job string, key string, shape string, clat double, clon double, size_m double, rot double, score double"


def quality(lat, lon, size, rot):
    return 1.0 - abs(lat - 24.1032) * 40 - abs(lon - 120.6011) * 30 - abs(size - 1234.0) / 5000 - abs(rot - 13.0) / 300


def climbed(lat, lon, size, rot, rounds, step_m=260.0, step_r=6.0, step_s=0.10):
    """Move by move; a degree counts 100 km both ways, as the test's enu_inverse has it."""
    at = [lat, lon, size, rot]
    for _ in range(rounds):
        if step_m < 40:
            break
        start, (la, lo) = list(at), at[:2]
        for e, n in ((step_m, 0), (-step_m, 0), (0, step_m), (0, -step_m), (step_m, step_m), (-step_m, -step_m)):
            new = [la + n / 1e5, lo + e / 1e5, *at[2:]]
            at = new if quality(*new) > quality(*at) else at
        for t in (step_r, -step_r):
            new = [*at[:3], start[3] + t]
            at = new if at[3] == start[3] and quality(*new) > quality(*at) else at
        for f in (1 + step_s, 1 - step_s):
            new = [*at[:2], at[2] * f, at[3]]
            at = new if quality(*new) > quality(*at) else at
        if at == start:
            step_m, step_r, step_s = step_m * 0.55, step_r * 0.6, step_s * 0.6
    return at


def test_a_round_of_climbing_is_measured_at_once(spark, monkeypatch):
    calls = []

    def scored(tried, shapes, net):
        calls.append(1)
        made = F.lit(1.0) - F.abs(F.col("clat") - 24.1032) * 40 - F.abs(F.col("clon") - 120.6011) * 30 - F.abs(F.col("size_m") - 1234.0) / 5000 - F.abs(F.col("rot") - 13.0) / 300
        return tried.select("key", "shape", "clat", "clon", "size_m", "rot", made.alias("score"), "job", "move")

    monkeypatch.setattr(planner, "_scored", scored)
    monkeypatch.setattr(planner, "enu_inverse", lambda lat, lon, x, y: (F.col(lat) + y / 1e5, F.col(lon) + x / 1e5))
    rng = random.Random(2)
    starts = {str(k): (24.1 + rng.uniform(0, 0.01), 120.6 + rng.uniform(0, 0.01), rng.uniform(800, 2000), rng.uniform(-30, 30)) for k in range(6)}
    best = spark.createDataFrame([(k, "x", "m", *v, quality(*v)) for k, v in starts.items()], KINDS)
    got = {r.job: (r.clat, r.clon, r.size_m, r.rot) for r in planner.climb(best, None, None, 3).collect()}
    assert len(calls) == 3
    for k, v in starts.items():
        assert all(abs(x - y) < 1e-6 for x, y in zip(got[k], climbed(*v, 3), strict=True)), k


def test_halvings_are_measured_together(spark):
    calls = []

    def measure(sizes):
        calls.append(1)
        # sizes above 40 cannot be built
        return sizes.withColumn("km", F.when(F.col("size") <= 40, F.col("size") * F.when(F.col("key") == "a", 0.7).otherwise(1.3)))

    def plain(slope, goal, lo, hi, size, rounds):
        off = 1e9
        for _ in range(rounds):
            mid = (lo + hi) / 2
            km = mid * slope if mid <= 40 else None
            if km is not None and abs(km - goal) < off:
                size, off = mid, abs(km - goal)
            lo, hi = (mid, hi) if km is None or km < goal else (lo, mid)
        return size

    goals = [("a", "lo", 5.0, 1.0, 30.0, 9.0), ("a", "hi", 12.0, 1.0, 30.0, 9.0), ("b", "lo", 5.0, 1.0, 30.0, 9.0), ("b", "hi", 70.0, 50.0, 90.0, 60.0)]
    got = {(r.key, r.side): r.size for r in search.bisect(spark.createDataFrame(goals, "key string, side string, goal double, lo double, hi double, start double"), measure, 10).collect()}
    assert got == {(k, s): plain(0.7 if k == "a" else 1.3, *rest, 10) for k, s, *rest in goals}
    assert len(calls) == 3


def test_a_band_of_cells_is_worked_out_once():
    """Nine cells with the number of columns of each were too much code to be compiled."""
    assert str(network.cells_around(F.col("lat"), F.col("lon"), 100.0)).lower().count("asin") <= 2


def test_roads_are_measured_once_and_tags_read_once_a_way(spark):
    """One pass through Python; what is grouped by way are values, not tags."""
    from shapeloom.plans import element_queries as E
    from shapeloom.sources import elements

    plan = elements.roads(E.map_elements(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    assert sum("ArrowEvalPython" in line for line in lines) == 1
    assert not any("first(tags" in line for line in lines)


def test_sums_without_points_group_numbers_only(spark):
    rows = [("r", 0, 1, 2, 1.0, 2.0, 1, 2, 10.0, 0.5), ("r", 1, 2, 1, 1.0, 2.0, 1, 2, 10.0, 0.5), ("r", 2, 1, None, 1.0, 2.0, -1, 1, None, None)]
    walked = spark.createDataFrame(rows, "key string, i int, node long, next long, lat double, lon double, u long, v long, length double, safety double")
    whole, slim = planner.sums(walked).first(), planner.sums(walked, with_points=False)
    got = slim.first()
    assert (got.length_m, got.safety, got.retrace, got.n) == (whole.length_m, whole.safety, whole.retrace, len(whole.points)) == (20.0, 0.5, 0.5, 3)
    assert "collect_list" not in slim._jdf.queryExecution().executedPlan().toString()


def test_more_rows_go_to_more_tasks(spark, monkeypatch):
    from shapeloom.operators import staging
    from shapeloom.plans import catalog

    monkeypatch.setattr(staging, "ROWS", 500)
    found = catalog.queries()["a7_dead_end_visits"](spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert staging.tasks_for(spark, rows) == -(-rows // 500) > 4
    assert found.rdd.getNumPartitions() == -(-rows // 500)
    assert sum(r.visits for r in found.collect()) <= rows


def test_the_query_of_whole_plans_takes_all_rounds(spark, monkeypatch):
    """What the query hands to plan() leaves its rounds as they are: nine of climbing, sixteen halvings of the fit."""
    import inspect

    from shapeloom.plans import plan_queries

    real, asked = inspect.signature(plan_queries.plan.plan), []

    def seen(*given, **named):
        bound = real.bind(*given, **named)
        bound.apply_defaults()
        asked.append((bound.arguments["climb_rounds"], bound.arguments["fit_rounds"]))
        return spark.range(0).selectExpr("string(id) as job", "*", *(f"id as {c}" for c in ("error", "rank", "total", *plan_queries.S.WEIGHTS, "km", "fitted", "clat", "clon", "size_m", "rot", "fidelity", "n_nodes")))

    monkeypatch.setattr(plan_queries, "network", lambda *_: None)
    monkeypatch.setattr(plan_queries.plan, "plan", seen)
    plan_queries.g12_g13_g9_plan_best(spark, "/root/testdata/sf0.001")
    assert asked == [(9, 16)]
