"""Safety notes and pictures of small routes."""

import math

import pytest
from pyspark.sql import functions as F

from shapeloom.operators import notes, viewport

WALK = "key string, i int, lat double, lon double, length double, before_m double, hw string, lit string, name string"


def walk(spark, *steps, key="r"):
    """Steps (length, hw, lit, name) northwards."""
    rows, before = [], 0.0
    for i, (length, hw, lit, name) in enumerate(steps):
        rows.append((key, i, 24 + before / 111_195.08, 120.0, length, before, hw, lit, name))
        before += length
    return spark.createDataFrame([*rows, (key, len(steps), 24 + before / 111_195.08, 120.0, None, before, None, None, None)], WALK)


def test_notes_come_in_order_and_are_thinned(spark):
    w = walk(spark, (100.0, "path", "no", ""), (19.0, "path", "no", ""), (50.0, "path", "yes", ""), (130.0, "path", "no", ""), (300.0, "primary", "", "Road"), (199.0, "primary", "", "Road"), (250.0, "secondary", None, ""), (90.0, "path", "no", None), (40.0, "path", "no", None))
    at = lambda metres: 24 + metres / 111_195.08
    crossings = spark.createDataFrame(
        [(1, at(171), 120.0, "Zoo", "zebra"), (2, at(169), 120.0, "", ""), (3, at(600), 120.0, "signalled", "signals"), (4, at(150), 120.0002, "far from a vertex", ""), (5, at(1178), 120.0, None, None)],
        "ord long, lat double, lon double, name string, kind string",
    )
    rows = {(r.km, r.type, r.text) for r in notes.sources(w, crossings).collect()}
    zoo, plain = notes.CROSSING_TEXT % "（Zoo）", notes.CROSSING_TEXT % ""
    assert rows == {
        (0.17, notes.DARK, notes.DARK_TEXT % 130), (1.05, notes.DARK, notes.DARK_TEXT % 130), (0.17, notes.CROSSING, zoo), (0.17, notes.CROSSING, plain), (1.18, notes.CROSSING, plain),
        (0.3, notes.MAIN, notes.MAIN_TEXT % ("Road", 300)), (0.8, notes.MAIN, notes.MAIN_TEXT % (notes.UNNAMED, 250)),
    }
    kept = [(r.km, r.type, r.text) for r in notes.safety_notes(w, crossings).orderBy("place").collect()]
    # of two crossings at one place the first stays; notes of other kinds between them end a run
    assert kept == [
        (0.17, notes.DARK, notes.DARK_TEXT % 130), (0.17, notes.CROSSING, zoo), (0.3, notes.MAIN, notes.MAIN_TEXT % ("Road", 300)), (0.8, notes.MAIN, notes.MAIN_TEXT % (notes.UNNAMED, 250)),
        (1.05, notes.DARK, notes.DARK_TEXT % 130), (1.18, notes.CROSSING, plain),
    ]
    assert notes.safety_notes(w.where("false"), crossings).collect() == []
    assert notes.safety_notes(walk(spark, (10.0, "path", "", "")), crossings.where("false")).collect() == []


def test_pictures_show_the_roads_around(spark):
    deg = math.degrees(1 / 6371008.8)
    points = spark.createDataFrame([("p", 60.0, 10.0), ("p", 60.0 + 2000 * deg, 10.0), ("q", 0.0, 0.0)], "key string, lat double, lon double")
    shown = {r.key: r for r in viewport.views(points).collect()}
    p = shown["p"]
    assert p.scale == pytest.approx((viewport.HEIGHT - viewport.HEAD - viewport.MARGIN) / 2000) and p.half == pytest.approx(1150 * 1.15) and p.lat0 == pytest.approx(60 + 1000 * deg)
    assert shown["q"].half == 0 and shown["q"].scale == pytest.approx(viewport.HEIGHT - viewport.HEAD - viewport.MARGIN)
    rows, k = [], 0
    for dy in range(-1800, 1801, 150):
        for dx in range(-1800, 1801, 150):
            lat = p.lat0 + dy * deg
            rows.append((k, k + 1, lat, p.lon0 + dx * deg / math.cos(math.radians(p.lat0)), lat, p.lon0, "primary" if k % 2 else "path"))
            k += 1
    roads = spark.createDataFrame(rows, "a long, b long, alat double, alon double, blat double, blon double, hw string")
    got = {r.a: r for r in viewport.roads_in_view(viewport.views(points), roads).where("key = 'p'").collect()}
    want = {a for a, _, lat, lon, *_ in rows if abs(lat - p.lat0) / deg <= p.half and abs(lon - p.lon0) / deg * math.cos(math.radians(p.lat0)) <= p.half * (1 + 1e-9)}
    assert set(got) == want and len(want) > 100 and all(r.main == bool(a % 2) for a, r in got.items())
    middle = next(r for r in got.values() if abs(rows[r.a][2] - p.lat0) < 1e-12 and abs(rows[r.a][3] - p.lon0) < 1e-12)
    assert (middle.ax, middle.ay) == pytest.approx((viewport.WIDTH / 2, viewport.HEAD + (viewport.HEIGHT - viewport.HEAD) / 2)) == (middle.bx, middle.by)
    assert viewport.roads_in_view(viewport.views(points.where(F.lit(False))), roads).collect() == []


def test_a_view_misses_no_band_of_cells(spark):
    """Roads along a meridian under many views: as all pairs by their distance."""
    at = [k * 0.002 for k in range(500)]
    roads = spark.createDataFrame([(k, -k, y, 10.0, y, 10.0, "path") for k, y in enumerate(at)], "a long, b long, alat double, alon double, blat double, blon double, hw string")
    middles = [0.3 + k * 0.0013 for k in range(300)]
    shown = spark.createDataFrame([(k, y, 10.0, 1.0, 8000.0) for k, y in enumerate(middles)], "key long, lat0 double, lon0 double, scale double, half double")
    got = {(r.key, r.a) for r in viewport.roads_in_view(shown, roads).select("key", "a").collect()}
    assert got == {(k, a) for k, y in enumerate(middles) for a, x in enumerate(at) if abs(math.radians(x - y)) * 6371008.8 <= 8000}


def test_steps_go_on_without_places(spark, monkeypatch):
    """Steps that know their nodes find the same crossings as steps with places, and no place of a step is written."""
    import random

    from shapeloom.operators import planner
    from shapeloom.plans import element_queries

    rng = random.Random(6)
    nodes = spark.createDataFrame([(k, 24 + rng.random() * 2e-3, 120.0) for k in range(40)] + [(40, 24.0, 120.0), (41, 24.0, 120.0)], "id long, lat double, lon double")
    steps = spark.createDataFrame([(r, i, rng.choice([40, 41, *range(40)]), 10.0 * i) for r in range(5) for i in range(60)], "key long, i int, node long, before_m double")
    poi = spark.createDataFrame([(k, 24 + rng.random() * 2e-3, 120.0) for k in range(12)] + [(12, 24.0, 120.0), (13, 50.0, 0.0)], "ord long, lat double, lon double")
    want = planner.along(steps.join(nodes.withColumnRenamed("id", "node"), "node"), poi, 25.0)
    got = planner.along_nodes(steps, nodes, poi, 25.0)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    columns, real = {}, element_queries.written
    monkeypatch.setattr(element_queries, "written", lambda df, label, **named: columns.setdefault(label, df.columns) and real(df, label, **named))
    element_queries.u2_w7_p11_p12_j5_safety_note_sources(spark, "/root/testdata/sf0.001")
    assert set(columns["walked"]) == {"key", "i", "node", "length", "before_m", "hw", "lit", "name"}


def test_shuffle_files_go_with_their_statement(spark):
    """What a table's shuffle left on disk is gone once the table is written; the session's setting is as before."""
    import glob

    from shapeloom.operators import staging

    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folder for f in glob.glob(f"{d}/*/shuffle_*.data")}
    left = {}
    for clean in (True, False):
        before = files()
        table = staging.written(spark.range(5_000).repartition(3, "id"), "cleaned", clean=clean)
        left[clean] = files() - before
        assert table.count() == 5_000 and spark.conf.get(staging.CLEANUP, None) in (None, "false")
        staging.discard(table)
    assert not left[True] and left[False]


def test_ordered_roads_are_not_shuffled_again(spark):
    from shapeloom.operators import planner

    rows = spark.range(9).selectExpr("1L as key", "int(id) as i", "id as node", "if(id < 8, id + 1, null) as next", "24d as lat", "120d as lon").hint("merge")
    roads = spark.range(8).repartition(3).selectExpr("id as a", "id + 1 as b", "1d as l").groupBy("a", "b").agg(F.min("l").alias("length"))
    met = [planner.with_roads(rows, roads, ordered) for ordered in (False, True)]
    shuffles = [m._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for m in met]
    assert shuffles[1] == shuffles[0] - 1
    columns = sorted(met[0].columns)
    assert sorted(met[0].select(columns).collect()) == sorted(met[1].select(columns).collect())
