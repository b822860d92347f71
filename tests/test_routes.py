import math

import numpy as np
from pyspark.sql import functions as F

from shapeloom.functions import geo
from shapeloom.functions import text as T
from shapeloom.operators import folds, network, raster


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_haversine_and_inverse(spark):
    assert abs(value(spark, geo.haversine(24.0, 120.0, 25.0, 120.0)) - math.pi / 180 * geo.RADIUS) < 1e-6
    lat, lon = geo.enu_inverse(24.0, 120.0, *geo.enu(24.0, 120.0, 24.01, 120.02))
    assert abs(value(spark, lat) - 24.01) < 1e-9 and abs(value(spark, lon) - 120.02) < 1e-9


def test_band_is_a_step_where_bounds_are_equal(spark):
    assert [value(spark, geo.band(F.lit(x), 5, 5)) for x in (4.0, 5.0, 6.0)] == [1.0, 1.0, 0.0]


def test_backtracks(spark):
    nodes = F.array(*(F.lit(x).cast("long") for x in (1, 2, 3, 2, 1, 4)))
    assert value(spark, folds.collapse_backtracks(nodes)) == [1, 4]


def test_climb(spark):
    assert value(spark, folds.climb(F.array(*map(F.lit, (10.0, 14.0, 15.0, 12.0, 20.0))))) == 13.0


def test_short_cue_takes_the_next_name(spark):
    steps = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(m).alias("length")) for n, m in (("a", 20.0), ("b", 50.0), ("c", 10.0))))
    assert [tuple(r) for r in value(spark, folds.cue_rows(steps))] == [(0.0, "b", 70.0), (70.0, "c", 10.0)]


def test_safety_clamps_between_rules(spark):
    s = network.road_safety(F.lit("primary"), F.lit(""), F.lit("yes"), F.lit("no"), F.lit("6;2"))
    assert abs(value(spark, s) - 0.05) < 1e-12


def test_components_and_costs(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (8, 9, 1.0)], "a long, b long, cost double")
    assert dict(map(tuple, network.components(e).collect())) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert dict(map(tuple, network.shortest_costs(e, 1).collect())) == {1: 0.0, 2: 1.0, 3: 2.0}


def test_slug_and_escape(spark):
    assert value(spark, T.slug(F.lit("--a b//貓--"))) == "user_a_b_貓"
    assert value(spark, T.xml_escape(F.lit("<&>"))) == "&lt;&amp;&gt;"


def test_raster_ring_is_filled():
    grey = np.full((16, 16), 255, np.uint8)
    grey[4:12, 4:12] = 0
    grey[6:10, 6:10] = 255
    assert raster.filled(raster.binarise(grey)).sum() == 64
    assert len(raster.boundary(raster.filled(raster.binarise(grey)))) == 28
    assert raster.boundary(np.zeros((4, 4), bool)) == []


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 100 and set(e.oracle_sql()) <= set(e.queries())


def test_shape_files(spark, tmp_path):
    from shapeloom.sources.shapes import broken_shapes, read_shapes

    for name, text in (
        ("a", '{"key": "k", "name": "old", "pts": [[0, 0], [1, 0]]}'), ("b", '{"key": "k", "name": "new", "pts": [[0, 0], [1, 0]], "aspect": 2.0, "fits": ["x"]}'),
        ("c", "{broken"), ("d", '{"key": "q", "name": "q"}'), ("e", '{"key": "z", "name": "z", "pts": [[0, 0], [1, 1], [0, 0]]}'),
    ):
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.key: r for r in read_shapes(spark, str(tmp_path), ("any",)).collect()}
    assert set(got) == {"k", "z"} and got["k"].name == "new" and len(got["k"].pts) == 3 and got["k"].fits == ["x"]
    assert len(got["z"].pts) == 3 and got["z"].fits == ["any"] and got["z"].aspect == 1.0
    assert sorted(r.file for r in broken_shapes(spark, str(tmp_path)).collect()) == ["c.json", "d.json"]


def test_paths(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)] + [(0, 9, 20.0), (3, 7, 2.0), (50, 51, 1.0)], "a long, b long, cost double")
    got = {r.node: r.path for r in network.shortest_paths(e, 0).collect()}
    assert got[9] == [0, 1, 2, 3, 7, 8, 9] and got[0] == [0] and got[6] in ([0, 1, 2, 3, 7, 6], [0, 1, 2, 3, 4, 5, 6]) and len(got) == 10


def test_fit_band(spark):
    from shapeloom.operators.search import fit_band

    routes = spark.createDataFrame([(1, 1000.0, 8.0, 12.0), (2, 1000.0, 90.0, 99.0)], "key int, size double, lo_km double, hi_km double")
    measure = lambda c: c.withColumn("km", F.when(F.col("size") > 350, F.col("size") / 100))
    got = {r.key: r for r in fit_band(routes, measure, lambda c: measure(c).withColumn("score", F.col("size")), 8).collect()}
    assert got[1].fitted and 11.5 < got[1].km <= 12 and not got[2].fitted and got[2].size == 1000.0


def test_report(spark):
    from shapeloom.operators.report import NO_MARKS, markdown_report

    part = "array<struct<label:string,weight:int,score:double,detail:array<struct<name:string,value:string>>>>"
    routes = spark.createDataFrame([(1, "T", "cat", "d", "10K", 9.5, 24.0, 120.0, 71.25, [("fit", 30, 80.0, [("a", "1"), ("b", "2")])])], f"route int, title string, shape string, district string, level string, km double, lat double, lon double, total double, parts {part}")
    cues = spark.createDataFrame([(1, 2, 1.0, "左轉", "B", 40), (1, 1, 0.0, "出發", "A", 1000)], "route int, seq int, km double, action string, road string, len_m int")
    notes = spark.createDataFrame([(1, 1, 0.5, "夜間照明", "dark")], "route int, ord int, km double, type string, text string")
    marks = spark.createDataFrame([], "route int, ord int, km double, name string, kind string, dist_m int")
    text = markdown_report(routes, cues, notes, marks).first().report
    lines = text.split("\n")
    assert lines[0] == "# T" and "| fit | 30% | 80.0 |" in lines and "a：1 ／ b：2" in lines and NO_MARKS in lines
    assert lines.index("| 1 | 0.00 | 出發 | A | 1000 m |") + 1 == lines.index("| 2 | 1.00 | 左轉 | B | 40 m |") and "| 0.50 | 夜間照明 | dark |" in lines
