"""Map elements, codecs, lookups and the stored library on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from shapeloom.operators.lookup import lookup, measured_bytes
from shapeloom.operators.ranges import numbered
from shapeloom.sources import elements, network_codec
from shapeloom.sources.library import Library


def frame(spark, rows):
    return spark.createDataFrame(rows, elements.SCHEMA)


def node(i, lat=24.0, lon=120.0, **tags):
    return ("node", i, lat, lon, None, tags or None, None)


def way(i, nodes, center=None, **tags):
    return ("way", i, None, None, nodes, tags or None, center)


def test_roads_of_odd_elements(spark):
    rows = [node(1), node(2, 24.001), node(3, 24.002), node(4, 24.0), node(5, None), node(2, 24.001)]
    rows += [
        way(10, [1, 5, 2, 2, 3, 99], highway="path", name="x"), way(10, [1, 5, 2, 2, 3, 99], highway="path", name="x"), way(11, [2, 1], highway="footway"), way(12, [3, 2], highway="steps", lit="no"),
        way(13, [1, 4], highway="path"), way(14, [1, 3], highway="motorway"), way(15, [1, 3], highway="path", access="private"), way(16, [1, 3]), way(17, None, highway="path"), way(None, [1, 3], highway="path"),
        way(18, [3], highway="path"), way(19, [], highway="path"),
    ]
    got = {(r.a, r.b): r for r in elements.roads(frame(spark, rows)).collect()}
    # 1-2 is walked by two ways of equal safety: the smaller id wins; the stairs from 3 to 2 cost more than the path
    assert set(got) == {(1, 2), (2, 3)} and got[1, 2].way == 10 and got[2, 3].hw == "path" and got[2, 3].lit == ""
    assert got[1, 2].cost == pytest.approx(got[1, 2].length) and got[1, 2].safety == 1.0
    inside = elements.roads(frame(spark, rows), (24.0015, 119.0, 25.0, 121.0)).collect()
    assert {(r.a, r.b, r.way) for r in inside} == {(1, 2, 10), (2, 3, 10)}
    assert elements.roads(frame(spark, [])).collect() == [] == elements.places(frame(spark, [])).collect()


def test_places_in_several_layers(spark):
    center = (24.5, 120.5)
    rows = [
        node(1, highway="traffic_signals"), node(2, highway="crossing", crossing="zebra", name="c"), node(3, amenity="toilets"), node(3, amenity="toilets"), node(4, shop="convenience", historic="ruins", name="n"),
        node(5, railway="station", public_transport="station"), way(6, [1], center, leisure="park", **{"name:zh": "p"}), way(7, [1], None, leisure="park", name="q"), node(8, leisure="park", name="not a way"),
        node(9, amenity="bank"), node(10, None, highway="bus_stop"), node(11), node(12, tourism="museum"),
    ]
    got = sorted((r.layer, r.id, r.name, r.kind) for r in elements.places(frame(spark, rows)).collect())
    assert got == sorted([
        ("signals", 1, "", ""), ("crossings", 2, "c", "zebra"), ("supply", 3, elements.SUPPLY_NAMES["toilets"], ""), ("supply", 4, "n", ""), ("landmarks", 4, "n", "ruins"),
        ("transit", 5, elements.TRAIN, elements.TRAIN), ("landmarks", 6, "p", "park"),
    ])
    assert {r.id for r in elements.places(frame(spark, rows), (24.4, 120.4, 24.6, 120.6)).collect()} == {6}


EDGES = "district long, way long, a long, b long, alat double, alon double, blat double, blon double, length double, safety double, name string, hw string, lit string"


def test_codes_sidecars_and_short_records(spark):
    rows = [
        (1, 5, 7, 9, 24.0, 120.0, 24.00001, 120.5, 12.34, 0.95, "second", "path", "no"), (1, 2, 3, 9, 23.9, 120.1, 24.00001, 120.5, 7000.0, 1.0, "first", "other", None), (1, 9, 3, 7, 23.9, 120.1, 24.0, 120.0, 0.05, 0.02, None, "primary_link", "yes"),
        (2, 1, 1, 2, -10.0, -20.0, -10.1, -20.1, 6553.5, 0.5, "", None, ""),
    ]
    edges = spark.createDataFrame(rows, EDGES)
    got = {(r.district, r.a, r.b): r for r in network_codec.coded(edges, ["way"]).collect()}
    assert [got[k].name_code for k in ((1, 7, 9), (1, 3, 9), (1, 3, 7), (2, 1, 2))] == [2, 1, 0, 0]
    assert [got[k].flags for k in ((1, 7, 9), (1, 3, 9), (1, 3, 7), (2, 1, 2))] == [1 | 2 << 5, 31, 15 | 1 << 5, 31]
    assert got[1, 3, 9].length_dm == 65_535 and got[1, 3, 9].cut and not got[2, 1, 2].cut and got[1, 7, 9].length_dm == 123
    back = network_codec.coded(edges, ["way"]).select("a", *(c.alias(n) for n, c in zip(("hw2", "lit2"), network_codec.unpacked_flags(F.col("flags"))))).collect()
    assert {(r.a, r.hw2, r.lit2) for r in back} == {(7, "path", "no"), (3, None, ""), (3, "primary_link", "yes"), (1, None, "")}
    side = {r.district: json.loads(r.text) for r in network_codec.sidecar(edges, ["way"]).collect()}
    assert side[1]["names"] == ["", "first", "second"] and (side[1]["nodes"], side[1]["edges"], side[1]["cut"]) == (3, 3, 1) and side[2]["names"] == [""]
    box = spark.createDataFrame([(1, 23.0, 119.0, 25.0, 121.0)], "district long, south double, west double, north double, east double")
    texts = network_codec.bundle(edges, box, spark.createDataFrame([(1, 0.5, 0.0), (0, -0.5, 0.0)], "i int, x double, y double"))
    read = network_codec.read_bundle(texts.unionByName(spark.createDataFrame([(3, "no json"), (4, None)], "district long, text string")))
    found = {r.district: r for r in read.where("district is not null").collect()}
    assert found[1].meta.bbox == [23.0, 119.0, 25.0, 121.0] and found[2].meta.bbox is None and found[1].shape == [[-0.5, 0.0], [0.5, 0.0]]
    assert {d: len(r.packed) for d, r in found.items()} == {1: 28 + 8 * 3 + 12 * 3, 2: 28 + 8 * 2 + 12}
    roads = {(r.district, r.a, r.b): r for r in network_codec.decode_short(read).collect()}
    assert set(roads) == {(1, 0, 1), (1, 0, 2), (1, 1, 2), (2, 0, 1)}
    r = roads[1, 1, 2]
    assert (r.alat, r.alon, r.blat, r.blon, r.length, r.safety) == pytest.approx((24.0, 120.0, 24.00001, 120.5, 12.3, 0.95), abs=1e-6)
    assert network_codec.decode_short(network_codec.encode_short(edges.where("false"))).collect() == []


def test_numbers_over_ranges(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("v"), "id").repartition(7)
    got = sorted((r.n, r.v, r.id) for r in numbered(rows, [F.col("v").desc(), "id"], "n", first=0).collect())
    assert [n for n, _, _ in got] == list(range(5000)) and [(v, i) for _, v, i in got] == sorted(((v, i) for _, v, i in got), key=lambda x: (-x[0], x[1]))
    assert numbered(rows.where("false"), ["v"], "n").collect() == []


def test_lookups_of_small_and_large_tables(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "i int, name string")
    table = spark.createDataFrame([("a", 2, "late"), ("a", 1, "soon"), (None, 0, "none"), ("c", 1, "other")], "name string, ord int, kind string")
    for most in (1 << 20, 0):
        got = lookup(rows, "name", table, "name", ["ord"], ["kind"], most=most)
        assert sorted((r.i, r.name, r.kind, r.found) for r in got.collect()) == [(1, "a", "soon", True), (2, "b", None, False), (3, None, None, False), (4, "a", "soon", True)]
        assert ("BroadcastHashJoin" in got._jdf.queryExecution().toString()) == bool(most) or most == 0
    assert measured_bytes(table) > measured_bytes(table.limit(1)) > 0 == measured_bytes(table.where("false"))


def test_library_changes_once(spark, tmp_path):
    library = Library(spark, f"file://{tmp_path}/routes", "key string, total double", order=(("total", "desc"),))
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "key string, total double")
    table = lambda: [tuple(r) for r in library.read().orderBy(F.desc("total"), "key").collect()]
    assert library.read().collect() == [] and library.versions() == [] and library.append_missing(rows()) == 0
    first = rows(("a", 1.0), ("user_b", 2.0), ("a", 0.5), (None, 9.0))
    assert library.append_missing(first) == 2 and library.append_missing(first) == 0 and library.versions() == [1]
    assert table() == [("user_b", 2.0), ("a", 0.5)]
    assert library.upsert(rows(("a", 3.0), ("user_c", None))) == 2 and library.upsert(rows(("a", 3.0), ("user_c", None))) == 0
    assert library.versions() == [1, 2] and table() == [("a", 3.0), ("user_b", 2.0), ("user_c", None)]
    asked = spark.createDataFrame([("a",), ("user_b",), ("user_x",), ("user_b",), (None,)], "key string")
    assert {tuple(r) for r in library.delete(asked).collect()} == {("a", "guarded"), ("user_b", "deleted"), ("user_x", "unknown")}
    assert {tuple(r) for r in library.delete(asked).collect()} == {("a", "guarded"), ("user_b", "unknown"), ("user_x", "unknown")}
    assert library.versions() == [1, 2, 3] and table() == [("a", 3.0), ("user_c", None)]
    # a version that a dead job left unfinished is no version, and the next change takes its place
    (tmp_path / "routes" / "v000000004").mkdir()
    (tmp_path / "routes" / "v000000004" / "part").write_text("x")
    assert library.versions() == [1, 2, 3] and library.append_missing(rows(("d", 0.0))) == 1 and library.versions() == [1, 2, 3, 4]
    assert library.vacuum(1) == [1, 2, 3] and table() == [("a", 3.0), ("d", 0.0), ("user_c", None)] and library.read(4).count() == 3
