"""Lengths of roads to the last digit of SQL's."""

import duckdb
import pytest

from shapeloom.functions import geo
from shapeloom.plans import element_queries as E
from shapeloom.plans.fixtures import sql, view
from shapeloom.sources import elements

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "customer"):
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def test_edges(spark, duck):
    got = {(r.a, r.b): r.length for r in view(spark, SF, "edges").collect()}
    assert got == {(a, b): x for a, b, x in duck.execute("select a, b, length from (" + sql("edges") + ")").fetchall()}


def test_roads_of_ways(spark, duck):
    got = {(r.a, r.b): (r.way, r.length, r.cost) for r in elements.roads(E.map_elements(spark, SF)).collect()}
    assert got == {(a, b): tuple(x) for a, b, *x in duck.execute(E._ROADS + " select a, b, way, length, cost from road").fetchall()}


def test_places_that_are_opposite_missing_or_equal(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (37.1, 15.3, -37.1, -164.7), (24.0, None, 24.0, 120.0), (24.0, 120.0, 24.0, 120.0)], "a double, b double, c double, d double")
    got = [r[0] for r in rows.select(geo.distance("a", "b", "c", "d")).collect()]
    assert got[:2] == pytest.approx([20015114.442] * 2) and got[2] is None and got[3] == 0
    assert rows.where("false").select(geo.distance("a", "b", "c", "d")).collect() == []
