"""Queries over the route library: joins, set operations, ranking, filters, and text sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shapeloom.operators.ranges import numbered
from shapeloom.plans.catalog import query
from shapeloom.plans.fixtures import sql, view


def routes(spark, d):
    """One row for each order as a route of the library."""
    level = F.when(F.col("o_orderpriority") < "3", "challenge").otherwise("standard")
    o = view(spark, d, "orders").join(view(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderkey").alias("route"), F.col("c_nationkey").alias("district"), F.col("o_orderstatus").alias("shape"), level.alias("level"), F.col("o_totalprice").alias("total"), (F.col("o_custkey") % 20).alias("km"))


_ROUTES = "with r as (select o_orderkey as route, c_nationkey as district, o_orderstatus as shape, case when o_orderpriority < '3' then 'challenge' else 'standard' end as level, o_totalprice as total, o_custkey % 20 as km from orders join customer on o_custkey = c_custkey)"


@query(_ROUTES + " select count(*) as routes, count(distinct district) as districts, count(distinct shape) as shapes, cast(sum(km) as bigint) as km from r")
def a16_library_stats(spark, d):
    """Totals of the library."""
    return routes(spark, d).agg(F.count("*").alias("routes"), F.count_distinct("district").alias("districts"), F.count_distinct("shape").alias("shapes"), F.sum("km").alias("km"))


@query("select n_regionkey as zone, string_agg(n_name, ',' order by n_nationkey) as districts, count(*) as n from nation group by n_regionkey")
def a17_t8_zones(spark, d):
    """Districts by zone, in a fixed order."""
    n = view(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("xs"), F.count("*").alias("n"))
    return n.select(F.col("n_regionkey").alias("zone"), F.array_join(F.transform("xs", lambda x: x["n_name"]), ",").alias("districts"), "n")


@query(_ROUTES + " select district, route, total, place from (select *, row_number() over (partition by district order by total desc, route) as place from r) x where place <= 5")
def a18_t4_best_of_district(spark, d):
    """The five best routes of each district."""
    top = F.row_number().over(Window.partitionBy("district").orderBy(F.desc("total"), "route"))
    return routes(spark, d).withColumn("place", top.cast("long")).where("place <= 5").select("district", "route", "total", "place")


@query(_ROUTES + " select route, km, shape from r where level = 'standard' and shape = 'O' order by km, route limit 50")
def p15_t5_filter_and_sort(spark, d):
    """The library filtered by level and shape, by length."""
    return routes(spark, d).where("level = 'standard' and shape = 'O'").orderBy("km", "route").limit(50).select("route", "km", "shape")


@query(_ROUTES + " select n_nationkey from nation where n_nationkey not in (select district from r where km = 3 and total > 300000) and n_nationkey % 2 = 0")
def j9_u4_p13_missing_districts(spark, d):
    """J9 U4 P13 IO19: recommended districts without a route."""
    have = routes(spark, d).where("km = 3 and total > 300000").select(F.col("district").alias("n_nationkey"))
    return view(spark, d, "nation").where("n_nationkey % 2 = 0").join(have, "n_nationkey", "left_anti").select("n_nationkey")


@query("select n_nationkey, r_regionkey, level from nation, region, (values ('standard'), ('challenge')) l(level) where r_regionkey <> 0")
def j7_g14_job_list(spark, d):
    """Districts x shapes x levels."""
    levels = spark.createDataFrame([("standard",), ("challenge",)], "level string")
    return view(spark, d, "nation").select("n_nationkey").crossJoin(F.broadcast(view(spark, d, "region").where("r_regionkey <> 0").select("r_regionkey"))).crossJoin(F.broadcast(levels))


@query("select n.n_nationkey, cast(i as bigint) as i, cast(j as bigint) as j, cast(rot as bigint) as rot from nation n, range(0, 5) a(i), range(0, 5) b(j), range(-30, 31, 10) c(rot)")
def j8_candidate_grid(spark, d):
    """25 centres x 7 rotations for each district."""
    g = lambda a, b, s, n: spark.range(a, b, s).withColumnRenamed("id", n)
    grid = g(0, 5, 1, "i").crossJoin(F.broadcast(g(0, 5, 1, "j"))).crossJoin(F.broadcast(g(-30, 31, 10, "rot")))
    return view(spark, d, "nation").select("n_nationkey").crossJoin(F.broadcast(grid))


@query("select p_name as name, min(p_partkey) as first, arg_min(p_brand, p_partkey) as brand from part group by p_name")
def j10_j11_j13_lookup(spark, d):
    """The first part of each name, found by aggregation."""
    return view(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("first"), F.min_by("p_brand", "p_partkey").alias("brand"))


@query("select n_nationkey, n_name in ('FRANCE', 'GERMANY', 'N1', 'NATION_1') as asked, starts_with(n_name, 'N') as removable from nation")
def p17_p18_u3_whitelist(spark, d):
    """Asked names that are known, and the delete guard."""
    return view(spark, d, "nation").select("n_nationkey", F.col("n_name").isin("FRANCE", "GERMANY", "N1", "NATION_1").alias("asked"), F.startswith("n_name", F.lit("N")).alias("removable"))


@query("select p_name as key, arg_max(p_partkey, (p_size, p_partkey)) as kept from part group by p_name")
def u5_upsert(spark, d):
    """U5 IO23: of entries with one key the one of highest priority stays."""
    return view(spark, d, "part").groupBy(F.col("p_name").alias("key")).agg(F.max(F.struct("p_size", "p_partkey")).alias("m")).select("key", F.col("m.p_partkey").alias("kept"))


@query("select s_suppkey, case when s_suppkey % 3 in (0, 1) then 'signal' else 'plain' end as kind from supplier where not (s_suppkey % 3 in (0) and s_nationkey > 12)")
def p12_crossings(spark, d):
    """Crossings without signals."""
    return view(spark, d, "supplier").where(~((F.col("s_suppkey") % 3 == 0) & (F.col("s_nationkey") > 12))).select("s_suppkey", F.when((F.col("s_suppkey") % 3).isin(0, 1), "signal").otherwise("plain").alias("kind"))


_LINE = "with n as (" + sql("nodes") + ")"


@query(_LINE + " select cast(floor(id / 50e0) as bigint) as route, string_agg('<trkpt lat=\"' || printf('%.6f', lat) || '\" lon=\"' || printf('%.6f', lon) || '\"/>', chr(10) order by id) as gpx from n group by 1")
def io12_gpx(spark, d):
    """IO12: track points of each route as GPX text."""
    n = view(spark, d, "nodes").withColumn("route", F.floor(F.col("id") / 50))
    point = F.format_string('<trkpt lat="%.6f" lon="%.6f"/>', "lat", "lon")
    rows = n.groupBy("route").agg(F.sort_array(F.collect_list(F.struct("id", point.alias("p")))).alias("xs"))
    return rows.select("route", F.array_join(F.transform("xs", lambda x: x["p"]), "\n").alias("gpx"))


@query(_LINE + " select cast(floor(id / 50e0) as bigint) as route, string_agg(printf('%.6f,%.6f,0', lon, lat), ' ' order by id) as coordinates from n group by 1")
def io13_kml(spark, d):
    """IO13: coordinates of each route as KML text, longitude first."""
    n = view(spark, d, "nodes").withColumn("route", F.floor(F.col("id") / 50))
    rows = n.groupBy("route").agg(F.sort_array(F.collect_list(F.struct("id", F.format_string("%.6f,%.6f,0", "lon", "lat").alias("p")))).alias("xs"))
    return rows.select("route", F.array_join(F.transform("xs", lambda x: x["p"]), " ").alias("coordinates"))


@query("with s as (" + sql("steps") + ") select route, i, concat_ws(',', cast(i + 1 as varchar), printf('%.2f', length / 1000), name, cast(cast(length as bigint) as varchar)) as line from s")
def io14_s16_cue_csv(spark, d):
    """IO14 S16: lines of a cue sheet as CSV."""
    s = view(spark, d, "steps")
    return s.select("route", "i", F.concat_ws(",", (F.col("i") + 1).cast("string"), F.format_string("%.2f", F.col("length") / 1000), "name", F.col("length").cast("long").cast("string")).alias("line"))


@query("with s as (" + sql("steps") + ") select name, row_number() over (order by min(route * 100 + i)) as code, count(*) as n from s group by name")
def io11_name_dictionary(spark, d):
    """IO11: names numbered by first appearance, over ranges of places: no task takes all names."""
    names = view(spark, d, "steps").groupBy("name").agg(F.min(F.col("route") * 100 + F.col("i")).alias("first"), F.count("*").alias("n"))
    return numbered(names, ["first"], "code").select("name", "code", "n")


@query(_ROUTES + " select route, '{\"route\":' || route || ',\"level\":\"' || level || '\",\"km\":' || km || '}' as line from r")
def io18_json_lines(spark, d):
    """IO18: the library's index as JSON lines."""
    return routes(spark, d).select("route", F.to_json(F.struct("route", "level", "km")).alias("line"))


@query("select user_id, count(*) as n, cast(sum(k) as bigint) as k from (select user_id, cast(json_extract_string(props, '$.k') as bigint) as k from events) x where k > 3 group by user_id")
def io2_io3_tag_filter(spark, d):
    """IO2 IO3: a scan filtered by tags of a bag."""
    tags = F.from_json("props", "map<string,string>")
    rows = view(spark, d, "events").select("user_id", tags["k"].cast("long").alias("k")).where("k > 3")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
