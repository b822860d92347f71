"""Queries of lookups and of a stored library that is merged, replaced and deleted from."""

from __future__ import annotations

from pyspark.sql import functions as F

from shapeloom.operators.lookup import lookup
from shapeloom.operators.staging import new_path
from shapeloom.plans.catalog import query
from shapeloom.plans.fixtures import statement, view
from shapeloom.sources.library import Library

#: Waypoints ask for landmarks by name; every eleventh name is of a place that nobody knows, every thirteenth has none.
_ASKED = (
    "select o_orderkey as waypoint, case when o_orderkey % 13 = 0 then null when o_orderkey % 11 = 0 then 'nowhere' else concat('Supplier#', lpad(cast(o_custkey % 150 as varchar(9)), 9, '0')) end as name from {orders}"
)
_MARKS = "select concat('Supplier#', lpad(cast(s_suppkey % 70 as varchar(9)), 9, '0')) as name, s_suppkey as ord, s_nationkey as kind from {supplier}"
_SLUGS = "select o_orderkey as route, concat(cast(c_nationkey as varchar(9)), '-', o_orderstatus, '-', case when o_orderpriority < '3' then 'long' else 'short' end) as slug, o_totalprice as total from {orders} join {customer} on o_custkey = c_custkey"


def _plain(text: str) -> str:
    for t in ("orders", "customer", "supplier"):
        text = text.replace("{" + t + "}", t)
    return text


@query(
    "with m as (select name, min(ord) as ord, arg_min(kind, ord) as kind from (" + _plain(_MARKS) + ") x group by name)"
    " select waypoint, a.name, cast(ord as bigint) as ord, cast(kind as bigint) as kind, m.name is not null as found from (" + _plain(_ASKED) + ") a left join m on m.name = a.name"
)
def j10_landmark_of_waypoint(spark, d):
    """The first landmark of each waypoint's name; unknown and missing names stay as rows."""
    found = lookup(statement(spark, d, _ASKED), "name", statement(spark, d, _MARKS), "name", ["ord"], ["ord", "kind"])
    return found.select("waypoint", "name", F.col("ord").cast("long").alias("ord"), F.col("kind").cast("long").alias("kind"), "found")


@query(
    "with r as (" + _plain(_SLUGS) + "), best as (select slug, arg_max(route, (total, -route)) as best, max(total) as most from r group by slug),"
    " asked as (select distinct slug from r union select concat(slug, '-gone') from r where route % 97 = 0) select asked.slug, best, most, best is not null as found from asked left join best using (slug)"
)
def j11_detail_of_slug(spark, d):
    """The detail of each asked slug, the best of its routes; slugs without one stay as rows."""
    r = statement(spark, d, _SLUGS)
    asked = r.select("slug").union(r.where("route % 97 = 0").select(F.concat("slug", F.lit("-gone")))).distinct()
    detail = r.select("slug", F.col("route").alias("best"), F.col("total").alias("most"))
    return lookup(asked, "slug", detail, "slug", [-F.col("most"), "best"], ["best", "most"]).select("slug", "best", "most", "found")


@query(
    "with styles as (select * from (values ('AFRICA', 1, true), ('ASIA', 2, false), ('EUROPE', 3, true)) s(name, style, recommended))"
    " select n_nationkey as district, style, coalesce(recommended, true) as recommended from nation join region on n_regionkey = r_regionkey join styles on styles.name = r_name"
)
def j13_styles_of_boundaries(spark, d):
    """Boundaries with the style of their zone; zones without a style are left out."""
    styles = spark.createDataFrame([("AFRICA", 1, True), ("ASIA", 2, False), ("EUROPE", 3, True)], "zone string, style int, recommended boolean")
    rows = view(spark, d, "nation").join(view(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("district"), "r_name")
    found = lookup(rows, "r_name", styles, "zone", ["style"], ["style", "recommended"]).where("found")
    return found.select("district", "style", F.coalesce("recommended", F.lit(True)).alias("recommended"))


@query(
    "with r as (" + _plain(_SLUGS) + "), k as (select case when route % 3 = 0 then concat('user_', slug) else slug end as key, route, total from r),"
    " first as (select key, min(total) as total, arg_min(route, (total, route)) as route from k where route % 2 = 0 group by key),"
    " added as (select key, min(total) as total, arg_min(route, (total, route)) as route from k where route % 2 = 1 and key not in (select key from first) group by key),"
    " whole as (select * from first union all select * from added),"
    " fresh as (select key, min(total + 1) as total, arg_min(route, (total + 1, route)) as route from k where route % 7 = 0 group by key),"
    " mixed as (select * from whole where key not in (select key from fresh) union all select * from fresh)"
    " select key, total, route from mixed where not (starts_with(key, 'user_') and key in (select key from k where route % 5 = 0))"
)
def io19_io23_p18_library_merge(spark, d):
    """IO19 IO23 P18: a stored library after routes were added where their key was missing (twice), replaced, and deleted.

    Only keys that begin with user_ may be deleted; the others that are asked for stay.
    """
    r = statement(spark, d, _SLUGS)
    k = r.select(F.when(F.col("route") % 3 == 0, F.concat(F.lit("user_"), "slug")).otherwise(F.col("slug")).alias("key"), "total", "route")
    library = Library(spark, new_path(spark, "library"), "key string, total double, route bigint", order=(("total", "desc"),))
    library.append_missing(k.where("route % 2 = 0"))
    for _ in range(2):
        library.append_missing(k.where("route % 2 = 1"))
    library.upsert(k.where("route % 7 = 0").withColumn("total", F.col("total") + 1))
    library.delete(k.where("route % 5 = 0").select("key"))
    library.vacuum()
    return library.read()
