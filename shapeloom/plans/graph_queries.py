"""Queries over the road network: build, degrees, components, spatial joins, shortest paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from shapeloom.operators import network as N
from shapeloom.plans.catalog import query
from shapeloom.plans.fixtures import SAFETY, sql, view

_BASE = "case hw " + " ".join(f"when '{c}' then {int(v * 100)}e-2" for c, v in SAFETY.items()) + " else 5e-1 end"
_SAFE = (
    "with e0 as (" + sql("edges") + "), e1 as (select *, " + _BASE + " as s1 from e0), e2 as (select *, case when foot in ('designated', 'yes') then least(1e0, s1 + 5e-2) else s1 end as s2 from e1),"
    " e3 as (select *, case when sidewalk in ('both', 'left', 'right', 'yes') then least(1e0, s2 + 8e-2) else s2 end as s3 from e2), e4 as (select *, case when sidewalk = 'no' then greatest(5e-2, s3 - 12e-2) else s3 end as s4 from e3),"
    " e5 as (select *, case when lanes >= 4 then greatest(5e-2, s4 - 1e-1) else s4 end as s5 from e4), e as (select *, least(1e0, greatest(2e-2, s5)) as safety, length * (1 + 16e-1 * (1 - least(1e0, greatest(2e-2, s5)))) as cost from e5)"
)
_NODES = "(" + sql("nodes") + ")"
_POI = "(" + sql("poi") + ")"


def micro(name):
    """Whole millionths: trigonometry differs in the last digit between engines."""
    return F.floor(F.col(name) * 1e6 + 0.5).cast("long").alias(f"{name}_micro")


def edges(spark, d):
    """The road graph with safety and cost."""
    e = view(spark, d, "edges")
    e = e.withColumn("safety", N.road_safety(F.col("hw"), F.col("name"), F.col("foot"), F.col("sidewalk"), F.col("lanes")))
    return e.withColumn("cost", N.edge_cost(F.col("length"), F.col("safety")))


@query(_SAFE + " select a, b, cast(floor(length * 1e6 + 5e-1) as bigint) as length_micro, cast(floor(safety * 1e6 + 5e-1) as bigint) as safety_micro, cast(floor(cost * 1e6 + 5e-1) as bigint) as cost_micro from e where length > 0 and a <> b")
def g1_p1_p2_p4_j1_edges(spark, d):
    """Edges with length, safety and cost; degenerate ones dropped."""
    return edges(spark, d).where("length > 0 and a <> b").select("a", "b", *(micro(c) for c in ("length", "safety", "cost")))


@query(_SAFE + ", p as (select a, b, length, cost, a * 2 as ord from e union all select b, a, length + 1, cost + (a % 3) - 1, b * 2 + 1 from e), r as (select *, row_number() over (partition by least(a, b), greatest(a, b) order by cost, ord) as k from p) select least(a, b) as u, greatest(a, b) as v, cast(floor(length * 1e6 + 5e-1) as bigint) as length_micro, cast(floor(cost * 1e6 + 5e-1) as bigint) as cost_micro from r where k = 1")
def a1_g10_parallel_edges(spark, d):
    """Of parallel edges the cheapest."""
    e = edges(spark, d)
    both = e.select("a", "b", "length", "cost", (F.col("a") * 2).alias("ord")).unionAll(e.select("b", "a", F.col("length") + 1, F.col("cost") + (F.col("a") % 3) - 1, F.col("b") * 2 + 1))
    return N.cheapest_edges(both).select("u", "v", micro("length"), micro("cost"))


@query(_SAFE + ", x as (select a as node from e union all select b from e) select node, count(*) as degree, count(*) = 1 as dead from x group by node")
def a20_g11_a7_degrees(spark, d):
    """Degree of each node, and dead ends."""
    return N.degrees(edges(spark, d)).withColumn("dead", F.col("degree") == 1)


@query("select count(*) as nodes, cast(floor(avg(lat) * 1e6 + 5e-1) as bigint) as lat_micro, min(id) as first from " + _NODES + " n")
def a14_a15_net_stats(spark, d):
    """Counts and mean latitude."""
    return view(spark, d, "nodes").agg(F.count("*").alias("nodes"), F.floor(F.avg("lat") * 1e6 + 0.5).cast("long").alias("lat_micro"), F.min("id").alias("first"))


#: Every node's smallest reachable node: labels spread along edges as long as one gets smaller.
_PARTS = (
    "with recursive " + _SAFE[5:] + ", ends as (select a as u, b as v from e where a <> b union all select b, a from e where a <> b),"
    " part(node, component) using key (node) as (select distinct u, u from ends"
    " union select ends.u, min(part.component) from part join ends on ends.v = part.node join recurring.part old on old.node = ends.u where part.component < old.component group by ends.u)"
)


@query(_PARTS + " select component, count(*) as n from part group by component")
def g2_components(spark, d):
    """Nodes of each connected component."""
    return N.components(edges(spark, d)).groupBy("component").agg(F.count("*").alias("n"))


@query(_PARTS + ", best as (select component from part group by component order by count(*) desc, component limit 1) select a, b, cost from e where a in (select node from part join best using (component))")
def g2_t7_largest_component(spark, d):
    """The edges of the largest component."""
    return N.largest_component(edges(spark, d)).select("a", "b", "cost")


_HAV = "2 * 63710088e-1 * asin(sqrt(pow(sin((radians(n.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(n.lat)) * pow(sin((radians(n.lon) - radians(p.lon)) / 2), 2)))"


@query("with j as (select p.ord, n.id as node, " + _HAV + " as d from " + _POI + " p, " + _NODES + " n) select ord, arg_min(node, (d, node)) as node, min(d) as d from j where d <= 600 group by ord")
def j3_p8_g3_nearest_node(spark, d):
    """The nearest node within 600 m of each point of interest, by grid cells."""
    return N.nearest(view(spark, d, "poi"), "ord", view(spark, d, "nodes"), 600.0).select("ord", "node", "d")


@query("select p.ord, n.id as node, " + _HAV + " as d from " + _POI + " p, " + _NODES + " n where " + _HAV + " <= 180")
def j4_j5_u6_points_within(spark, d):
    """All nodes within 180 m of a point."""
    n = view(spark, d, "nodes").select(F.col("id").alias("node"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    return N.within(view(spark, d, "poi"), n, 180.0).select("ord", "node", "d")


_TR = "2 * 63710088e-1 * asin(sqrt(pow(sin((radians(t.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(t.lat)) * pow(sin((radians(t.lon) - radians(p.lon)) / 2), 2)))"


@query("with p as (select * from " + _POI + " x where layer <> 3), t as (select * from " + _POI + " y where layer = 3), j as (select p.ord, t.ord as stop, " + _TR + " as d from p, t)"
       " select ord, arg_min(stop, (d, stop)) as stop, min(d) as d from j group by ord")
def j6_t3_nearest_transit(spark, d):
    """The nearest stop of each point, at any distance, in rings that widen until one is found."""
    poi = view(spark, d, "poi")
    stops = poi.where("layer = 3").select(F.col("ord").alias("id"), "lat", "lon")
    return N.nearest_at_any_distance(poi.where("layer <> 3"), "ord", stops, 500.0).select("ord", F.col("node").alias("stop"), "d")


_COSTS = (
    "with recursive " + _SAFE[5:] + ", ends as (select a as u, b as v, cost from e union all select b, a, cost from e),"
    " best(node, cost) using key (node) as (select 0, cast(0 as double)"
    " union select ends.v, min(best.cost + ends.cost) from best join ends on ends.u = best.node left join recurring.best old on old.node = ends.v where old.cost is null or best.cost + ends.cost < old.cost group by ends.v)"
)


@query(_COSTS + " select node, cost from best")
def g4_shortest_costs(spark, d):
    """Least cost from node 0 to every node that it reaches, by relaxation to a fixed point."""
    return N.shortest_costs(edges(spark, d), 0)


@query("with n as " + _NODES + " select floor(lat / 2e-3) as cy, floor(lon / 2e-3) as cx, count(*) as n, min(id) as first from n group by 1, 2")
def g3_grid_cells(spark, d):
    """Nodes by grid cell."""
    n = view(spark, d, "nodes")
    return n.groupBy(F.floor(F.col("lat") / 2e-3).cast("double").alias("cy"), F.floor(F.col("lon") / 2e-3).cast("double").alias("cx")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("with p as " + _POI + " select ord, case layer when 0 then 'signal' when 1 then 'crossing' when 2 then 'supply' when 3 then 'transit' else 'landmark' end as label from p union all select ord, 'supply' from p where layer = 4 and ord % 2 = 0")
def p5_p6_u1_poi_labels(spark, d):
    """A point may have several labels."""
    first = F.when(F.col("layer") == 0, "signal").when(F.col("layer") == 1, "crossing").when(F.col("layer") == 2, "supply").when(F.col("layer") == 3, "transit").otherwise("landmark")
    labels = F.filter(F.array(first, F.when((F.col("layer") == 4) & (F.col("ord") % 2 == 0), "supply")), lambda x: x.isNotNull())
    return view(spark, d, "poi").select("ord", F.explode(labels).alias("label"))


@query(_SAFE + " select hw, count(*) as n, sum(case when hw in ('primary', 'secondary') and length >= 1e2 then 1 else 0 end) as main from e where a between 100 and 1000 group by hw")
def p14_viewport_clip(spark, d):
    """P14 IO16: edges whose first node lies in the view."""
    e = edges(spark, d).where(F.col("a").between(100, 1000))
    return e.groupBy("hw").agg(F.count("*").alias("n"), F.sum(F.when(F.col("hw").isin("primary", "secondary") & (F.col("length") >= 100), 1).otherwise(0)).alias("main"))
