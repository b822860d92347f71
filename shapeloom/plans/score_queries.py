"""Measures and scores of walks: every order is a walk over the nodes of the network, with its steps' roads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapeloom.functions.text import vertices
from shapeloom.operators import network as N
from shapeloom.operators import outline
from shapeloom.operators import planner as P
from shapeloom.operators import scoring as S
from shapeloom.operators.staging import tasks_for, written
from shapeloom.plans.catalog import query
from shapeloom.operators.network import GREEN
from shapeloom.plans.fixtures import SAFETY, sql, view
from shapeloom.plans.graph_queries import _POI, _SAFE, edges

#: Points to which walks are resampled: they have seven vertices at most. Kilometres of a level, ratio of a district.
SAMPLES, SIZE, LOW_KM, HIGH_KM, LOW_ASPECT, HIGH_ASPECT = 24, 2000.0, 0.5, 1.5, 0.7, 1.6
_WALK = "with walk as (" + sql("walk") + "), path as (select *, sum(length) over (partition by route order by i) - length as before_m, lead(node) over (partition by route order by i) as next from walk)"


def _hav(a, b, c, d):
    """Haversine in SQL."""
    p = [f"radians({x})" for x in (a, b, c, d)]
    return f"(2 * 63710088e-1 * asin(sqrt(pow(sin(({p[2]} - {p[0]}) / 2), 2) + cos({p[0]}) * cos({p[2]}) * pow(sin(({p[3]} - {p[1]}) / 2), 2))))"


def walk(spark, d) -> DataFrame:
    """(key, i, node, next, lat, lon, length, hw, lit, name, before_m)."""
    line = Window.partitionBy("route").orderBy("i")
    before = F.sum("length").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    rows = view(spark, d, "walk").withColumns({"before_m": before, "next": F.lead("node").over(line)})
    return rows.withColumnRenamed("route", "key")


def poi(spark, d, layer: int) -> DataFrame:
    return view(spark, d, "poi").where(F.col("layer") == layer).select("ord", "name", "lat", "lon")


def _poi_sql(layer: int) -> str:
    return f"(select * from {_POI} x where layer = {layer})"


_NEAR = ", {name} as (select route, ord, arg_min(before_m, (d, i)) as at_m, min(d) as d from (select path.route, path.i, path.before_m, q.ord, " + _hav("path.lat", "path.lon", "q.lat", "q.lon") + " as d from path, {poi} q) x where d <= {metres} group by route, ord)"


@query(_WALK + _NEAR.format(name="near", poi=_poi_sql(0), metres=35) + " select p.route, count(distinct near.ord) as signals, count(distinct near.ord) / greatest(max(p.km), 1e-1) as per_km from (select route, sum(length) / 1000 as km from walk group by route) p left join near on near.route = p.route group by p.route")
def j4_u6_a8_signals(spark, d):
    """Distinct signals within 35 m of a walk's vertices, and how many a kilometre."""
    w = walk(spark, d)
    hit = P.along(w, poi(spark, d, 0), 35.0).groupBy("key").agg(F.count("*").alias("signals"))
    km = w.groupBy("key").agg((F.sum("length") / 1000).alias("km"))
    n = F.coalesce("signals", F.lit(0).cast("long"))
    return km.join(hit, "key", "left").select(F.col("key").alias("route"), n.alias("signals"), (n / F.greatest("km", F.lit(0.1))).alias("per_km"))


@query(_WALK + _NEAR.format(name="near", poi=_poi_sql(4), metres=180) + " select route, ord, d, at_m, place from (select *, row_number() over (partition by route order by at_m, ord) as place from near) x where place <= 6")
def j5_t2_landmarks(spark, d):
    """Landmarks within 180 m of a walk with the mileage of the nearest vertex; the first six along the way."""
    near = P.along(walk(spark, d), poi(spark, d, 4), 180.0)
    place = F.row_number().over(Window.partitionBy("key").orderBy("at_m", "ord")).cast("long")
    return near.withColumn("place", place).where("place <= 6").select(F.col("key").alias("route"), "ord", "d", "at_m", "place")


@query(_SAFE + ", x as (select a as node from e union all select b from e), deg as (select node, count(*) as degree from x group by node), walk as (" + sql("walk") + ") select route, count_if(degree = 1) as dead, count(*) as visits from walk left join deg using (node) group by route")
def a7_dead_end_visits(spark, d):
    """How often a walk comes to a node with one road, each visit counted."""
    # dealt twice, to tasks of bounded size: what a task sorts by node, and what it groups by route, does not grow with the input
    parts = tasks_for(spark, view(spark, d, "lineitem").count())
    rows = view(spark, d, "walk").select("route", "node").repartition(parts, "node").join(N.degrees(edges(spark, d)), "node", "left")
    return rows.select("route", "degree").repartition(parts, "route").groupBy("route").agg(F.count_if(F.col("degree") == 1).alias("dead"), F.count("*").alias("visits"))


_BOX = (
    ", box as (select route, min(lat) as s, max(lat) as n, min(lon) as w, max(lon) as o, arg_min(lat, i) as lat0, arg_min(lon, i) as lon0, arg_max(lat, i) as lat1, arg_max(lon, i) as lon1, count(*) as n_points from walk group by route),"
    " extent as (select *, " + _hav("s", "lon0", "n", "lon0") + " as high, " + _hav("lat0", "w", "lat0", "o") + " as wide, " + _hav("lat0", "lon0", "lat1", "lon1") + " as closure from box)"
)


@query(_WALK + _BOX + " select route, closure, case when high > 0 then wide / high else 1e0 end as aspect from extent")
def a9_aspect_and_closure(spark, d):
    """The ratio of a walk's width to its height, and how far its ends are apart."""
    return S.extents(walk(spark, d)).withColumnRenamed("key", "route")


_GAP = _NEAR.format(name="sup", poi=_poi_sql(2), metres=220) + (
    ", total as (select route, sum(length) as length_m from walk group by route),"
    " marks as (select route, at_m as x from sup union all select sup.route, 0 from sup union all select total.route, length_m from total where route in (select route from sup)),"
    " gaps as (select route, max(g) / 1000 as gap_km from (select route, x - lag(x) over (partition by route order by x) as g from marks) y group by route),"
    " supply as (select total.route, coalesce(gap_km, length_m / 1000) as gap_km from total left join gaps on gaps.route = total.route)"
)


@query(_WALK + _GAP + " select route, gap_km from supply")
def a10_j5_supply_gap(spark, d):
    """The longest way without supply along each walk."""
    return S.supply_gaps(walk(spark, d), poi(spark, d, 2)).withColumnRenamed("key", "route")


_V = "with v as (select vec_id, i, cast(embedding[2 * i - 1] as double) as x, cast(embedding[2 * i] as double) as y from (select vec_id, unnest(range(1, 33)) as i, embedding from embeddings) e)"


def _resampled_sql(name: str, source: str, key: str, x: str, y: str, metric: str, n: int) -> str:
    """``n`` equidistant points of each polyline of ``source`` (key, i, x, y)."""
    return (
        f", {name}s as (select {key}, i, {x} as ax, {y} as ay, lead({x}) over l as bx, lead({y}) over l as ey from {source} window l as (partition by {key} order by i)),"
        f" {name}d as (select *, {metric} as d from {name}s where bx is not null),"
        f" {name}c as (select *, sum(d) over (partition by {key} order by i) as acc, sum(d) over (partition by {key}) as total from {name}d),"
        f" {name}k as (select c.{key}, k, min(c.i) as i from {name}c c, range(0, {n}) r(k) where acc >= total / {n - 1} * k or c.i = (select max(i) from {name}c z where z.{key} = c.{key}) group by c.{key}, k),"
        f" {name} as (select q.{key}, cast(q.k as bigint) as k, ax + (bx - ax) * t as x, ay + (ey - ay) * t as y from (select k.{key}, k.k, ax, ay, bx, ey, case when d > 0 and total > 0 then greatest(0e0, least(1e0, (total / {n - 1} * k.k - (acc - d)) / d)) else 0e0 end as t from {name}k k join {name}c c on c.{key} = k.{key} and c.i = k.i) q"
        f" union all select {key}, cast(k as bigint), ax, ay from {name}s, range(0, {n}) r(k) where {key} not in (select {key} from {name}d))"
    )


@query(_V + _resampled_sql("r", "v", "vec_id", "x", "y", "sqrt(pow(bx - ax, 2) + pow(ey - ay, 2))", 24) + " select vec_id, k, x, y from r")
def k4_resampled_outlines(spark, d):
    """K4: 24 equidistant points of every outline."""
    rows = vertices(view(spark, d, "embeddings")).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    points = outline.resampled(F.transform("p", lambda p: F.struct(p["x"], p["y"])), 24)
    return rows.select("vec_id", F.posexplode(points).alias("k", "p")).select("vec_id", F.col("k").cast("long").alias("k"), "p.x", "p.y")


#: A walk's target is the same walk on a coarser grid: its vertices rounded to thousandths of a degree.
_FIT = (
    ", goal as (select route, i, floor(lat * 1e3 + 5e-1) / 1e3 as lat, floor(lon * 1e3 + 5e-1) / 1e3 as lon from walk)"
    + _resampled_sql("ra", "walk", "route", "lat", "lon", _hav("ax", "ay", "bx", "ey"), SAMPLES)
    + _resampled_sql("rb", "goal", "route", "lat", "lon", _hav("ax", "ay", "bx", "ey"), SAMPLES)
    + ", org as (select route, x as lat0, y as lon0 from ra where k = 0),"
    " pa as (select route, k, radians(y - lon0) * 63710088e-1 * cos(radians(lat0)) as x, radians(x - lat0) * 63710088e-1 as y from ra join org using (route)),"
    " pb as (select route, k, radians(y - lon0) * 63710088e-1 * cos(radians(lat0)) as x, radians(x - lat0) * 63710088e-1 as y from rb join org using (route)),"
    " sa as (select a.route, a.x as ax, a.y as ay, b.x - a.x as dx, b.y - a.y as dy from pa a join pa b on a.route = b.route and b.k = a.k + 1),"
    " sb as (select a.route, a.x as ax, a.y as ay, b.x - a.x as dx, b.y - a.y as dy from pb a join pb b on a.route = b.route and b.k = a.k + 1),"
    + ",".join(
        f" d{p} as (select {p}.route, {p}.k, min(sqrt(pow(x - ax - t * dx, 2) + pow(y - ay - t * dy, 2))) as d from (select p.route, p.k, p.x, p.y, ax, ay, dx, dy, case when dx * dx + dy * dy > 0 then greatest(0e0, least(1e0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) else 0e0 end as t from {p} p join {s} s on s.route = p.route) {p} group by {p}.route, {p}.k),"
        f" w{p} as (select route, 5e-1 * avg(d) + 5e-1 * list_sort(list(d))[{int(SAMPLES * 0.9) + 1}] as e from d{p} group by route)"
        for p, s in (("pa", "sb"), ("pb", "sa"))
    )
    + ", fit as (select wpa.route, (wpa.e + wpb.e) / 2 as error_m from wpa join wpb on wpb.route = wpa.route)"
)


def fits(w: DataFrame) -> DataFrame:
    """(key, error_m): how far a walk is from its target."""
    coarse = lambda c: (F.floor(F.col(c) * 1e3 + 0.5) / 1e3).alias(c)
    in_line = lambda *v: F.transform(F.sort_array(F.collect_list(F.struct("i", *v))), lambda p: F.struct(p["lat"], p["lon"]))
    both = w.groupBy("key").agg(in_line("lat", "lon").alias("route"), in_line(coarse("lat"), coarse("lon")).alias("target"))
    return both.select("key", outline.error(F.col("route"), F.col("target"), SAMPLES).alias("error_m"))


@query(_WALK + _FIT + " select route, error_m from fit")
def k8_a11_fidelity_error(spark, d):
    """Half the mean and half the ninth decile of the distances between a walk and its target, both ways."""
    return fits(walk(spark, d)).withColumnRenamed("key", "route")


def _band(v: str, good: str, bad: str) -> str:
    return f"greatest(0e0, least(1e0, ({bad} - ({v})) / ({bad} - {good})))"


_SAFE100 = "case hw " + " ".join(f"when '{c}' then {round(v * 100)}" for c, v in SAFETY.items()) + " else 50 end"
_IS_GREEN = "(hw in (" + ", ".join(f"'{c}'" for c in GREEN) + ") or " + " or ".join(f"contains(name, '{h}')" for h in N.GREENWAY_HINTS) + ")"
_LEGS = (
    ", leg as (select *, next is not null and row_number() over (partition by route, least(node, next), greatest(node, next) order by i) > 1 as again from path),"
    " sums as (select route, sum(length) as length_m, sum(" + _SAFE100 + " * length) / (100e0 * sum(length)) as safety, sum(case when " + _IS_GREEN + " then length else 0 end) / sum(length) as greenway,"
    " sum(case when again then length else 0 end) / sum(length) as retrace from leg group by route)"
)
_PARTS = (
    _WALK + _LEGS + _BOX + _GAP + _FIT
    + _NEAR.format(name="sig", poi=_poi_sql(0), metres=35) + _NEAR.format(name="mark", poi=_poi_sql(4), metres=180)
    + ", ends as (select a as node from roads union all select b from roads), deg as (select node, count(*) as degree from ends group by node),"
    " dead as (select route, count_if(degree = 1) as dead from walk left join deg using (node) group by route),"
    " start as (select route, lat, lon from walk where i = 0), stop as (select route, min(" + _hav("start.lat", "start.lon", "q.lat", "q.lon") + ") as transit from start, " + _poi_sql(3) + " q group by route),"
    " sigs as (select route, count(*) as n from sig group by route), marked as (select route, count(*) as n from mark group by route),"
    " m as (select s.route, length_m / 1000 as km, safety, greenway, retrace, closure, case when high > 0 then wide / high else 1e0 end as aspect, gap_km, transit,"
    f" greatest(0e0, 1 - error_m / (12e-2 * {SIZE!r}::double)) as fit, coalesce(sigs.n, 0) / greatest(length_m / 1000, 1e-1) as sig_km, coalesce(marked.n, 0) as marks, dead"
    " from sums s join extent using (route) join supply using (route) join fit using (route) join dead using (route) join stop using (route) left join sigs on sigs.route = s.route left join marked on marked.route = s.route),"
    f" p as (select route, 5e-1 * fit + 2e-1 * {_band('closure', '30e0', '400e0')} + 15e-2 * {_band('retrace', '5e-2', '4e-1')} + 15e-2 * {_band(f'{SIZE!r}::double / 25e3 * 1e3', '40e0', '12e0')} as shape,"
    f" 45e-2 * safety + 25e-2 * {_band('sig_km', '15e-1', '4e0')} + 2e-1 * least(1e0, greenway / 35e-2) + 1e-1 * {_band('dead', '0e0', '6e0')} as safety,"
    f" 7e-1 * (case when km between {LOW_KM!r}::double and {HIGH_KM!r}::double then 1e0 else {_band(f'case when km < {LOW_KM!r}::double then {LOW_KM!r}::double - km else km - {HIGH_KM!r}::double end', '0e0', '3e0')} end)"
    f" + 3e-1 * (case when gain is null then 75e-2 else {_band('gain', '(5e1 * km / 1e1)', '(5e1 * km / 1e1 * 3 + 3e1)')} end) as distance,"
    f" 4e-1 * (case when aspect between {LOW_ASPECT!r}::double and {HIGH_ASPECT!r}::double then 1e0 else {_band(f'case when aspect < {LOW_ASPECT!r}::double then {LOW_ASPECT!r}::double - aspect else aspect - {HIGH_ASPECT!r}::double end', '0e0', '9e-1')} end)"
    f" + 35e-2 * least(1e0, greenway / 3e-1) + 25e-2 * {_band('abs(least(marks, 3) - 3)', '0e0', '3e0')} as district,"
    f" 55e-2 * {_band('transit', '4e2', '15e2')} + 45e-2 * {_band('gap_km', '3e0', '6e0')} as logistics from m left join gains using (route))"
).replace("with walk as", "with roads as (" + sql("edges") + "), gains as (select user_id as route, max(value) - min(value) as gain from events group by user_id), walk as", 1)


@query(_PARTS + " select route, shape, safety, distance, district, logistics, 100 * (3e-1 * shape + 25e-2 * safety + 2e-1 * distance + 15e-2 * district + 1e-1 * logistics) as total from p")
def r1_r6_a13_scores(spark, d):
    """The five parts of every walk's score and their weighted total.

    Climbs are known for walks with a track (the span of its values); without one the climb counts 0.75.
    """
    w = written(walk(spark, d), "walk")
    places = {name: poi(spark, d, layer) for name, layer in (("signals", 0), ("supply", 2), ("transit", 3), ("landmarks", 4))}
    gains = view(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg((F.max("value") - F.min("value")).alias("gain"))
    terms = w.select("key").distinct().join(gains, "key", "left").select(
        "key", "gain", *(F.lit(v).alias(n) for n, v in (("size_m", SIZE), ("low_km", LOW_KM), ("high_km", HIGH_KM), ("low_aspect", LOW_ASPECT), ("high_aspect", HIGH_ASPECT)))
    )
    safe = w.withColumns({"green": S.is_green(F.col("hw"), F.col("name")), "safety_100": F.round(N.base_safety(F.col("hw")) * 100)})
    return S.scores(safe, fits(w), places, N.degrees(edges(spark, d)), terms).select(F.col("key").alias("route"), *S.WEIGHTS, "total")
