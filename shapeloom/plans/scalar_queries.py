"""Queries of scalar functions and polyline kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from shapeloom.functions import geo
from shapeloom.functions import text as T
from shapeloom.plans.catalog import query
from shapeloom.plans.fixtures import sql, view

_P = "with n as (" + sql("nodes") + "), p as (select a.id, a.lat as lat1, a.lon as lon1, b.lat as lat2, b.lon as lon2 from n a join n b on b.id = a.id + 1)"
_Y = "sin(radians(lon2) - radians(lon1)) * cos(radians(lat2))"
_X = "cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2) - radians(lon1))"


def pairs(spark, d):
    n = view(spark, d, "nodes")
    a, b = n.select("id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), n.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "id")


@query(_P + " select id, cast(floor(1e6 * 2 * 63710088e-1 * asin(sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2))) + 5e-1) as bigint) as micro from p")
def s1_haversine(spark, d):
    """Great-circle distance."""
    return pairs(spark, d).select("id", F.floor(geo.haversine("lat1", "lon1", "lat2", "lon2") * 1e6 + 0.5).cast("long").alias("micro"))


@query(_P + " select id, cast(floor(radians(lon2 - lon1) * 63710088e-1 * cos(radians(lat1)) * 1e3 + 5e-1) as bigint) as east_mm, cast(floor(radians(lat2 - lat1) * 63710088e-1 * 1e3 + 5e-1) as bigint) as north_mm from p")
def s2_enu(spark, d):
    """Metres east and north of a point."""
    east, north = geo.enu("lat1", "lon1", "lat2", "lon2")
    return pairs(spark, d).select("id", F.floor(east * 1e3 + 0.5).cast("long").alias("east_mm"), F.floor(north * 1e3 + 0.5).cast("long").alias("north_mm"))


@query(_P + f", b as (select id, (degrees(atan2({_Y}, {_X})) + 360e0) % 360e0 as b from p), t as (select id, b, (lead(b) over (order by id) - b + 540e0) % 360e0 - 180e0 as t from b)"
       " select id, cast(floor(b * 1e3 + 5e-1) as bigint) as bearing_milli, case when abs(t) < 25 then 'straight' when abs(t) > 150 then 'uturn' when t > 0 then 'right' else 'left' end as action from t where t is not null")
def s3_s4_w6_bearing_and_turn(spark, d):
    """Bearings of consecutive pairs and the turn between them."""
    b = pairs(spark, d).select("id", geo.bearing("lat1", "lon1", "lat2", "lon2").alias("b"))
    nxt = b.select((F.col("id") - 1).alias("id"), F.col("b").alias("n"))
    return b.join(nxt, "id").select("id", F.floor(F.col("b") * 1e3 + 0.5).cast("long").alias("bearing_milli"), geo.turn_action(F.col("b"), F.col("n")).alias("action"))


@query("select p_partkey as id, case when p_size <= 10 then 1e0 else greatest(0e0, least(1e0, (40e0 - p_size) / 30e0)) end as down, greatest(0e0, least(1e0, (12e0 - p_size) / -28e0)) as up, p_size / 25e3 * 1e3 as mm from part")
def s5_s6_band_and_scale(spark, d):
    """The linear band in both directions, and the map scale."""
    v = F.col("p_size").cast("double")
    return view(spark, d, "part").select(F.col("p_partkey").alias("id"), geo.band(v, 10, 40).alias("down"), geo.band(v, 40, 12).alias("up"), geo.map_scale_mm(v).alias("mm"))


@query(r"select page_id, case when trim(regexp_replace(url, '[^0-9A-Za-z一-鿿]+', '_', 'g'), '_') = '' then 'user_' || left(sha1(url), 8) else 'user_' || left(trim(regexp_replace(url, '[^0-9A-Za-z一-鿿]+', '_', 'g'), '_'), 40) end as slug, sha1(url) as key from pages")
def s7_s9_slug(spark, d):
    """Slugs and hash keys."""
    return view(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), F.sha1("url").alias("key"))


@query("select page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped from pages")
def s8_xml_escape(spark, d):
    """XML escapes."""
    return view(spark, d, "pages").select("page_id", T.xml_escape(F.col("html")).alias("escaped"))


@query("select n_nationkey, concat_ws('-', lower(n_name), replace('cat_' || n_regionkey, 'cat_', ''), case when n_nationkey % 2 = 0 then 'standard' else 'challenge' end) as slug from nation")
def s10_route_slug(spark, d):
    """The slug of a route."""
    level = F.when(F.col("n_nationkey") % 2 == 0, "standard").otherwise("challenge")
    return view(spark, d, "nation").select("n_nationkey", F.concat_ws("-", F.lower("n_name"), F.regexp_replace(F.concat(F.lit("cat_"), F.col("n_regionkey")), "^cat_", ""), level).alias("slug"))


@query("select p_partkey as id, (p_size % 16) | ((p_size % 3) << 5) as flags, ((p_size % 16) | ((p_size % 3) << 5)) & 31 as cls, (((p_size % 16) | ((p_size % 3) << 5)) >> 5) & 3 as lit from part")
def s11_flags(spark, d):
    """Bit packing of class and light."""
    flags = T.pack_flags(F.col("p_size") % 16, F.col("p_size") % 3)
    return view(spark, d, "part").select(F.col("p_partkey").alias("id"), flags.alias("flags"), *T.unpack_flags(flags))


@query("with n as (" + sql("nodes") + "), o as (select min(lat) as la, min(lon) as lo from n) select id, cast(floor((lat - la) * 1e6 + 5e-1) as bigint) as y, cast(floor((lon - lo) * 1e6 + 5e-1) as bigint) as x, least(65535, cast(floor(size * 1e4 / 1e1 + 5e-1) as bigint)) as len_dm from n, o")
def s12_quantise(spark, d):
    """Micro-degree offsets and capped decimetres."""
    n = view(spark, d, "nodes")
    o = n.agg(F.min("lat").alias("la"), F.min("lon").alias("lo"))
    q = lambda x: F.floor(x * 1e6 + 0.5).cast("long")
    return n.crossJoin(F.broadcast(o)).select("id", q(F.col("lat") - F.col("la")).alias("y"), q(F.col("lon") - F.col("lo")).alias("x"), F.least(F.lit(65535).cast("long"), F.floor(F.col("size") * 1e4 / 10.0 + 0.5).cast("long")).alias("len_dm"))


@query("select n_nationkey, greatest(7e-1, least(26e-1, n_nationkey / 1e1 - 4e-1)) as lo, greatest(7e-1, least(26e-1, n_nationkey / 1e1 + 4e-1)) as hi, n_nationkey * 1e-2 - greatest(0e0, (6e0 - n_nationkey) / 2) / 11132e-2 as south from nation")
def s13_s14_io21_boundary(spark, d):
    """S13 S14 IO21: aspect band and expanded box of a district."""
    ar = F.col("n_nationkey") / 10.0
    clip = lambda x: F.greatest(F.lit(0.7), F.least(F.lit(2.6), x))
    return view(spark, d, "nation").select("n_nationkey", clip(ar - 0.4).alias("lo"), clip(ar + 0.4).alias("hi"), (F.col("n_nationkey") * 0.01 - F.greatest(F.lit(0.0), (6.0 - F.col("n_nationkey")) / 2) / 111.32).alias("south"))


@query("with n as (" + sql("nodes") + "), t as (select id, lat || ',' || lon as s from n) select id, cast(split_part(s, ',', 1) as double) as lat, cast(split_part(s, ',', 2) as double) as lon from t")
def s15_parse_point(spark, d):
    """Parse "lat,lon"."""
    n = view(spark, d, "nodes").select("id", F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")).alias("s"))
    lat, lon = T.parse_point(F.col("s"))
    return n.select("id", lat.alias("lat"), lon.alias("lon"))


@query("select user_id, event_id, cast(regexp_extract(props, '([0-9]+)', 1) as integer) as k, least(30, greatest(0, cast(regexp_extract(props, '([0-9]+)', 1) as integer))) as capped from events")
def s18_s20_io22_clamps(spark, d):
    """S18 S20 IO22: whole numbers from tags, clamped."""
    k = F.from_json("props", "k int")["k"]
    return view(spark, d, "events").select("user_id", "event_id", k.alias("k"), geo.clamp(k, 0, 30).alias("capped"))


@query("select p_partkey as id, cast(floor(299e-3 * (p_size * 5) + 587e-3 * (p_size * 3) + 114e-3 * p_size + 5e-1) as bigint) as luma, 80e0 + (p_size - 25) * 16e-1 as px, case when p_size * 2 >= 80 then 'hi' when p_size * 2 >= 62 then 'mid' else 'lo' end as hue, abs(p_size - 25) <= 4 as near from part")
def s17_s19_s21_s22_p16_display(spark, d):
    """S17 luma, S19 S21 projection, S22 tolerance, P16 hue."""
    s = F.col("p_size")
    hue = F.when(s * 2 >= 80, "hi").when(s * 2 >= 62, "mid").otherwise("lo")
    return view(spark, d, "part").select(F.col("p_partkey").alias("id"), F.floor(T.luma(s * 5, s * 3, s) + 0.5).cast("long").alias("luma"), (80.0 + (s - 25) * 1.6).alias("px"), hue.alias("hue"), (F.abs(s - 25) <= 4).alias("near"))


_V = "with e as (select vec_id, unnest(range(1, 33)) as i, embedding from embeddings), v as (select vec_id, i, cast(embedding[2 * i - 1] as double) as x, cast(embedding[2 * i] as double) as y from e)"


@query(_V + ", m as (select vec_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from v group by vec_id) select vec_id, i, (x - (x0 + x1) / 2) / greatest(x1 - x0, y1 - y0) as x, (y - (y0 + y1) / 2) / greatest(x1 - x0, y1 - y0) as y from v join m using (vec_id)")
def k1_k2_a9_normalised_shape(spark, d):
    """Shapes centred, their long side 1."""
    v = T.vertices(view(spark, d, "embeddings"))
    m = v.groupBy("vec_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    c, side = F.col, F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return v.join(m, "vec_id").select("vec_id", "i", ((c("x") - (c("x0") + c("x1")) / 2) / side).alias("x"), ((c("y") - (c("y0") + c("y1")) / 2) / side).alias("y"))


@query(_V + ", w as (select vec_id, i, sqrt(pow(coalesce(lead(x) over (partition by vec_id order by i), first_value(x) over (partition by vec_id order by i)) - x, 2) + pow(coalesce(lead(y) over (partition by vec_id order by i), first_value(y) over (partition by vec_id order by i)) - y, 2)) as seg from v) select vec_id, cast(floor(sum(seg) * 1e6 + 5e-1) as bigint) as perimeter_micro from w group by vec_id")
def k3_perimeter(spark, d):
    """K3: the length of the closed outline."""
    rows = T.vertices(view(spark, d, "embeddings")).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("p"))
    ring = F.zip_with("p", F.concat(F.slice("p", F.lit(2), F.size("p")), F.slice("p", 1, 1)), lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], F.lit(2)) + F.pow(b["y"] - a["y"], F.lit(2))))
    return rows.select("vec_id", F.floor(F.aggregate(ring, F.lit(0.0), lambda s, x: s + x) * 1e6 + 0.5).cast("long").alias("perimeter_micro"))


@query("with s as (" + sql("steps") + "), c as (select route, i, length, sum(length) over (partition by route order by i) - length as start_m from s) select route, i, j, start_m + j * 60e0 as at_m from (select *, unnest(range(0, cast(floor(length / 60) as bigint) + 1)) as j from c) x")
def k4_k6_control_points(spark, d):
    """K4 K6: a point at each vertex and every 60 m after it."""
    from pyspark.sql import Window

    start = F.sum("length").over(Window.partitionBy("route").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    c = view(spark, d, "steps").withColumn("start_m", start)
    return c.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / 60)))).select("route", "i", "j", (F.col("start_m") + F.col("j") * 60.0).alias("at_m"))


@query(_V + ", s as (select vec_id, i, x as ax, y as ay, lead(x) over (partition by vec_id order by i) as bx, lead(y) over (partition by vec_id order by i) as ey from v), q as (select vec_id, i as k, x * 11e-1 as px, y * 9e-1 as py from v),"
       " t as (select q.vec_id, q.k, ax, ay, bx, ey, px, py, greatest(0e0, least(1e0, ((px - ax) * (bx - ax) + (py - ay) * (ey - ay)) / (pow(bx - ax, 2) + pow(ey - ay, 2)))) as t from q join s using (vec_id) where bx is not null)"
       " select vec_id, k, cast(floor(min(sqrt(pow(px - (ax + t * (bx - ax)), 2) + pow(py - (ay + t * (ey - ay)), 2))) * 1e6 + 5e-1) as bigint) as d_micro from t group by vec_id, k")
def j12_k7_k8_polyline_distance(spark, d):
    """The distance of points to a polyline."""
    from pyspark.sql import Window

    v = T.vertices(view(spark, d, "embeddings"))
    line = Window.partitionBy("vec_id").orderBy("i")
    c = F.col
    s = v.select("vec_id", c("x").alias("ax"), c("y").alias("ay"), F.lead("x").over(line).alias("bx"), F.lead("y").over(line).alias("by")).where("bx is not null")
    q = v.select("vec_id", c("i").alias("k"), (c("x") * 1.1).alias("px"), (c("y") * 0.9).alias("py"))
    sq = lambda x: F.pow(x, F.lit(2))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((c("px") - c("ax")) * (c("bx") - c("ax")) + (c("py") - c("ay")) * (c("by") - c("ay"))) / (sq(c("bx") - c("ax")) + sq(c("by") - c("ay")))))
    gap = F.sqrt(sq(c("px") - (c("ax") + c("t") * (c("bx") - c("ax")))) + sq(c("py") - (c("ay") + c("t") * (c("by") - c("ay")))))
    return q.join(s, "vec_id").withColumn("t", t).groupBy("vec_id", "k").agg(F.floor(F.min(gap) * 1e6 + 0.5).cast("long").alias("d_micro"))
