"""Road network, routes, points of interest, tracks and shapes that are derived from the given tables.

Each view is one statement that both Spark and DuckDB run, so that both sides of a comparison start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shapeloom.functions import geo

# Road classes with their safety, in the order of the exchange format; greenway classes.
SAFETY = {
    "footway": 1.0, "path": 1.0, "pedestrian": 1.0, "steps": 0.2, "cycleway": 0.95, "living_street": 0.9, "track": 0.75, "residential": 0.8,
    "service": 0.72, "unclassified": 0.7, "tertiary": 0.55, "tertiary_link": 0.55, "secondary": 0.35, "secondary_link": 0.35, "primary": 0.2, "primary_link": 0.2,
}
GREEN = ("footway", "path", "pedestrian", "cycleway", "living_street")
_CLASSES = list(SAFETY)


def _pick(number: str) -> str:
    return f"case {number} " + " ".join(f"when {k} then '{c}'" for k, c in enumerate(_CLASSES)) + " end"


def _distance(a: str, b: str) -> str:
    """Haversine in SQL."""
    p = [f"radians({x})" for x in (f"{a}.lat", f"{a}.lon", f"{b}.lat", f"{b}.lon")]
    return f"2 * 63710088e-1 * asin(sqrt(pow(sin(({p[2]} - {p[0]}) / 2), 2) + cos({p[0]}) * cos({p[2]}) * pow(sin(({p[3]} - {p[1]}) / 2), 2)))"


_NODES = "select p_partkey as id, 241e-1 + floor(p_partkey / 50e0) * 9e-4 + p_size * 2e-6 as lat, 1206e-1 + (p_partkey % 50) * 98e-5 + ((p_partkey * 7919) % 13) * 1e-5 as lon, p_name as name, p_size as size, p_type as kind, p_brand as brand from {part}"
_PAIRS = "select id as a, id + 1 as b from ({nodes}) x where id % 50 <> 49 union all select id as a, id + 50 as b from ({nodes}) y"
#: The length of an edge: SQL's formula, and for Spark the same to the last digit.
LENGTH = _distance("n", "m")
_EDGES = (
    "select e.a, e.b, " + LENGTH + " as length, " + _pick("((e.a * 7919 + e.b * 104729) % 997) % 18") + " as hw, n.name as name, n.size % 8 as lanes,"
    " case when n.kind like 'S%' then 'no' when n.kind like 'P%' then 'both' else '' end as sidewalk, case when n.brand like '%1' then 'yes' else '' end as foot"
    " from ({pairs}) e join ({nodes}) n on n.id = e.a join ({nodes}) m on m.id = e.b where ((e.a * 7919 + e.b * 104729) % 997) % 18 < 16"
)
_STEPS = (
    "select l_orderkey as route, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as i, l_partkey as node, l_quantity * 10 as length, "
    + _pick("l_partkey % 16") + " as hw, concat('road ', cast(l_suppkey % 5 as varchar(9))) as name, case when l_returnflag = 'R' then 'no' else 'yes' end as lit from {lineitem}"
)
_POI = (
    "select s_suppkey as ord, s_suppkey % 5 as layer, s_name as name, 241e-1 + ((s_suppkey * 7919) % 1000) * 36e-6 as lat, 1206e-1 + ((s_suppkey * 104729) % 1000) * 49e-6 as lon from {supplier}"
)
_TRACK = "select user_id as track, ts, event_id, value as elevation, props from {events}"
_WALK = "select s.route, s.i, s.node, s.length, s.hw, s.lit, s.name, n.lat, n.lon from ({steps}) s join ({nodes}) n on n.id = s.node"
VIEWS = {"nodes": _NODES, "pairs": _PAIRS, "edges": _EDGES, "steps": _STEPS, "poi": _POI, "track": _TRACK, "walk": _WALK}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")


def _expanded(name: str) -> str:
    text = VIEWS[name]
    for view in VIEWS:
        if "{" + view + "}" in text:
            text = text.replace("{" + view + "}", _expanded(view))
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a given table."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _expanded(name)
    used = {t: view(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    if LENGTH in text:
        spark.udf.register("length_of_edge", geo.distance_udf)
        # a file of few row groups is read by few tasks, which would measure all edges
        used["part"] = used["part"].repartition("p_partkey")
        text = text.replace(LENGTH, "length_of_edge(n.lat, n.lon, m.lat, m.lon)")
    return spark.sql(text, **used)


def statement(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement over given tables, each named in braces."""
    return spark.sql(text, **{t: view(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text})


def sql(name: str) -> str:
    """The view as a DuckDB statement over the given tables."""
    text = _expanded(name)
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text
