"""Map elements, nodes and ways with tags, as a network of roads and as places along them.

An element is a row (type, id, lat, lon, nodes array<bigint>, tags map<string,string>, center struct<lat,lon>).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapeloom.functions.geo import distance
from shapeloom.operators.network import EXCLUDED, edge_cost, road_safety

# Elements that count as places, by type, tag, and what its value holds (None: any value).
SELECTORS = (
    ("node", "highway", ("traffic_signals",)), ("node", "highway", ("crossing",)), ("node", "shop", ("convenience",)), ("node", "amenity", ("toilets",)), ("node", "amenity", ("drinking_water",)),
    ("node", "railway", ("station",)), ("node", "railway", ("tram_stop",)), ("node", "public_transport", ("station",)), ("node", "highway", ("bus_stop",)),
)
SELECTORS_WITHIN = (
    ("way", "leisure", "^park$"), ("node", "tourism", "attraction|museum|artwork"), ("node", "historic", ""), ("way", "tourism", "attraction|museum"), ("way", "historic", ""),
    ("node", "amenity", "theatre|place_of_worship|university|library"), ("way", "amenity", "theatre|university"),
)
# Names of supplies and stops without a name of their own, by tag value.
SUPPLY_NAMES = {"toilets": "公廁", "drinking_water": "飲水機"}
SHOP, TRAIN, TRAM, BUS = "便利商店", "台鐵車站", "捷運站", "公車站"
SCHEMA = "type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string,string>, center struct<lat:double,lon:double>"


def tag(name: str) -> Column:
    """A tag's value; an empty text for none."""
    return F.coalesce(F.try_element_at("tags", F.lit(name)), F.lit(""))


def _name() -> Column:
    return F.when(tag("name") != "", tag("name")).otherwise(tag("name:zh"))


def open_ways(elements: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Ways that runners may use: with a class that is not excluded, and not private.

    With a box (south, west, north, east) only ways that have a node in it.
    """
    ways = elements.where((F.col("type") == "way") & (tag("highway") != "") & ~tag("highway").isin(*EXCLUDED) & ~tag("access").isin("private", "no"))
    if box is None:
        return ways
    south, west, north, east = box
    inside = elements.where((F.col("type") == "node") & F.col("lat").between(south, north) & F.col("lon").between(west, east)).select(F.col("id").alias("node"))
    hit = ways.select("id", F.explode("nodes").alias("node")).join(inside, "node", "left_semi").select("id").distinct()
    return ways.join(hit, "id", "left_semi")


def roads(elements: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(a, b, length, cost, safety, name, hw, lit, way) with a < b: one road for each pair of neighbours, the cheapest.

    A way's nodes without a place are dropped before neighbours pair, and so are pairs of one node and of no length. Of
    equal costs the way with the smaller id wins, then its earlier pair. A node or way that is given twice counts once; a
    way without nodes, tags or id gives nothing.
    """
    place = elements.where("type = 'node' and lat is not null and lon is not null").groupBy(F.col("id").alias("node")).agg(F.min(F.struct("lat", "lon")).alias("at"))
    safety = F.bround(road_safety(tag("highway"), _name(), tag("foot"), tag("sidewalk"), F.nullif(tag("lanes"), F.lit(""))), 3)
    ways = open_ways(elements.where("id is not null"), box).select(F.col("id").alias("way"), tag("highway").alias("hw"), _name().alias("name"), tag("lit").alias("lit"), safety.alias("safety"), "nodes")
    # what the tags say is worked out before ways are grouped: once a way, and no tags are shuffled
    steps = ways.dropDuplicates(["way"]).select("way", "hw", "name", "lit", "safety", F.posexplode("nodes").alias("pos", "node"))
    line = Window.partitionBy("way").orderBy("pos")
    hops = steps.join(place, "node").withColumns({"next": F.lead("node").over(line), "then": F.lead("at").over(line)}).where("next is not null and next <> node")
    forth = F.col("node") < F.col("next")
    ordered = hops.withColumns({
        "a": F.least("node", "next"), "b": F.greatest("node", "next"), "p": F.when(forth, F.col("at")).otherwise(F.col("then")), "q": F.when(forth, F.col("then")).otherwise(F.col("at")),
    })
    measured = ordered.withColumn("length", distance("p.lat", "p.lon", "q.lat", "q.lon")).withColumn("cost", edge_cost(F.col("length"), F.col("safety")))
    best = measured.groupBy("a", "b").agg(F.min(F.struct("cost", "way", "pos", "length", "safety", "name", "hw", "lit")).alias("road"))
    # all roads of a pair have one length; asked here, it is worked out once
    return best.select("a", "b", "road.*").where("length > 0").select("a", "b", "length", "cost", "safety", "name", "hw", "lit", "way")


def _selected() -> Column:
    exact = [(F.col("type") == kind) & tag(key).isin(*values) for kind, key, values in SELECTORS]
    within = [(F.col("type") == kind) & (tag(key) != "") & tag(key).rlike(pattern) for kind, key, pattern in SELECTORS_WITHIN]
    return reduce(lambda x, y: x | y, exact + within)


def places(elements: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(layer, type, id, lat, lon, name, kind): signals, crossings, supply, transit and landmarks in one scan.

    An element may be in several layers, but is a crossing only where it is no signal. A way lies at its centre; elements
    without a place, and those outside a box (south, west, north, east), are left out. One that is given twice counts once.
    """
    own = F.col("type") == "node"
    lat, lon = (F.when(own, F.col(c)).otherwise(F.col(f"center.{c}")) for c in ("lat", "lon"))
    rows = elements.where(_selected() & F.col("id").isNotNull()).withColumns({"lat": lat, "lon": lon}).where("lat is not null and lon is not null")
    if box is not None:
        rows = rows.where(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))
    name, highway, amenity, railway = _name(), tag("highway"), tag("amenity"), tag("railway")
    layer = lambda when, which, name, kind: F.when(when, F.struct(F.lit(which).alias("layer"), name.alias("name"), kind.alias("kind")))
    none = F.lit("")
    supply = F.when(name != "", name).otherwise(reduce(lambda x, p: x.when(amenity == p[0], p[1]), SUPPLY_NAMES.items(), F).otherwise(SHOP))
    stop = F.when(railway == "station", TRAIN).when(railway == "tram_stop", TRAM).otherwise(BUS)
    sight = F.coalesce(*(F.nullif(tag(k), none) for k in ("tourism", "historic", "amenity", "leisure")))
    is_sight = (name != "") & ((tag("tourism") != "") | (tag("historic") != "") | amenity.isin("theatre", "university", "library") | (tag("leisure") == "park"))
    layers = F.array(
        layer(highway == "traffic_signals", "signals", none, none), layer(highway == "crossing", "crossings", name, tag("crossing")),
        layer((tag("shop") == "convenience") | amenity.isin(*SUPPLY_NAMES), "supply", supply, none),
        layer(railway.isin("station", "tram_stop") | (tag("public_transport") == "station") | (highway == "bus_stop"), "transit", F.when(name != "", name).otherwise(stop), stop),
        layer(is_sight, "landmarks", name, sight),
    )
    found = rows.dropDuplicates(["type", "id"]).select("type", "id", "lat", "lon", F.explode(F.filter(layers, lambda x: x.isNotNull())).alias("x"))
    return found.select("x.layer", "type", "id", "lat", "lon", "x.name", "x.kind")
