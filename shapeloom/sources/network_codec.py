"""Packed networks: a header, nodes as micro-degree offsets, edges in 16 or in 12 bytes (little-endian).

The longer record has codes of a road's name and class, which a sidecar explains; the shorter one has length and safety
only, and travels as text in a JSON bundle. A network is one district's: the roads of a district are packed in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAGIC, SHORT_MAGIC = b"CRG2", b"CRG1"
# The order of road classes and of lighting in the record of a road; the code of any other class; and the
# most that its 16-bit fields hold.
CLASSES = (
    "footway", "path", "pedestrian", "steps", "cycleway", "living_street", "track", "residential", "service", "unclassified", "tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link",
)
LIT, OTHER, MOST = ("", "yes", "no"), 31, 65_535
_HEAD = np.dtype([("magic", "S4"), ("n", "<u4"), ("m", "<u4"), ("lat", "<f8"), ("lon", "<f8")])
_NODE = np.dtype([("lat", "<u4"), ("lon", "<u4")])
_EDGE = np.dtype([("a", "<u4"), ("b", "<u4"), ("length", "<u2"), ("safety", "<u2"), ("name", "<u2"), ("flags", "<u2")])
_SHORT = np.dtype([("a", "<u4"), ("b", "<u4"), ("length", "<u2"), ("safety", "<u2")])
#: What a bundle holds as text.
BUNDLE = "meta struct<key:bigint,bbox:array<double>,nodes:bigint,edges:bigint>, shape array<array<double>>, b64 string"


def flags(hw: Column, lit: Column) -> Column:
    """Class and lighting of a road in seven bits."""
    of = lambda names, c, none: F.coalesce(F.create_map(*(F.lit(x) for k, n in enumerate(names) for x in (n, k)))[F.coalesce(c, F.lit(""))], F.lit(none))
    return of(CLASSES, hw, OTHER).bitwiseOR(F.shiftleft(of(LIT, lit, 0), 5))


def unpacked_flags(code: Column) -> tuple[Column, Column]:
    """Class and lighting from seven bits; null for another class."""
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), k)
    return pick(CLASSES, code.bitwiseAND(F.lit(OTHER))), pick(LIT, F.shiftright(code, 5).bitwiseAND(F.lit(3)))


def names(edges: DataFrame, order: list[str]) -> DataFrame:
    """(district, name, code): each district's road names from 1, in the order in which they first appear; no name is 0."""
    first = edges.where("name <> ''").groupBy("district", "name").agg(F.min(F.struct(*order)).alias("first"))
    return first.select("district", "name", F.row_number().over(Window.partitionBy("district").orderBy("first")).alias("code"))


def coded(edges: DataFrame, order: list[str]) -> DataFrame:
    """``edges`` with name_code, flags, length_dm and safety_milli as the record holds them, and cut: a length too long for it.

    edges: (district, name, hw, lit, length, safety, the columns of ``order``). Null names count as none.
    """
    edges = edges.withColumn("name", F.coalesce("name", F.lit("")))
    whole = lambda c, k: F.bround(F.col(c) * k).cast("int")
    return edges.join(names(edges, order), ["district", "name"], "left").withColumns({
        "name_code": F.least(F.coalesce("code", F.lit(0)), F.lit(MOST)), "flags": flags(F.col("hw"), F.col("lit")), "length_dm": F.least(whole("length", 10), F.lit(MOST)),
        "safety_milli": whole("safety", 1000), "cut": F.col("length") > MOST / 10,
    }).drop("code")


def sidecar(edges: DataFrame, order: list[str]) -> DataFrame:
    """(district, text): what explains a district's records, as JSON: counts, classes, names by code, lengths cut."""
    ends = edges.select("district", F.explode(F.array("a", "b")).alias("id")).distinct().groupBy("district").agg(F.count("*").alias("nodes"))
    sums = edges.groupBy("district").agg(F.count("*").alias("edges"), F.count_if(F.col("length") > MOST / 10).alias("cut"))
    listed = names(edges, order).groupBy("district").agg(F.sort_array(F.collect_list(F.struct("code", "name"))).alias("xs"))
    rows = sums.join(ends, "district").join(listed, "district", "left")
    named = F.concat(F.array(F.lit("")), F.coalesce(F.transform("xs", lambda x: x["name"]), F.array().cast("array<string>")))
    return rows.select("district", F.to_json(F.struct(F.col("district").alias("key"), "nodes", "edges", "cut", F.array(*map(F.lit, CLASSES)).alias("hw"), named.alias("names"))).alias("text"))


def _records(group: pd.DataFrame, magic: bytes, kind: np.dtype) -> pd.DataFrame:
    nodes = pd.concat([group[["a", "alat", "alon"]].set_axis(["id", "lat", "lon"], axis=1), group[["b", "blat", "blon"]].set_axis(["id", "lat", "lon"], axis=1)]).drop_duplicates("id").sort_values("id")
    head = np.zeros(1, _HEAD)
    head[0] = (magic, len(nodes), len(group), nodes["lat"].min(), nodes["lon"].min())
    packed = np.zeros(len(nodes), _NODE)
    packed["lat"], packed["lon"] = np.round((nodes["lat"] - nodes["lat"].min()) * 1e6), np.round((nodes["lon"] - nodes["lon"].min()) * 1e6)
    group, edges = group.sort_values(["a", "b"]), np.zeros(len(group), kind)
    ids = nodes["id"].to_numpy()
    edges["a"], edges["b"] = np.searchsorted(ids, group["a"]), np.searchsorted(ids, group["b"])
    edges["length"], edges["safety"] = np.minimum(MOST, np.round(group["length"] * 10)), np.round(group["safety"] * 1000)
    for more in set(kind.names) - set(_SHORT.names):
        edges[more] = group[more]
    return pd.DataFrame({"district": [group["district"].iloc[0]], "packed": [head.tobytes() + packed.tobytes() + edges.tobytes()]})


def encode(edges: DataFrame) -> DataFrame:
    """(district, packed) from (district, a, alat, alon, b, blat, blon, length, safety, name, flags); name is a code."""
    return edges.groupBy("district").applyInPandas(lambda g: _records(g, MAGIC, _EDGE), "district long, packed binary")


def encode_short(edges: DataFrame) -> DataFrame:
    """(district, packed) in records of 12 bytes, from (district, a, alat, alon, b, blat, blon, length, safety)."""
    return edges.groupBy("district").applyInPandas(lambda g: _records(g, SHORT_MAGIC, _SHORT), "district long, packed binary")


def _decode_short(batches):
    for batch in batches:
        for district, data in zip(batch["district"], batch["packed"], strict=True):
            if data is None or data[:4] != SHORT_MAGIC:
                continue
            head = np.frombuffer(data, _HEAD, 1)[0]
            nodes = np.frombuffer(data, _NODE, head["n"], _HEAD.itemsize)
            e = np.frombuffer(data, _SHORT, head["m"], _HEAD.itemsize + nodes.nbytes)
            lat, lon = head["lat"] + nodes["lat"] / 1e6, head["lon"] + nodes["lon"] / 1e6
            at = {f"{x}{c}": v[e[x]] for x in "ab" for c, v in (("lat", lat), ("lon", lon))}
            yield pd.DataFrame({"district": district, "a": e["a"].astype("int64"), "b": e["b"].astype("int64"), **at, "length": e["length"] / 10.0, "safety": e["safety"] / 1000.0})


def decode_short(packed: DataFrame) -> DataFrame:
    """Roads of networks in records of 12 bytes; nodes are numbered by id. A value with another header is skipped."""
    return packed.select("district", "packed").mapInPandas(_decode_short, "district long, a long, b long, alat double, alon double, blat double, blon double, length double, safety double")


def bundle(edges: DataFrame, boxes: DataFrame, shape: DataFrame) -> DataFrame:
    """(district, text): a district's network, its meta data and an outline (i, x, y) as one JSON text.

    boxes: (district, south, west, north, east); a district without one has a null box.
    """
    ends = edges.select("district", F.explode(F.array("a", "b")).alias("id")).distinct().groupBy("district").agg(F.count("*").alias("nodes"))
    counts = edges.groupBy("district").agg(F.count("*").alias("edges")).join(ends, "district")
    line = shape.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("shape"))
    rows = encode_short(edges).join(counts, "district").join(boxes.select("district", F.array("south", "west", "north", "east").alias("bbox")), "district", "left")
    meta = F.struct(F.col("district").alias("key"), "bbox", "nodes", "edges").alias("meta")
    return rows.crossJoin(F.broadcast(line)).select("district", F.to_json(F.struct(meta, "shape", F.base64("packed").alias("b64"))).alias("text"))


def read_bundle(texts: DataFrame) -> DataFrame:
    """(district, meta, shape, packed) of bundles; a text that is none gives nulls and no network."""
    found = texts.select(F.from_json("text", BUNDLE).alias("x"))
    return found.select(F.col("x.meta.key").alias("district"), "x.meta", "x.shape", F.unbase64(F.regexp_replace("x.b64", "\\s", "")).alias("packed"))


def _decode(batches):
    for batch in batches:
        for district, data in zip(batch["district"], batch["packed"], strict=True):
            head = np.frombuffer(data, _HEAD, 1)[0]
            if head["magic"] != MAGIC:
                continue
            nodes = np.frombuffer(data, _NODE, head["n"], _HEAD.itemsize)
            e = np.frombuffer(data, _EDGE, head["m"], _HEAD.itemsize + nodes.nbytes)
            lat, lon = head["lat"] + nodes["lat"] / 1e6, head["lon"] + nodes["lon"] / 1e6
            yield pd.DataFrame({"district": district, "a": e["a"].astype("int64"), "b": e["b"].astype("int64"), "alat": lat[e["a"]], "alon": lon[e["a"]], "length": e["length"] / 10.0, "safety": e["safety"] / 1000.0, "flags": e["flags"].astype("int64")})


def decode(packed: DataFrame) -> DataFrame:
    """Edges of packed networks; a value with another header is skipped."""
    return packed.select("district", "packed").mapInPandas(_decode, "district long, a long, b long, alat double, alon double, length double, safety double, flags long")


def from_base64(texts: DataFrame, column: str) -> DataFrame:
    return texts.withColumn("packed", F.unbase64(column))
