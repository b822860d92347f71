"""Strings, flags and small display rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """user_ and the text's letters, digits and CJK, other runs as _, 40 characters; a hash where nothing is left."""
    plain = F.trim(F.regexp_replace(text, "[^0-9A-Za-z一-鿿]+", "_"), F.lit("_"))
    return F.concat(F.lit("user_"), F.when(plain == "", F.substring(F.sha1(text), 1, 8)).otherwise(F.substring(plain, 1, 40)))


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def pack_flags(cls: Column, lit: Column) -> Column:
    return cls.bitwiseOR(F.shiftleft(lit, 5))


def unpack_flags(flags: Column) -> tuple[Column, Column]:
    return flags.bitwiseAND(F.lit(31)).alias("cls"), F.shiftright(flags, 5).bitwiseAND(F.lit(3)).alias("lit")


def parse_point(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, ",")
    return F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")


def luma(red: Column, green: Column, blue: Column) -> Column:
    return 0.299 * red + 0.587 * green + 0.114 * blue


def vertices(vectors: DataFrame) -> DataFrame:
    """(vec_id, i, x, y): a vector's values two by two, i from 1."""
    rows = vectors.select("vec_id", "embedding", F.explode(F.sequence(F.lit(1), F.floor(F.size("embedding") / 2).cast("int"))).alias("i"))
    return rows.select("vec_id", "i", F.get("embedding", F.col("i") * 2 - 2).cast("double").alias("x"), F.get("embedding", F.col("i") * 2 - 1).cast("double").alias("y"))
