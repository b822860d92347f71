"""Geodesy and small numeric rules as Column expressions. Points are (lat, lon) in degrees."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Mean radius of the earth in metres.
RADIUS = 6371008.8


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    a, b, c, d = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(h))


@F.pandas_udf(DoubleType())
def distance_udf(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    a, b, c, d = (np.radians(x.to_numpy(dtype=float)) for x in (lat1, lon1, lat2, lon2))
    square = lambda x: np.array([math.pow(v, 2) for v in x.tolist()], dtype=float)
    cosine = lambda x: np.array([math.cos(v) for v in x.tolist()], dtype=float)
    sine = lambda x: np.array([math.sin(v) for v in x.tolist()], dtype=float)
    h = square(sine((c - a) / 2)) + cosine(a) * cosine(c) * square(sine((d - b) / 2))
    return pd.Series(2 * RADIUS * np.array([math.asin(v) for v in np.minimum(1.0, np.sqrt(h)).tolist()], dtype=float))


def distance(lat1, lon1, lat2, lon2) -> Column:
    """haversine() to the last digit of the C library, which SQL engines use and the JVM does not.

    For lengths that are compared or rounded: the JVM's sin, cos, asin and pow differ from the C library's in the last digit
    of about one value in a thousand, which decides near ties. It costs a pass through Python; distances that are only
    compared with a reach stay with haversine().
    """
    return distance_udf(*(_col(x) for x in (lat1, lon1, lat2, lon2)))


def enu(lat0, lon0, lat, lon) -> tuple[Column, Column]:
    """Metres east and north of an origin, on its tangent plane."""
    lat0, lon0, lat, lon = map(_col, (lat0, lon0, lat, lon))
    return F.radians(lon - lon0) * RADIUS * F.cos(F.radians(lat0)), F.radians(lat - lat0) * RADIUS


def enu_inverse(lat0, lon0, east, north) -> tuple[Column, Column]:
    """The point that lies so many metres east and north of an origin."""
    lat0, lon0, east, north = map(_col, (lat0, lon0, east, north))
    return lat0 + F.degrees(north / RADIUS), lon0 + F.degrees(east / (RADIUS * F.cos(F.radians(lat0))))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Direction of travel in degrees, 0 north, clockwise, below 360."""
    a, b, c, d = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(d - b) * F.cos(c)
    x = F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b)
    return (F.degrees(F.atan2(y, x)) + 360.0) % 360.0


def turn_angle(before: Column, after: Column) -> Column:
    """Signed change of direction, -180 to 180; right is positive."""
    return (after - before + 540.0) % 360.0 - 180.0


def turn_action(before: Column, after: Column) -> Column:
    """straight below 25 degrees, uturn above 150, else left or right."""
    angle = turn_angle(before, after)
    return F.when(F.abs(angle) < 25, "straight").when(F.abs(angle) > 150, "uturn").when(angle > 0, "right").otherwise("left")


def band(value: Column, good, bad) -> Column:
    """1 at ``good`` or better, 0 at ``bad`` or worse, linear between, in either direction; a step where they are equal."""
    good, bad = _col(good), _col(bad)
    step = F.when(value <= good, 1.0).otherwise(0.0)
    return F.when(good == bad, step).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (bad - value) / (bad - good))))


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def map_scale_mm(metres: Column, scale: float = 25000.0) -> Column:
    """Length on a printed map."""
    return metres / scale * 1000.0
