"""Outlines compared: equidistant resampling and the likeness of a route to its target, in batches of whole outlines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points that an outline is resampled to before it is compared, and the share of a shape's size at which it is lost.
SAMPLES, LOST = 240, 0.12
#: Distances of points from segments that are computed at once: a bound of a task's memory.
STEP = 1 << 16
_RADIUS = 6371008.8


def _metres(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle distances between points (lat, lon) of two arrays."""
    p, q = np.radians(a), np.radians(b)
    h = np.sin((q[..., 0] - p[..., 0]) / 2) ** 2 + np.cos(p[..., 0]) * np.cos(q[..., 0]) * np.sin((q[..., 1] - p[..., 1]) / 2) ** 2
    return 2 * _RADIUS * np.arcsin(np.sqrt(h))


def _straight(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.hypot(b[..., 0] - a[..., 0], b[..., 1] - a[..., 1])


def resample_all(lines: np.ndarray, n: int, distance=_metres) -> np.ndarray:
    """``n`` points at equal distances along each of some polylines of one number of points, their ends included.

    One point, or no length, is repeated.
    """
    count, size, _ = lines.shape
    if size < 2:
        return np.repeat(lines, n, axis=1)
    ends = np.concatenate([np.zeros((count, 1)), np.cumsum(distance(lines[:, :-1], lines[:, 1:]), axis=1)], axis=1)
    at = ends[:, -1:] / (n - 1) * np.arange(n)
    # the first segment whose end is not before the place
    k = np.minimum(np.stack([np.searchsorted(e, x, "left") for e, x in zip(ends[:, 1:], at, strict=True)]), size - 2)
    begin, end = np.take_along_axis(ends, k, 1), np.take_along_axis(ends, k + 1, 1)
    t = np.clip(np.divide(at - begin, end - begin, out=np.zeros((count, n)), where=end > begin), 0, 1)
    row = np.arange(count)[:, None]
    made = lines[row, k] + (lines[row, k + 1] - lines[row, k]) * t[:, :, None]
    return np.where(ends[:, -1, None, None] > 0, made, lines[:, :1])


def resample(points: np.ndarray, n: int, distance=_metres) -> np.ndarray:
    """``n`` points at equal distances along a polyline, its ends included. One point, or no length, is repeated."""
    return resample_all(points[None], n, distance)[0]


def to_polylines(points: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The distances of each row's points from that row's polyline, all in one plane."""
    (ax, ay), (dx, dy) = ((v[..., 0][:, None], v[..., 1][:, None]) for v in (lines[:, :-1], np.diff(lines, axis=1)))
    x, y = points[..., 0][:, :, None] - ax, points[..., 1][:, :, None] - ay
    size = dx * dx + dy * dy
    t = np.clip(np.divide(x * dx + y * dy, size, out=np.zeros_like(x), where=size > 0), 0, 1)
    return np.sqrt(((x - t * dx) ** 2 + (y - t * dy) ** 2).min(axis=2))


def apart_all(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half the mean and half the ninth decile of the distances of two outlines' points from each other, both ways, row by row."""
    ways = [np.sort(to_polylines(p, q), axis=1) for p, q in ((a, b), (b, a))]
    return sum(0.5 * w.mean(axis=1) + 0.5 * w[:, int(w.shape[1] * 0.9)] for w in ways) / 2


def apart(a: np.ndarray, b: np.ndarray) -> float:
    """apart_all() of one row."""
    return float(apart_all(a[None], b[None])[0])


def _errors(n: int):
    """The error of each row, for all rows with equal numbers of points at once, as many as STEP allows."""

    def run(lat: pd.Series, lon: pd.Series, target_lat: pd.Series, target_lon: pd.Series) -> pd.Series:
        sizes = np.array([lat.map(len), target_lat.map(len)]).T
        made, at_once = np.zeros(len(lat)), max(1, STEP // (n * n))
        kinds, which = np.unique(sizes, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        for alike in np.split(order, np.cumsum(np.bincount(which.ravel(), minlength=len(kinds)))[:-1]):
            for i in range(0, len(alike), at_once):
                rows = alike[i : i + at_once]
                lines = [np.stack([np.stack(ys.iloc[rows].to_list()), np.stack(xs.iloc[rows].to_list())], axis=2) for ys, xs in ((lat, lon), (target_lat, target_lon))]
                a, b = (resample_all(v, n) for v in lines)
                first = a[:, :1]
                scale = _RADIUS * np.concatenate([np.ones_like(first[..., :1]), np.cos(np.radians(first[..., :1]))], axis=2)
                made[rows] = apart_all(np.radians(a - first) * scale, np.radians(b - first) * scale)
        return pd.Series(made)

    return run


def _resampled(points: pd.Series, n: pd.Series) -> pd.Series:
    made = [resample(np.array([(p["x"], p["y"]) for p in rows], float), int(k), _straight) for rows, k in zip(points, n, strict=True)]
    return pd.Series([[{"x": x, "y": y} for x, y in rows.tolist()] for rows in made])


def error(route: Column, target: Column, n: int = SAMPLES) -> Column:
    """Metres between two arrays of (lat, lon), resampled to ``n`` points, on the tangent plane of the route's first point."""
    each = lambda line, c: F.transform(line, lambda p: p[c])
    return F.pandas_udf(_errors(n), "double")(each(route, "lat"), each(route, "lon"), each(target, "lat"), each(target, "lon"))


def resampled(points: Column, n: int) -> Column:
    """``n`` equidistant points of an array of (x, y)."""
    return F.pandas_udf(_resampled, "array<struct<x:double,y:double>>")(points, F.lit(n))


def fidelity(metres: Column, size: Column) -> Column:
    """1 for a route that covers its target, 0 from LOST of the shape's size on."""
    return F.greatest(F.lit(0.0), 1.0 - metres / (LOST * size))
