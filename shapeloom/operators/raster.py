"""Outlines from small grey rasters, by NumPy in pandas batches: one image is one row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def binarise(grey: np.ndarray) -> np.ndarray:
    """Dark pixels: below the mean of median and minimum, held between 60 and 200."""
    return grey < min(200.0, max(60.0, (float(np.sort(grey, axis=None)[grey.size // 2]) + float(grey.min())) / 2))


def dilate(mask: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        p = np.pad(mask, 1)
        mask = np.logical_or.reduce([p[y : y + mask.shape[0], x : x + mask.shape[1]] for y in range(3) for x in range(3)])
    return mask


def erode(mask: np.ndarray, times: int) -> np.ndarray:
    """What lies beyond the border counts as solid."""
    return ~dilate(~mask, times)


def flood(free: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Free pixels that are 4-connected with a seed."""
    # an image is one number, with a blocked column between its rows, so that a step is four shifts
    shape = (free.shape[0], free.shape[1] + 1)
    bits = lambda mask: int.from_bytes(np.packbits(np.pad(mask, ((0, 0), (0, 1))), bitorder="little").tobytes(), "little")
    room = bits(free)
    reached = bits(seeds) & room
    while True:
        grown = (reached | reached << 1 | reached >> 1 | reached << shape[1] | reached >> shape[1]) & room
        if grown == reached:
            break
        reached = grown
    packed = np.frombuffer(reached.to_bytes(-(-shape[0] * shape[1] // 8), "little"), np.uint8)
    return np.unpackbits(packed, count=shape[0] * shape[1], bitorder="little").reshape(shape)[:, :-1].astype(bool)


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes, largest 4-connected part only; of equal ones the first from the top left."""
    border = np.zeros_like(mask)
    border[[0, -1]] = True
    border[:, [0, -1]] = True
    solid, best = ~flood(~mask, border), np.zeros_like(mask)
    rest = solid.copy()
    while rest.any():
        seed = np.zeros_like(mask)
        seed.flat[np.flatnonzero(rest)[0]] = True
        part = flood(solid, seed)
        best = part if part.sum() > best.sum() else best
        rest &= ~part
    return best


_RING = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]


def boundary(mask: np.ndarray) -> list[tuple[int, int]]:
    """Moore's walk around the part, clockwise from its first pixel, as (y, x)."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return []
    p, start = np.pad(mask, 1), (int(ys[0]) + 1, int(xs[0]) + 1)
    at, back, path = start, 0, [start]
    for _ in range(4 * mask.size):
        for k in range(1, 9):
            way = (back + k) % 8
            y, x = at[0] + _RING[way][0], at[1] + _RING[way][1]
            if p[y, x]:
                at, back = (y, x), (way + 5) % 8 if way % 2 == 0 else (way + 4 + 1) % 8
                break
        else:
            break
        if at == start:
            break
        path.append(at)
    return [(y - 1, x - 1) for y, x in path]


def depths(points: np.ndarray) -> np.ndarray:
    """The eps of Douglas-Peucker below which each point stays; both ends always do.

    A chord is cut at its farthest point whatever eps is, so one walk over all cuts serves every eps: a point stays as
    long as it and all cuts above it lie farther away.
    """
    least = np.zeros(len(points))
    least[[0, -1]] = np.inf
    stack = [(0, len(points) - 1, np.inf)]
    while stack:
        a, b, above = stack.pop()
        if b - a < 2:
            continue
        line, span = points[b] - points[a], points[a + 1 : b] - points[a]
        size = float(np.hypot(*line))
        away = np.abs(line[0] * span[:, 1] - line[1] * span[:, 0]) / size if size else np.hypot(span[:, 0], span[:, 1])
        k = int(np.argmax(away))
        here = min(above, float(away[k]))
        if here > 0:
            least[a + 1 + k] = here
            stack += [(a, a + 1 + k, here), (a + 1 + k, b, here)]
    return least


def simplify(points: np.ndarray, eps: float) -> np.ndarray:
    """Douglas-Peucker: a point stays where it lies farther than eps from the chord."""
    return points[depths(points) > eps]


def to_points(points: np.ndarray, target: int) -> np.ndarray:
    """Simplified to about so many points: 28 halvings of eps, or fewer once within two."""
    low, high, least, eps = 0.0, float(np.ptp(points, axis=0).max() or 1), depths(points), -1.0
    for _ in range(28):
        eps = (low + high) / 2
        n = int((least > eps).sum())
        if abs(n - target) <= 2:
            break
        low, high = (eps, high) if n > target else (low, eps)
    return points[least > eps]


def trace(images: DataFrame, close: int = 1, target: int = 40) -> DataFrame:
    """(key, n_points, aspect, area) of the outline in each image (key, w, h, px: w*h grey bytes)."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, w, h, px in zip(batch["key"], batch["w"], batch["h"], batch["px"], strict=True):
                mask = filled(erode(dilate(binarise(np.frombuffer(px, np.uint8).reshape(h, w)), close), close))
                line = np.array(boundary(mask) or [(0, 0)], float)
                out = to_points(np.vstack([line, line[:1]]), target) if len(line) > 2 else line
                tall, wide = np.ptp(line, axis=0)
                rows.append((key, len(out), float(wide / tall) if tall else 1.0, int(mask.sum())))
            yield pd.DataFrame(rows, columns=["key", "n_points", "aspect", "area"])

    return images.select("key", "w", "h", "px").mapInPandas(run, "key long, n_points long, aspect double, area long")
