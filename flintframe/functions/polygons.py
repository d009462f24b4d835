"""Polygon kernels for column expressions: one contour, as arrays of x and y, at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import planar, rasters


def _row(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners of the convex hull, counter-clockwise (y up) from the least (x, y); points on its sides are left out."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered
    sides = []
    for part in (ordered, ordered[::-1]):
        side: list[tuple[int, int]] = []
        for x, y in part:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (y - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (x - side[-2][0]):
                side.pop()
            side.append((x, y))
        sides += side[:-1]
    return sides


def antipodal(corners: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Pairs of corners of a convex ring that parallel lines can hold it between; the farthest pairs are among them.

    Going around, the corner that is farthest from a side only moves on; where a side is parallel to the next one there,
    both its ends count.
    """
    n = len(corners)
    if n < 3:
        return {(i, j) for i in range(n) for j in range(i, n)}
    found, k = set(), 1
    off = lambda a, b, c: abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    for i in range(n):
        a, b = corners[i], corners[(i + 1) % n]
        while off(a, b, corners[(k + 1) % n]) > off(a, b, corners[k % n]):
            k += 1
        also = (k, k + 1) if off(a, b, corners[(k + 1) % n]) == off(a, b, corners[k % n]) else (k,)
        found |= {tuple(sorted((p % n, q % n))) for p in (i, i + 1) for q in also}
    return found


def chord(points: list[tuple[int, int]]) -> tuple[float, int, int]:
    """Squared length and ends of the farthest pair of vertices; of equals the first pair in order. Ends are hull corners."""
    first: dict[tuple[int, int], int] = {}
    for k, p in enumerate(points):
        first.setdefault(p, k)
    corners = hull(points)
    d2 = lambda i, j: (corners[i][0] - corners[j][0]) ** 2 + (corners[i][1] - corners[j][1]) ** 2
    least, i, j = min((-d2(i, j), *sorted((first[corners[i]], first[corners[j]]))) for i, j in antipodal(corners))
    return float(-least), i, j


def area(points: list[tuple[int, int]]) -> float:
    p = np.asarray(points, float).reshape(-1, 2)
    q = np.roll(p, -1, axis=0)
    return abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())) / 2


def solidity(points: list[tuple[int, int]]) -> float | None:
    """Area over hull area, from 0 to 1; None under three points or without a hull area."""
    around = area(hull(points)) if len(points) >= 3 else 0.0
    return min(1.0, area(points) / around) if around > 0 else None


def defects(points: list[tuple[int, int]]) -> list[tuple[float, int]]:
    """Depth (in 1/256 px) and place of the farthest vertex between each two following hull vertices, deepest first."""
    corners, n = set(hull(points)), len(points)
    marks = [k for k, p in enumerate(points) if p in corners]
    p, found = np.asarray(points, float), []
    for k, i in enumerate(marks):
        j = marks[(k + 1) % len(marks)]
        (ax, ay), (bx, by) = points[i], points[j]
        length = math.hypot(bx - ax, by - ay)
        at = (i + np.arange(1, (j - i) % n)) % n
        if len(at) and length > 0:
            off = np.abs((bx - ax) * (p[at, 1] - ay) - (by - ay) * (p[at, 0] - ax))
            depth = np.floor(off / length * 256) / 256
            found.append((float(depth.max()), int(at[depth == depth.max()].min())))
    return sorted(found, key=lambda d: (-d[0], d[1]))


def arrow(points: list[tuple[int, int]], least_area: float, least_depth: float, least_height: float, solid: tuple[float, float], side: int = 5) -> tuple | None:
    """Angle, tip, back, base and height of the triangle that the two deepest defects cut off, and solidity of shaft and tip.

    Vertices on the more solid side of the base (the second on a tie) are the shaft; the tip is the vertex of the other
    side farthest from the middle of the base. None if the contour is too small, too frayed, or has no such parts.
    """
    own = solidity(points)
    if own is None or area(points) < least_area or not solid[0] <= own <= solid[1]:
        return None
    deep = [k for d, k in defects(points) if d > least_depth]
    if len(deep) < 2:
        return None
    (ax, ay), (bx, by) = points[deep[0]], points[deep[1]]
    mx, my = (ax + bx) // 2, (ay + by) // 2
    parts: tuple[list, list] = ([], [])
    for x, y in points:
        parts[int((x - mx) * (ay - by) + (y - my) * (bx - ax) <= 0)].append((x, y))
    if min(map(len, parts)) < side:
        return None
    one, two = (solidity(p) or 0.0 for p in parts)
    tips = parts[1] if one > two else parts[0]
    tx, ty = max(tips, key=lambda v: (v[0] - mx) ** 2 + (v[1] - my) ** 2)
    height = math.hypot(tx - mx, ty - my)
    if height < least_height:
        return None
    compass = (270 + math.degrees(math.atan2(my - ty, mx - tx)) % 360) % 360
    return float(round(round(compass, 1))), tx, ty, mx, my, math.hypot(bx - ax, by - ay), height, max(one, two), min(one, two)


def _pairs(xs: pd.Series, ys: pd.Series) -> Iterator[list[tuple[int, int]] | None]:
    for x, y in zip(xs, ys, strict=True):
        yield None if x is None or y is None or not len(x) else list(zip(np.asarray(x).tolist(), np.asarray(y).tolist(), strict=True))


@F.pandas_udf(T.ArrayType(_row(x=T.IntegerType(), y=T.IntegerType())))
def hull_of(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([[] if p is None else [{"x": int(x), "y": int(y)} for x, y in hull(p)] for p in _pairs(xs, ys)], dtype=object)


@F.pandas_udf(_row(d2=T.DoubleType(), i=T.IntegerType(), j=T.IntegerType()))
def chord_of(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, None, None) if p is None else chord(p) for p in _pairs(xs, ys)], columns=["d2", "i", "j"])


@F.pandas_udf(T.DoubleType())
def distance_of(xs: pd.Series, ys: pd.Series, us: pd.Series, vs: pd.Series) -> pd.Series:
    """Distances of what the outlines enclose; the sides of an outline that comes in many pairs are found once."""
    known: dict[tuple, np.ndarray] = {}

    def figure(p: list[tuple[int, int]]) -> np.ndarray:
        key = tuple(p)
        if key not in known:
            known[key] = planar.repaired(p)
        return known[key]

    return pd.Series([None if p is None or q is None else planar.distance(figure(p), figure(q)) for p, q in zip(_pairs(xs, ys), _pairs(us, vs), strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def enclosed_of(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else planar.area(planar.repaired(p)) for p in _pairs(xs, ys)], dtype=float)


@F.pandas_udf(_row(top_area=T.LongType(), bottom_area=T.LongType(), left_area=T.LongType(), right_area=T.LongType()))
def halves_of(xs: pd.Series, ys: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.DataFrame:
    """Filled pixels above and not above cy, left and not left of cx."""
    out = []
    for p, x, y in zip(_pairs(xs, ys), cx, cy, strict=True):
        if p is None or pd.isna(x) or pd.isna(y):
            out.append((None,) * 4)
            continue
        x0, y0 = min(a for a, _ in p), min(b for _, b in p)
        mask = rasters.filled(p, x0, y0, max(a for a, _ in p) - x0 + 1, max(b for _, b in p) - y0 + 1)
        rows, columns, every = mask.sum(axis=1), mask.sum(axis=0), int(mask.sum())
        top, left = int(rows[: max(0, int(y) - y0)].sum()), int(columns[: max(0, int(x) - x0)].sum())
        out.append((top, every - top, left, every - left))
    return pd.DataFrame(out, columns=["top_area", "bottom_area", "left_area", "right_area"])


def runs(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """number, y, x0 and x1 of the runs of pixels inside polygons or on their outlines, by number and from left to right.

    Vertices of all polygons follow each other, as many as sizes says of each. Polygons of one owner are one area.
    Nothing has more room than the rows of pixels that sides cross.
    """
    x, y, sizes = np.asarray(x, np.int64), np.asarray(y, np.int64), np.asarray(sizes, np.int64)
    if not len(x):
        return (np.empty(0, np.int64),) * 4
    of, after, last = np.repeat(np.arange(len(sizes)), sizes), np.arange(1, len(x) + 1), np.cumsum(sizes)
    after[last[sizes > 0] - 1] = (last - sizes)[sizes > 0]
    right, down = x[after] - x, y[after] - y
    flat = down == 0
    tall = np.where(flat, 0, np.abs(down) + 1)
    side = np.repeat(np.arange(len(x)), tall)
    row = np.arange(len(side)) - np.repeat(np.cumsum(tall) - tall, tall) + np.minimum(y, y[after])[side]
    far = right[side] * (row - y[side])
    at, exact = x[side] + far // down[side], far % down[side] == 0
    half = row < np.maximum(y, y[after])[side]
    line, level, cut = of[side][half], row[half], (at + ~exact)[half]
    order = np.lexsort((cut, level, line))
    into, out = order[::2], order[1::2]
    number = np.concatenate([line[into], of[side][exact], of[flat]])
    level = np.concatenate([level[into], row[exact], y[flat]])
    x0, x1 = np.concatenate([cut[into], at[exact], np.minimum(x, x[after])[flat]]), np.concatenate([cut[out] - 1, at[exact], np.maximum(x, x[after])[flat]])
    return joined_runs(number if owner is None else np.asarray(owner)[number], level, x0, x1)


def joined_runs(number: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order, those of a number and row that overlap or touch as one; empty ones go."""
    own = np.nonzero(x0 <= x1)[0]
    own = own[np.lexsort((x0[own], y[own], number[own]))]
    if not len(own):
        return (np.empty(0, np.int64),) * 4
    number, y, x0, x1 = number[own], y[own], x0[own], x1[own]
    line = np.concatenate([[0], np.cumsum((np.diff(number) != 0) | (np.diff(y) != 0))])
    least = x0.min()
    base = line * (x1.max() - least + 3) - least
    far = np.maximum.accumulate(base + x1)
    begin = np.concatenate([[0], np.nonzero((base + x0)[1:] > far[:-1] + 1)[0] + 1])
    end = np.concatenate([begin[1:], [len(own)]]) - 1
    return number[begin], y[begin], x0[begin], far[end] - base[end]


def cells_of_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels that are nearest to each site (to the first on ties), and which two sites have pixels beside each other.

    y, x0, x1: runs that do not overlap, by row and from left to right. In a row the pixels that are nearer to one site
    than to another begin or end at one place, so a site has one stretch of each row. Sites that are not at whole
    numbers, where that place is subject to rounding, are compared pixel by pixel.
    """
    count = len(sx)
    rows, row = np.unique(y, return_inverse=True)
    if (sx == np.floor(sx)).all() and (sy == np.floor(sy)).all():
        found = []
        for k in range(count):
            lo, hi = np.full(len(rows), float(x0.min())), np.full(len(rows), float(x1.max()))
            for o in range(count):
                slope = 2 * (sx[o] - sx[k])
                rest = sx[o] ** 2 - sx[k] ** 2 + (rows - sy[o]) ** 2 - (rows - sy[k]) ** 2 - (o < k)  # nearer where slope * x <= rest
                if slope > 0:
                    hi = np.minimum(hi, rest // slope)
                elif slope < 0:
                    lo = np.maximum(lo, -(rest // -slope))
                elif o != k:
                    hi = np.where(rest < 0, -np.inf, hi)
            a, b = np.maximum(x0, lo[row]), np.minimum(x1, hi[row])
            own = np.nonzero(a <= b)[0]
            found.append((row[own], a[own].astype(np.int64), b[own].astype(np.int64), np.full(len(own), k)))
        row, a, b, site = (np.concatenate(v) for v in zip(*found, strict=True))
    else:
        n = x1 - x0 + 1
        row = np.repeat(row, n)
        a = b = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(x0, n)
        best, site = np.full(len(row), np.inf), np.zeros(len(row), np.int64)
        for k in range(count):
            d2 = (a - sx[k]) ** 2.0 + ((rows - sy[k]) ** 2.0)[row]
            near = d2 < best
            best[near], site[near] = d2[near], k
    order = np.lexsort((a, row))
    row, a, b, site = row[order], a[order], b[order], site[order]
    area = np.zeros(count, np.int64)
    np.add.at(area, site, b - a + 1)
    touch = np.zeros((count, count), bool)
    beside = np.nonzero((row[1:] == row[:-1]) & (a[1:] == b[:-1] + 1))[0]
    touch[site[beside], site[beside + 1]] = touch[site[beside + 1], site[beside]] = True
    wide, least = b.max() - a.min() + 3, a.min()
    start, end, under = row * wide + a - least, row * wide + b - least, np.isin(rows[row] + 1, rows) * wide
    first, last = np.searchsorted(end, start + under), np.searchsorted(start, end + under, side="right")
    n = np.where(under > 0, np.maximum(last - first, 0), 0)
    one = np.repeat(np.arange(len(a)), n)
    two = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(one))
    touch[site[one], site[two]] = touch[site[two], site[one]] = True
    np.fill_diagonal(touch, False)
    return area, touch


@F.pandas_udf(_row(y=T.ArrayType(T.IntegerType()), x0=T.ArrayType(T.IntegerType()), x1=T.ArrayType(T.IntegerType())))
def runs_of(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    """Runs of pixels of each polygon, row by row."""
    out = []
    for x, y in zip(xs, ys, strict=True):
        n = 0 if x is None or y is None else len(x)
        out.append(tuple(v.astype(np.int32) for v in runs(x if n else (), y if n else (), [n])[1:]))
    return pd.DataFrame(out, columns=["y", "x0", "x1"])


_ARROW = ("arrow_angle", "tip_x", "tip_y", "back_x", "back_y", "triangle_base_length", "triangle_height", "shaft_solidity", "tip_solidity")


@F.pandas_udf(_row(**dict.fromkeys(_ARROW, T.DoubleType())))
def arrow_of(xs: pd.Series, ys: pd.Series, least: pd.DataFrame, low: pd.Series, high: pd.Series) -> pd.DataFrame:
    """least: min_area, min_depth and min_height of each contour."""
    limits = least[["min_area", "min_depth", "min_height"]].itertuples(index=False)
    found = [None if p is None else arrow(p, *t, (lo, hi)) for p, t, lo, hi in zip(_pairs(xs, ys), limits, low, high, strict=True)]
    return pd.DataFrame([(None,) * len(_ARROW) if f is None else f for f in found], columns=list(_ARROW), dtype=float)


@F.pandas_udf(T.ArrayType(_row(site_id=T.LongType(), area=T.DoubleType(), shared_edges=T.IntegerType())))
def cells_of(xs: pd.Series, ys: pd.Series, ids: pd.Series, sx: pd.Series, sy: pd.Series) -> pd.Series:
    out = []
    for p, own, u, v in zip(_pairs(xs, ys), ids, sx, sy, strict=True):
        made = [] if p is None else planar.cells(p, list(zip(np.asarray(u, float).tolist(), np.asarray(v, float).tolist(), strict=True)))
        out.append([{"site_id": int(k), "area": a, "shared_edges": n} for k, (a, n) in zip(own, made, strict=False) if a > 0])
    return pd.Series(out, dtype=object)
