"""Measures of closed polygons held as arrays of (x, y) structs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import polygons as kernels


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _apart(p: Column) -> tuple[Column, Column]:
    return F.transform(p, lambda v: v["x"].cast("int")), F.transform(p, lambda v: v["y"].cast("int"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _turned(p: Column) -> Column:
    """The vertices from the second on, then the first: each vertex's successor."""
    return F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))


def _edges(p: Column, value) -> Column:
    return F.zip_with(p, _turned(p), value)


def cross(a: Column, b: Column) -> Column:
    return a["x"].cast("double") * b["y"] - b["x"].cast("double") * a["y"]


def signed_area(p: Column) -> Column:
    return _sum(_edges(p, cross)) / 2


def area(p: Column) -> Column:
    """Absolute shoelace area."""
    return F.abs(signed_area(p))


def perimeter(p: Column) -> Column:
    """Length of the closed outline."""
    return _sum(_edges(p, lambda a, b: F.sqrt(F.pow((a["x"] - b["x"]).cast("double"), F.lit(2)) + F.pow((a["y"] - b["y"]).cast("double"), F.lit(2)))))


def bounds(p: Column) -> Column:
    """min_x, min_y, width and height in pixels (both ends count)."""
    xs, ys = F.transform(p, lambda v: v["x"]), F.transform(p, lambda v: v["y"])
    return F.struct(
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
        (F.array_max(xs) - F.array_min(xs) + 1).alias("width"), (F.array_max(ys) - F.array_min(ys) + 1).alias("height"),
    )


def centroid(p: Column) -> Column:
    """Centre of the area, or of the bounding box where the area is zero."""
    a = signed_area(p)
    cx = _sum(_edges(p, lambda u, v: (u["x"] + v["x"]) * cross(u, v)))
    cy = _sum(_edges(p, lambda u, v: (u["y"] + v["y"]) * cross(u, v)))
    b = bounds(p)
    return F.when(a != 0, F.struct((cx / (6 * a)).alias("x"), (cy / (6 * a)).alias("y"))).otherwise(
        F.struct((b["min_x"] + F.floor(b["width"] / 2)).cast("double").alias("x"), (b["min_y"] + F.floor(b["height"] / 2)).cast("double").alias("y")))


def technical(p: Column) -> Column:
    """length: greatest less least y; width: greatest extent in x of vertices at one y."""
    ys = F.array_distinct(F.transform(p, lambda v: v["y"]))

    def extent(y: Column) -> Column:
        xs = F.transform(F.filter(p, lambda v: v["y"] == y), lambda v: v["x"])
        return F.array_max(xs) - F.array_min(xs)

    return F.struct((F.array_max(ys) - F.array_min(ys)).cast("double").alias("length"), F.array_max(F.transform(ys, extent)).cast("double").alias("width"))


def longest_chord(p: Column) -> Column:
    """d2, i, j of the farthest pair of vertices; among equals the first in pair order. In Arrow batches, over hull corners."""
    return kernels.chord_of(*_apart(p))


def max_dimensions(p: Column) -> Column:
    """length of the longest chord, and width: the greatest distance of a vertex from its line."""
    def measured(c: Column) -> Column:
        a, b = F.get(p, c["i"]), F.get(p, c["j"])
        off = F.transform(p, lambda v: F.abs((b["x"] - a["x"]).cast("double") * (v["y"] - a["y"]) - (b["y"] - a["y"]).cast("double") * (v["x"] - a["x"])))
        return F.struct(F.sqrt(c["d2"]).alias("length"), F.when(c["d2"] > 0, F.array_max(off) / F.sqrt(c["d2"])).otherwise(0.0).alias("width"))

    return _let(longest_chord(p), measured)


def contains(p: Column, x: Column, y: Column) -> Column:
    """True if (x, y) is inside the polygon or on its outline."""
    def crosses(a: Column, b: Column) -> Column:
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]).cast("double") * (y - a["y"]) / F.nullif((b["y"] - a["y"]).cast("double"), F.lit(0.0)) + a["x"]
        return F.when(spans & (x < at), 1.0).otherwise(0.0)

    def on(a: Column, b: Column) -> Column:
        flat = (b["x"] - a["x"]).cast("double") * (y - a["y"]) - (b["y"] - a["y"]).cast("double") * (x - a["x"]) == 0
        return flat & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return (_sum(_edges(p, crosses)) % 2 == 1) | F.exists(_edges(p, on), lambda v: v)


def hull(p: Column) -> Column:
    """Convex hull of the points, counter-clockwise from the least (x, y), in Arrow batches."""
    return kernels.hull_of(*_apart(p))


def distance(p: Column, q: Column) -> Column:
    """Distance of two polygons, 0 where outlines meet or one holds the other, in Arrow batches."""
    return kernels.distance_of(*_apart(p), *_apart(q))


def enclosed(p: Column) -> Column:
    """Area of what an outline encloses, its crossings repaired: of a figure of eight the larger loop."""
    return kernels.enclosed_of(*_apart(p))


def halves(p: Column, x: Column, y: Column) -> Column:
    """top_area, bottom_area, left_area and right_area: filled pixels on the sides of the truncated (x, y)."""
    return kernels.halves_of(*_apart(p), x.cast("int"), y.cast("int"))


def runs(p: Column) -> Column:
    """y, x0 and x1 of the runs of pixels inside a polygon or on its outline, as three arrays, row by row."""
    return kernels.runs_of(*_apart(p))


def arrow(p: Column, least: Column, low: float, high: float) -> Column:
    """The arrow of a contour (arrow_angle null if none), within limits min_area, min_depth and min_height and of solidity."""
    return kernels.arrow_of(*_apart(p), least, F.lit(low), F.lit(high))


def site_cells(p: Column, sites: Column) -> Column:
    """site_id, area and shared_edges of the parts of a contour nearest to each of the sites (site_id, sx, sy)."""
    of = lambda c, kind: F.transform(sites, lambda s: s[c].cast(kind))
    return kernels.cells_of(*_apart(p), of("site_id", "bigint"), of("sx", "double"), of("sy", "double"))


def solidity(p: Column) -> Column:
    """Area over hull area, from 0 to 1; null under three points or without a hull area."""
    return _let(hull(p), lambda h: F.when((F.size(p) >= 3) & (area(h) > 0), F.least(F.lit(1.0), area(p) / area(h))))


def lateral_distance(p: Column) -> Column:
    """From the middle of the longest chord to the lowest vertex (greatest y; of several the middle one by x)."""
    def measured(c: Column) -> Column:
        a, b = F.get(p, c["i"]), F.get(p, c["j"])
        low = F.array_max(F.transform(p, lambda v: v["y"]))
        xs = F.sort_array(F.transform(F.filter(p, lambda v: v["y"] == low), lambda v: v["x"]))
        x = F.get(xs, F.floor(F.size(xs) / 2).cast("int"))
        return F.sqrt(F.pow((a["x"] + b["x"]) / 2 - x, F.lit(2)) + F.pow((a["y"] + b["y"]) / 2 - low, F.lit(2)))

    return _let(longest_chord(p), measured)


def polygons(vertices):
    """One row a contour from its vertices (image_id, contour_id, i, x, y), in order of i."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    return vertices.groupBy("image_id", "contour_id").agg(points.alias("contour"))
