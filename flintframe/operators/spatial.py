"""Adjacency, containment, nearest-site cells and symmetry of contours of one image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import polygons as kernels

BORDER_DISTANCE = 10.0
#: Contours whose runs a task holds at a time.
CONTOURS_TOGETHER = 256


def _boxed(polygons: DataFrame, cell: int, reach: float) -> DataFrame:
    """polygons with their bounding box, filed under each grid cell that the box, grown by reach, touches."""
    b = G.bounds(F.col("contour"))
    own = polygons.select("image_id", "contour_id", "contour", b["min_x"].alias("x0"), b["min_y"].alias("y0"), (b["min_x"] + b["width"] - 1).alias("x1"), (b["min_y"] + b["height"] - 1).alias("y1"))
    at = lambda lo, hi: F.sequence(F.floor((F.col(lo) - reach) / cell), F.floor((F.col(hi) + reach) / cell))
    return own.withColumn("gx", F.explode(at("x0", "x1"))).withColumn("gy", F.explode(at("y0", "y1")))


def candidate_pairs(polygons: DataFrame, reach: float, cell: int = 128) -> DataFrame:
    """image_id, a, b (a < b): contours of an image whose boxes are within reach, found by shared grid cells."""
    half = _boxed(polygons, cell, reach / 2).drop("contour")
    a, b = half.alias("a"), half.alias("b")
    gap = lambda lo, hi: F.greatest(F.lit(0), F.col(f"a.{lo}") - F.col(f"b.{hi}"), F.col(f"b.{lo}") - F.col(f"a.{hi}"))
    near = (F.col("a.contour_id") < F.col("b.contour_id")) & (F.pow(gap("x0", "x1"), F.lit(2)) + F.pow(gap("y0", "y1"), F.lit(2)) <= reach * reach)
    joined = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy")) & near)
    return joined.select(F.col("a.image_id").alias("image_id"), F.col("a.contour_id").alias("a"), F.col("b.contour_id").alias("b")).distinct()


def _edges(p: Column) -> Column:
    return F.zip_with(p, F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1)), lambda u, v: F.struct(u.alias("u"), v.alias("v")))


def distances(polygons: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with the distance of their polygons: 0 where outlines cross or one holds the other."""
    one = polygons.select("image_id", F.col("contour_id").alias("a"), F.col("contour").alias("pa"))
    two = polygons.select("image_id", F.col("contour_id").alias("b"), F.col("contour").alias("pb"))
    both = pairs.join(one, ["image_id", "a"]).join(two, ["image_id", "b"])
    return both.select("image_id", "a", "b", G.distance(F.col("pa"), F.col("pb")).alias("distance"))


def scar_complexity(scars: DataFrame, threshold: float = BORDER_DISTANCE) -> DataFrame:
    """image_id, contour_id, scar_complexity: how many other scars of the image are within the threshold.

    A scar of fewer than three points has none and is nobody's neighbour.
    """
    fine = scars.where(F.size("contour") >= 3)
    near = distances(fine, candidate_pairs(fine, threshold)).where(F.col("distance") <= threshold)
    each = near.select("image_id", F.explode(F.array("a", "b")).alias("contour_id")).groupBy("image_id", "contour_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return scars.select("image_id", "contour_id").join(each, ["image_id", "contour_id"], "left").select("image_id", "contour_id", F.coalesce("n", F.lit(0)).alias("scar_complexity"))


def containing(points: DataFrame, polygons: DataFrame, cell: int = 128) -> DataFrame:
    """point_id -> the smallest polygon of the image that holds the point; points: image_id, point_id, x, y."""
    boxes = _boxed(polygons, cell, 0.0)
    at = points.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    held = at.join(boxes, ["image_id", "gx", "gy"]).where(inside).where(G.contains(F.col("contour"), F.col("x"), F.col("y")))
    best = held.groupBy("image_id", "point_id").agg(F.min(F.struct(G.area(F.col("contour")).alias("area"), F.col("contour_id").alias("contour_id"))).alias("best"))
    return best.select("image_id", "point_id", F.col("best.contour_id").alias("contour_id"))


def assign_arrows(candidates: DataFrame, scars: DataFrame) -> DataFrame:
    """Each candidate (image_id, point_id, x, y) to the smallest scar with its centre; the first wins a scar; cortex has none."""
    free = scars.where(~F.coalesce(F.col("is_cortex"), F.lit(False))) if "is_cortex" in scars.columns else scars
    return containing(candidates, free).groupBy("image_id", "contour_id").agg(F.min("point_id").alias("point_id"))


def _spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, CONTOURS_TOGETHER):
            part = batch.slice(k, CONTOURS_TOGETHER)
            xs, ys = part.column(2), part.column(3)
            sizes = pc.fill_null(pc.list_value_length(xs), 0).to_numpy()
            number, *run = kernels.runs(xs.flatten().to_numpy(), ys.flatten().to_numpy(), sizes)
            ids = [part.column(c).take(pa.array(number)) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(v, pa.int32()) for v in run)], ["image_id", "contour_id", "y", "x0", "x1"])


def spans(polygons: DataFrame) -> DataFrame:
    """image_id, contour_id, y, x0, x1: the runs of pixels inside or on the outline of each polygon, from left to right.

    A polygon is as many rows as it is high, not as it has pixels. Runs are found in Arrow batches, without a shuffle;
    those of CONTOURS_TOGETHER polygons are handed on before the next are made.
    """
    at = lambda c: F.transform("contour", lambda v: v[c].cast("int")).alias(f"{c}s")
    apart = polygons.select("image_id", "contour_id", at("x"), at("y"))
    ids = ", ".join(f"{c} {t}" for c, t in apart.dtypes[:2])
    return apart.mapInArrow(_spans_of, f"{ids}, y int, x0 int, x1 int")


def rasterize(polygons: DataFrame) -> DataFrame:
    """image_id, contour_id, x, y of all pixels inside or on the outline of each polygon: spans(), a row a pixel."""
    return spans(polygons).select("image_id", "contour_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def _as_runs(mask: DataFrame) -> DataFrame:
    """A mask of pixels (with x) as runs of one pixel each; runs as they are."""
    return mask if "x0" in mask.columns else mask.withColumnRenamed("x", "x0").withColumn("x1", F.col("x0"))


def span_areas(runs: DataFrame) -> DataFrame:
    """By contour: pixels, and the sums of their x and y."""
    n = (F.col("x1") - F.col("x0") + 1).cast("bigint")
    return runs.groupBy("image_id", "contour_id").agg(F.sum(n).alias("pixels"), F.sum(F.expr("(x0 + x1) * cast(x1 - x0 + 1 AS bigint) DIV 2")).alias("sx"), F.sum(n * F.col("y")).alias("sy"))


def span_overlaps(runs: DataFrame) -> DataFrame:
    """image_id, a, b (a < b), pixels: what two contours of an image have in common, by runs of the same row that overlap."""
    a, b = runs.alias("a"), runs.alias("b")
    both = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.contour_id") < F.col("b.contour_id")) & (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1")))
    n = (F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0") + 1).cast("bigint")
    return both.groupBy(F.col("a.image_id").alias("image_id"), F.col("a.contour_id").alias("a"), F.col("b.contour_id").alias("b")).agg(F.sum(n).alias("pixels"))


def union_spans(runs: DataFrame) -> DataFrame:
    """image_id, y, x0, x1: the runs of pixels that any contour of an image has."""
    line = Window.partitionBy("image_id", "y").orderBy("x0", "x1")
    far = F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.select("image_id", "y", "x0", "x1", F.when(F.col("x0") <= far + 1, 0).otherwise(1).alias("__new"))
    each = marked.withColumn("__run", F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return each.groupBy("image_id", "y", "__run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("__run")


def symmetry(runs: DataFrame, centres: DataFrame) -> DataFrame:
    """Filled pixels above, below, left and right of the truncated centroid, and both symmetries (two digits).

    runs: spans(), or pixels (with x); centres: image_id, contour_id, cx, cy.
    """
    runs = _as_runs(runs)
    c = centres.select("image_id", "contour_id", F.col("cx").cast("int").alias("cx"), F.col("cy").cast("int").alias("cy"))
    n = (F.col("x1") - F.col("x0") + 1).cast("bigint")
    left = F.greatest(F.lit(0), F.least(F.col("x1"), F.col("cx") - 1) - F.col("x0") + 1).cast("bigint")
    up = F.col("y") < F.col("cy")
    s = runs.join(c, ["image_id", "contour_id"]).groupBy("image_id", "contour_id").agg(
        F.sum(F.when(up, n).otherwise(0)).alias("top_area"), F.sum(F.when(up, 0).otherwise(n)).alias("bottom_area"), F.sum(left).alias("left_area"), F.sum(n - left).alias("right_area"))
    even = lambda p, q: F.round(1 - F.abs(F.col(p) - F.col(q)) / F.nullif(F.col(p) + F.col(q), F.lit(0)), 2)
    return s.withColumns({"vertical_symmetry": even("top_area", "bottom_area"), "horizontal_symmetry": even("left_area", "right_area")})


def cells(mask: DataFrame, sites: DataFrame) -> DataFrame:
    """image_id, y, x0, x1, site_id: runs of a mask (image_id, y, x0, x1) by nearest site (image_id, site_id, sx, sy; whole
    numbers), the smaller id on ties.

    In a row of pixels the part that is nearer to a site than to another begins or ends at one place, so a site has one
    stretch of each row, found from the other sites alone; it is cut with the runs. A mask of pixels (with x) gives pixels.
    """
    if "x" in mask.columns:
        return cells(_as_runs(mask), sites).select("image_id", F.col("x0").alias("x"), "y", "site_id")
    whole = sites.select("image_id", "site_id", F.col("sx").cast("bigint").alias("sx"), F.col("sy").cast("bigint").alias("sy"))
    other = whole.toDF("image_id", "__o", "__ox", "__oy")
    apart = whole.join(other, "image_id").where("site_id <> __o")
    lines = mask.select("image_id", "y").distinct()
    slope, more = 2 * (F.col("__ox") - F.col("sx")), F.when(F.col("__o") < F.col("site_id"), 1).otherwise(0)
    rest = F.col("__ox") * F.col("__ox") - F.col("sx") * F.col("sx") + F.pow(F.col("y") - F.col("__oy"), F.lit(2)).cast("bigint") - F.pow(F.col("y") - F.col("sy"), F.lit(2)).cast("bigint") - more
    bounds = lines.join(apart, "image_id").select("image_id", "y", "site_id", slope.alias("k"), rest.alias("r"))  # nearer where k * x <= r
    edge = bounds.groupBy("image_id", "y", "site_id").agg(
        F.min(F.when(F.col("k") > 0, F.floor(F.col("r") / F.col("k")))).alias("hi"), F.max(F.when(F.col("k") < 0, F.ceil(F.col("r") / F.col("k")))).alias("lo"), F.max((F.col("k") == 0) & (F.col("r") < 0)).alias("none"))
    alone = lines.join(whole.join(apart.select("image_id", "site_id").distinct(), ["image_id", "site_id"], "left_anti"), "image_id").select("image_id", "y", "site_id", F.lit(None).cast("bigint").alias("hi"), F.lit(None).cast("bigint").alias("lo"))
    edge = edge.where("not none").drop("none").unionByName(alone)
    cut = mask.join(edge, ["image_id", "y"]).withColumn("x0", F.greatest("x0", F.coalesce("lo", "x0")).cast("int")).withColumn("x1", F.least("x1", F.coalesce("hi", "x1")).cast("int"))
    return cut.where("x0 <= x1").select("image_id", "y", "x0", "x1", "site_id")


def cell_summary(labelled: DataFrame) -> DataFrame:
    """By site: pixels of its cell and how many other cells share an edge of a pixel with it; labelled: as of cells()."""
    labelled = _as_runs(labelled)
    n = (F.col("x1") - F.col("x0") + 1).cast("bigint")
    size = labelled.groupBy("image_id", "site_id").agg(F.sum(n).alias("voronoi_cell_area"))
    line = Window.partitionBy("image_id", "y").orderBy("x0")
    beside = labelled.select("image_id", "site_id", F.when(F.lead("x0").over(line) == F.col("x1") + 1, F.lead("site_id").over(line)).alias("other"))
    below = labelled.select("image_id", (F.col("y") - 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("site_id").alias("other"))
    under = labelled.join(below, ["image_id", "y"]).where("x0 <= u1 and u0 <= x1").select("image_id", "site_id", "other")
    both = beside.unionByName(under).where("other <> site_id").distinct()
    touching = both.unionByName(both.select("image_id", F.col("other").alias("site_id"), F.col("site_id").alias("other"))).distinct().groupBy("image_id", "site_id").agg(F.count(F.lit(1)).alias("shared_edges"))
    return size.join(touching, ["image_id", "site_id"], "left").fillna(0, ["shared_edges"])


def outline_cells(outlines: DataFrame, sites: DataFrame, alone: bool = True) -> DataFrame:
    """image_id, site_id, area, shared_edges: the part of the image's outline (image_id, contour) nearest to each site, where it has one.

    Cells are the outline cut by middle lines, exactly; sites: image_id, site_id, sx, sy. Of sites at one place the
    first by id has the cell. The only site of an image has all of the outline, or (alone false) no cell.
    """
    own = sites.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("site_id", "sx", "sy"))).alias("sites"))
    own = own if alone else own.where(F.size("sites") > 1)
    both = outlines.join(own, "image_id").select("image_id", F.explode(G.site_cells(F.col("contour"), F.col("sites"))).alias("c"))
    return both.select("image_id", "c.*")


def pixel_cells(polygons: DataFrame, sites: DataFrame) -> DataFrame:
    """By site: pixels of the image's polygons nearest to it (the smaller id on ties), and how many other cells touch them.

    An image is held as the runs of its pixels, and cells as the parts of these runs.
    """
    def run(shapes: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.dropna(subset=["sx", "sy"]).sort_values("site_id")
        sizes = np.array([0 if x is None else len(x) for x in shapes["xs"]], np.int64)
        if not sizes.sum() or not len(own):
            return pd.DataFrame(columns=["image_id", "site_id", "voronoi_cell_area", "shared_edges"])
        flat = lambda c: np.concatenate([np.asarray(v, np.int64) for v in shapes[c] if v is not None])
        _, y, x0, x1 = kernels.runs(flat("xs"), flat("ys"), sizes, np.zeros(len(sizes), np.int64))
        n, touch = kernels.cells_of_runs(y, x0, x1, own["sx"].to_numpy(), own["sy"].to_numpy())
        return pd.DataFrame({"image_id": own["image_id"], "site_id": own["site_id"], "voronoi_cell_area": n, "shared_edges": touch.sum(axis=1)})[n > 0]

    apart = polygons.select("image_id", F.transform("contour", lambda v: v["x"]).alias("xs"), F.transform("contour", lambda v: v["y"]).alias("ys"))
    own = sites.select("image_id", F.col("site_id").cast("bigint").alias("site_id"), F.col("sx").cast("double").alias("sx"), F.col("sy").cast("double").alias("sy"))
    return apart.groupBy("image_id").cogroup(own.groupBy("image_id")).applyInPandas(run, "image_id string, site_id bigint, voronoi_cell_area bigint, shared_edges bigint")


def hull_measures(sites: DataFrame) -> DataFrame:
    """By image: number of sites, width, height and area of their convex hull; a line has no area."""
    spots = sites.withColumns({c: F.round(F.col(c).cast("double") * 100).cast("int") for c in ("sx", "sy")})  # hundredths: hulls are of whole numbers
    points = spots.groupBy("image_id").agg(F.collect_list(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"))).alias("p"))
    b = G.bounds(F.col("p"))
    return points.select("image_id", F.size("p").alias("n_sites"), ((b["width"] - 1) / 100).alias("convex_hull_width"), ((b["height"] - 1) / 100).alias("convex_hull_height"), F.round(G.area(G.hull(F.col("p"))) / 10_000, 2).alias("convex_hull_area"))


def padded_bounds(polygons: DataFrame, padding: float = 0.02) -> DataFrame:
    """The bounding box of each contour, grown by a share of its size on all sides."""
    b = G.bounds(F.col("contour"))
    w, h = b["width"] - 1, b["height"] - 1
    return polygons.select("image_id", "contour_id", (b["min_x"] - padding * w).alias("x_min"), (b["min_x"] + w + padding * w).alias("x_max"), (b["min_y"] - padding * h).alias("y_min"), (b["min_y"] + h + padding * h).alias("y_max"))
