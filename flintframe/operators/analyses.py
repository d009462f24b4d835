"""What a run finds out about each lithic beyond its measures: cortex, borders, symmetry, cells, lateral shape, arrows.

Inputs are surfaces (a row a parent, with surface_type) and features (a row a child, with surface_type of its parent and
surface_feature), both with contour. Each step returns its input with columns added; rows it does not speak of have null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import arrows, spatial, surfaces


def _only(rows: DataFrame, kind: str) -> DataFrame:
    """The first row of this surface type of each image."""
    first = F.min("contour_id").over(Window.partitionBy("image_id"))
    return rows.where(F.col("surface_type") == kind).withColumn("__first", first).where(F.col("contour_id") == F.col("__first")).drop("__first")


def _added(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the columns of found (by image_id and contour_id)."""
    return rows.join(found, ["image_id", "contour_id"], "left")


def cortex(features: DataFrame, parents: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """features (with the three texture measures) with is_cortex, relabelled, and cortex_area and cortex_percentage."""
    own = features.withColumn("is_cortex", surfaces.is_cortex(F.col("stippling_density"), F.col("texture_variance"), F.col("edge_density"), sensitivity))
    return surfaces.label_cortex(own, parents)


def complexity(features: DataFrame, threshold: float = spatial.BORDER_DISTANCE) -> DataFrame:
    """features with scar_complexity: for scars of the Dorsal surface, how many others of them are within the threshold."""
    scars = features.where((F.col("surface_type") == "Dorsal") & F.lower("surface_feature").contains("scar"))
    return _added(features, spatial.scar_complexity(scars.select("image_id", "contour_id", "contour"), threshold))


def symmetry(parents: DataFrame) -> DataFrame:
    """parents with the areas on the sides of the centroid and both symmetries, on the Dorsal surface.

    Null where it has fewer than three points or its truncated centroid is not inside or on it.
    """
    own = _only(parents, "Dorsal").withColumn("__c", G.centroid(F.col("contour"))).where(F.size("contour") >= 3)
    x, y = F.col("__c.x").cast("int"), F.col("__c.y").cast("int")
    own = own.where(G.contains(F.col("contour"), x, y)).select("image_id", "contour_id", G.halves(F.col("contour"), x, y).alias("h")).select("image_id", "contour_id", "h.*")
    return _added(parents, own.withColumns(even_sides()))


def even_sides() -> dict[str, Column]:
    """vertical_symmetry and horizontal_symmetry (two digits) from the areas of the sides; null where they are empty."""
    even = lambda p, q: F.round(1 - F.abs(F.col(p) - F.col(q)) / F.nullif(F.col(p) + F.col(q), F.lit(0)), 2)
    return {"vertical_symmetry": even("top_area", "bottom_area"), "horizontal_symmetry": even("left_area", "right_area")}


def cells(parents: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with voronoi_cell_area; parents with voronoi_num_cells and the hull of the sites, on the Dorsal surface.

    Sites are the centroids of the Dorsal surface and of all its features; each has the part of the outline nearest to it.
    A surface without features is not parted: it has the hull of its site, but no cells.
    """
    dorsal = _only(parents, "Dorsal")
    site = lambda rows: rows.select("image_id", F.col("contour_id").alias("site_id"), F.col("centroid_x").alias("sx"), F.col("centroid_y").alias("sy"))
    kids = features.join(dorsal.select("image_id", F.col("contour_id").alias("parent_contour_id")), ["image_id", "parent_contour_id"], "left_semi")
    sites = site(dorsal).unionByName(site(kids)).where("sx is not null and sy is not null")
    parted = spatial.outline_cells(dorsal.select("image_id", "contour"), sites, alone=False)
    area = parted.select("image_id", F.col("site_id").alias("contour_id"), F.round("area", 2).alias("voronoi_cell_area"))
    count = parted.groupBy("image_id").agg(F.count(F.lit(1)).cast("int").alias("voronoi_num_cells"))
    count = spatial.hull_measures(sites).drop("n_sites").join(count, "image_id", "left")
    on_dorsal = dorsal.select("image_id", "contour_id").join(count, "image_id")
    return _added(_added(parents, area), on_dorsal), _added(features, area)


def lateral(parents: DataFrame) -> DataFrame:
    """parents with lateral_convexity and distance_to_max_width, on the Lateral surface."""
    p = F.col("contour")
    fine = (F.size(p) >= 3) & (G.area(p) > 0)
    own = _only(parents, "Lateral").select("image_id", "contour_id", F.when(fine, F.round(G.solidity(p), 2)).alias("lateral_convexity"), F.round(G.lateral_distance(p), 2).alias("distance_to_max_width"))
    return _added(parents, own)


def arrow_marks(features: DataFrame, contours: DataFrame, solidity: tuple[float, float] = (0.4, 1.0), free_solidity: tuple[float, float] = (0.4, 0.9)) -> DataFrame:
    """features with has_arrow, arrow_angle, arrow_tip and arrow_back.

    First, arrows among nested contours go to the feature around them, or else to the first feature beside what is
    around them; of several the last stays. Where an image still has a feature without an arrow, contours that are
    neither a surface nor a feature, within free_solidity and not inside cortex, go to the smallest feature that holds their
    centre; the first wins, and replaces what was there. Cortex takes no arrow. contours: all of the image, with level,
    and with dpi where limits are to grow with it.
    """
    scale = ["dpi"] if "dpi" in contours.columns else []
    marks = lambda rows: arrows.detect(rows, F.col("dpi") if scale else None, solidity).where("has_arrow")
    known = features.select("image_id", "contour_id")
    nested = contours.where("level = 'nested'")
    up = contours.select("image_id", F.col("contour_id").alias("parent_contour_id"), F.col("parent_contour_id").alias("__up"))
    direct = features.select("image_id", F.col("contour_id").alias("parent_contour_id"), F.col("contour_id").alias("__own"))
    beside = features.where("parent_contour_id is not null").groupBy("image_id", F.col("parent_contour_id").alias("__up")).agg(F.min("contour_id").alias("__beside"))
    placed = nested.join(up, ["image_id", "parent_contour_id"], "left").join(direct, ["image_id", "parent_contour_id"], "left").join(beside, ["image_id", "__up"], "left")
    placed = placed.select("image_id", "contour_id", F.coalesce("__own", "__beside").alias("parent_contour_id"), "contour", *scale).where("parent_contour_id is not null")
    first = arrows.merge_nested(features, marks(placed))
    lacking = first.groupBy("image_id").agg(F.max(~F.col("has_arrow")).alias("__lacks")).where("__lacks").select("image_id")
    p = F.col("contour")
    free = contours.where("level = 'nested'").join(known, ["image_id", "contour_id"], "left_anti").join(lacking, "image_id", "left_semi")
    free = free.where((G.area(p) >= 1)).withColumn("__sol", G.solidity(p)).where(F.col("__sol").between(*free_solidity)).drop("__sol").withColumn("__c", G.centroid(p))
    points = free.select("image_id", F.col("contour_id").alias("point_id"), F.col("__c.x").alias("x"), F.col("__c.y").alias("y"))
    flag = F.coalesce(F.col("is_cortex"), F.lit(False)) if "is_cortex" in features.columns else F.lit(False)
    crust = spatial.containing(points, features.where(flag).select("image_id", "contour_id", "contour")).select("image_id", "point_id")
    points = points.join(crust, ["image_id", "point_id"], "left_anti")
    marked = marks(free.join(points.select("image_id", F.col("point_id").alias("contour_id")), ["image_id", "contour_id"], "left_semi").select("image_id", "contour_id", "contour", *scale))
    given = spatial.assign_arrows(points.join(marked.select("image_id", F.col("contour_id").alias("point_id")), ["image_id", "point_id"], "left_semi"), features.select("image_id", "contour_id", "contour", flag.alias("is_cortex")))
    second = given.join(marked.select("image_id", F.col("contour_id").alias("point_id"), F.struct("arrow_angle", "arrow_tip", "arrow_back").alias("__second")), ["image_id", "point_id"]).drop("point_id")
    both = first.join(second, ["image_id", "contour_id"], "left")
    pick = lambda c: F.when(F.col("__second").isNotNull(), F.col(f"__second.{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*features.columns, (F.col("has_arrow") | F.col("__second").isNotNull()).alias("has_arrow"), pick("arrow_angle"), pick("arrow_tip"), pick("arrow_back"))
