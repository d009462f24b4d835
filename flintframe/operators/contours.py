"""The contour tree: border and area filters, levels, promotion. Rows: image_id, contour_id, parent_contour_id, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

MIN_AREA = 50.0


def _rooted(kept: DataFrame) -> DataFrame:
    """kept with parents that are gone made null."""
    ids = kept.select("image_id", F.col("contour_id").alias("parent_contour_id"), F.lit(True).alias("__there")).distinct()
    joined = kept.join(ids, ["image_id", "parent_contour_id"], "left")
    return joined.withColumn("parent_contour_id", F.when(F.col("__there"), F.col("parent_contour_id"))).drop("__there").select(*kept.columns)


def drop_border_touching(contours: DataFrame, width: Column, height: Column) -> DataFrame:
    """Contours whose bounding box stays off the frame; children of the others become roots."""
    b = G.bounds(F.col("contour"))
    inside = (b["min_x"] > 0) & (b["min_y"] > 0) & (b["min_x"] + b["width"] < width) & (b["min_y"] + b["height"] < height)
    return _rooted(contours.where(inside))


def filter_min_area(contours: DataFrame, least: float = MIN_AREA) -> DataFrame:
    """Contours of at least this area; children of the others become roots."""
    return _rooted(contours.where(F.col("area") >= least))


def levels(contours: DataFrame) -> DataFrame:
    """contours with level: parent for roots, child for their children, nested below."""
    up = contours.select("image_id", F.col("contour_id").alias("parent_contour_id"), F.col("parent_contour_id").alias("__up"), F.lit(True).alias("__has"))
    joined = contours.join(up, ["image_id", "parent_contour_id"], "left")
    level = F.when(F.col("parent_contour_id").isNull(), "parent").when(F.col("__has") & F.col("__up").isNull(), "child").otherwise("nested")
    return joined.select(*contours.columns, level.alias("level"))


def labelled(leveled: DataFrame) -> DataFrame:
    """Parents and children with record (``parent N``, ``child N`` in the image) and parent_record (``Unknown`` without one)."""
    own = leveled.where("level <> 'nested'")
    n = F.row_number().over(Window.partitionBy("image_id", F.col("level") == "parent").orderBy("contour_id"))
    named = own.withColumn("record", F.concat_ws(" ", F.when(F.col("level") == "parent", "parent").otherwise("child"), n))
    up = named.select("image_id", F.col("contour_id").alias("parent_contour_id"), F.col("record").alias("__up"))
    parent = F.when(F.col("level") == "parent", F.col("record")).otherwise(F.coalesce("__up", F.lit("Unknown")))
    return named.join(up, ["image_id", "parent_contour_id"], "left").select(*leveled.columns, "record", parent.alias("parent_record"))


def promote_nested(leveled: DataFrame) -> DataFrame:
    """Nested contours as children in images that have nested ones but no children."""
    w = Window.partitionBy("image_id")
    lone = ~F.max(F.col("level") == "child").over(w)
    return leveled.withColumn("level", F.when(lone & (F.col("level") == "nested"), "child").otherwise(F.col("level")))


def child_counts(contours: DataFrame) -> DataFrame:
    return contours.where(F.col("parent_contour_id").isNotNull()).groupBy("image_id", F.col("parent_contour_id").alias("contour_id")).agg(F.count(F.lit(1)).alias("n_children"))


def fallback_levels(contours: DataFrame) -> DataFrame:
    """For images whose tree can't be read: the first contour is the parent, the rest children."""
    first = F.row_number().over(Window.partitionBy("image_id").orderBy("contour_id")) == 1
    return contours.withColumn("level", F.when(first, "parent").otherwise("child"))


def measures(polygons: DataFrame) -> DataFrame:
    """polygons (contour) with area, perimeter, centroid, technical and maximal dimensions, rounded to two digits."""
    p = F.col("contour")
    m = polygons.select("*", G.area(p).alias("area"), G.perimeter(p).alias("perimeter"), G.centroid(p).alias("__c"), G.technical(p).alias("__t"), G.max_dimensions(p).alias("__m"), G.bounds(p).alias("__b"))
    two = lambda c: F.round(c, 2)
    return m.select(
        *polygons.columns, two("area").alias("area"), two("perimeter").alias("perimeter"), two("__c.x").alias("centroid_x"), two("__c.y").alias("centroid_y"),
        F.col("__t.length").alias("technical_length"), F.col("__t.width").alias("technical_width"), two("__m.length").alias("max_length"), two("__m.width").alias("max_width"),
        F.when(F.col("__b.width") > 0, two(F.col("__b.height") / F.col("__b.width"))).alias("aspect_ratio"),
    )


def fallback_measures(polygons: DataFrame) -> DataFrame:
    """Least measures where measuring failed: the centre of the bounding box; the first contour is Dorsal."""
    b = G.bounds(F.col("contour"))
    first = F.row_number().over(Window.partitionBy("image_id").orderBy("contour_id")) == 1
    return polygons.select("image_id", "contour_id", (b["min_x"] + F.floor(b["width"] / 2)).cast("double").alias("centroid_x"), (b["min_y"] + F.floor(b["height"] / 2)).cast("double").alias("centroid_y"), F.when(first, "Dorsal").otherwise("Unknown").alias("surface_type"))
