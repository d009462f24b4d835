"""Arrow detection on contours: convexity defects, the triangle they cut off, its tip and direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

REFERENCE_DPI = 300.0


def thresholds(dpi: Column) -> Column:
    """min_area, min_depth and min_height: fixed values at the reference resolution, scaled with a known one."""
    s = F.when(dpi > 0, dpi / REFERENCE_DPI)
    one = lambda at, by: F.coalesce(by, F.lit(float(at)))
    return F.struct(one(1, s * s * 0.7).alias("min_area"), one(2, 2 * s * 0.8).alias("min_depth"), one(8, 8 * s * 0.8).alias("min_height"))


def detect(contours: DataFrame, dpi: Column | None = None, solidity: tuple[float, float] = (0.4, 1.0)) -> DataFrame:
    """contours with has_arrow, arrow_angle, tip and back points, triangle base and height, and solidity of both sides.

    The two deepest defects give the base of the triangle. Vertices on the more solid side of it (the second on a
    tie) are the shaft; the tip is the vertex of the other side farthest from the middle of the base.
    """
    t = thresholds(F.lit(None).cast("double") if dpi is None else dpi)
    found = G.arrow(F.col("contour"), t, *solidity)
    df = contours.withColumn("__a", found)
    ok = F.col("__a.arrow_angle").isNotNull()
    point = lambda of: F.when(ok, F.struct(*[F.col(f"__a.{of}_{c}").cast("int").alias(c) for c in "xy"])).alias(f"arrow_{of}")
    return df.select(*contours.columns, ok.alias("has_arrow"), "__a.arrow_angle", point("tip"), point("back"), "__a.triangle_base_length", "__a.triangle_height", "__a.shaft_solidity", "__a.tip_solidity")


def merge_nested(scars: DataFrame, arrows: DataFrame) -> DataFrame:
    """scars with the arrow of a nested contour in them: of several the last by contour_id; cortex takes none.

    arrows: image_id, contour_id, parent_contour_id, arrow_angle, arrow_tip, arrow_back.
    """
    last = arrows.groupBy("image_id", F.col("parent_contour_id").alias("contour_id")).agg(F.max(F.struct(F.col("contour_id").alias("at"), "arrow_angle", "arrow_tip", "arrow_back")).alias("__last"))
    free = ~F.coalesce(F.col("is_cortex"), F.lit(False)) if "is_cortex" in scars.columns else F.lit(True)
    joined = scars.join(last, ["image_id", "contour_id"], "left").withColumn("__last", F.when(free, F.col("__last")))
    return joined.select(*scars.columns, F.col("__last").isNotNull().alias("has_arrow"), "__last.arrow_angle", "__last.arrow_tip", "__last.arrow_back")
