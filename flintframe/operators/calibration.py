"""Scale calibration: bar detection on pixel tables, factors, status and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INK = 127


def detect_scale_bars(pixels: DataFrame, ink: int = INK) -> DataFrame:
    """By image: length in pixels of the ink's bounding box and a confidence; images without ink have no row."""
    dark = pixels.where(F.col("v") <= ink).groupBy("image_id").agg((F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    long, short = F.greatest("w", "h"), F.least("w", "h")
    return dark.select("image_id", long.cast("double").alias("scale_pixels"), F.least(F.lit(1.0), long / F.greatest(short, F.lit(1)) / 10).alias("scale_confidence"))


def parse_scale(cell: Column) -> Column:
    """The number in a cell, or null."""
    return F.trim(cell).try_cast("double")


def factor(pixels: Column, mm: Column) -> Column:
    return F.when(mm > 0, pixels / mm)


def calibrate(metadata: DataFrame, bars: DataFrame, enabled: bool = True) -> DataFrame:
    """metadata (image_id, scale_id, scale) with status, calibration_method, pixels_per_mm and scale_confidence."""
    joined = metadata.join(bars.withColumnRenamed("image_id", "scale_id"), "scale_id", "left")
    ppm = factor(F.col("scale_pixels"), parse_scale(F.col("scale")))
    none = F.lit(not enabled) | F.coalesce(F.trim("scale_id") == "", F.lit(True))
    status = F.when(none, "pixels_no_scale").when(ppm.isNull(), "pixels_detection_failed").otherwise("scale_bar")
    out = joined.withColumn("calibration_status", status)
    found = F.col("calibration_status") == "scale_bar"
    return out.select(*metadata.columns, "calibration_status", F.when(found, "scale_bar").otherwise("pixels").alias("calibration_method"), F.when(found, ppm).alias("pixels_per_mm"), F.when(found, F.col("scale_confidence")).alias("scale_confidence"), F.when(found, ppm).otherwise(1.0).alias("factor"))


def suffix(method: Column, ppm: Column) -> Column:
    """What a summary line says of the calibration."""
    return F.when((method == "scale_bar") & (ppm > 0), F.format_string("scale bar, %.2f px/mm", ppm)).otherwise("pixels only")


def dpi_factor(dpi: Column) -> Column:
    return F.when(dpi > 0, dpi / 25.4)
