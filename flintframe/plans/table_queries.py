"""Queries of the tables that a run reads and writes: each is written, read again and held against what went in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import kept, new_folder
from ..options import Options
from ..sources import metadata, metrics
from . import adapters, batch, scans
from .assemblage_queries import rounded

#: Images of the metadata and the files that are there: of every seventh none, of every fourth one more.
IMAGES = "SELECT concat('lithic-', cast(c_custkey AS varchar(20)), CASE WHEN c_custkey % 5 = 0 THEN '.png' ELSE '' END) AS image_id, cast(c_custkey % 9 AS varchar(20)) AS scale, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('bar-', cast(c_custkey AS varchar(20))) END AS scale_id, c_custkey AS k FROM {customer}"
FILES = """SELECT concat('lithic-', cast(c_custkey AS varchar(20)), CASE c_custkey % 7 WHEN 1 THEN '' WHEN 2 THEN '.png' WHEN 3 THEN '.jpg' WHEN 4 THEN '.tif' WHEN 5 THEN '.png' ELSE '.bmp' END) AS name FROM {customer} WHERE c_custkey % 7 <> 0
UNION ALL SELECT concat('lithic-', cast(c_custkey AS varchar(20)), '.jpeg') AS name FROM {customer} WHERE c_custkey % 4 = 0"""
#: How the tables that these queries write are packed: most of a row is NA.
CODEC = "gzip"
_SHOWN = ("image_id", "surface_type", "surface_feature", "scar_count", "technical_length", "total_area", "vertical_symmetry", "is_cortex", "scar_complexity", "has_arrow", "calibration_method", "pixels_per_mm")
_A = f"WITH a AS ({adapters.duck(adapters.ASSEMBLAGE)}), m AS ({adapters.duck(adapters.MANIFEST)})\n"
_ROWS = _A + "SELECT " + ", ".join(f"round({c}, 4) AS {c}" if c in ("technical_length", "total_area", "vertical_symmetry", "pixels_per_mm") else c for c in _SHOWN) + " FROM a"


def _assemblage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.adapt(spark, sf_dir, adapters.ASSEMBLAGE).drop("ord")


def s01_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata as CSV, read as text with its further column."""
    path = new_folder(spark, "metadata")
    adapters.adapt(spark, sf_dir, IMAGES).write.option("header", True).csv(path)
    return metadata.read_metadata(spark, path).select("image_id", "scale_id", "scale", "k")


def s03_resolved_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each image: of its exact name, else the first that an extension makes."""
    files = adapters.adapt(spark, sf_dir, FILES).withColumn("path", F.concat(F.lit("/images/"), F.col("name")))
    return metadata.resolve_images(adapters.adapt(spark, sf_dir, IMAGES), files).select("image_id", "path")


def s07_metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics table as CSV with NA, read with its types."""
    path = new_folder(spark, "metrics")
    metrics.write_csv(_assemblage(spark, sf_dir), path, CODEC)
    return rounded(metrics.read_csv(spark, path).select(*_SHOWN))


def s08_appended_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics table in two parts that have images in common: each is there once."""
    path, rows = new_folder(spark, "metrics"), _assemblage(spark, sf_dir)
    part = F.pmod(F.xxhash64("image_id"), F.lit(3))
    metrics.append_csv(rows.where(part < 2), path, codec=CODEC)
    metrics.append_csv(rows.where(part > 0).withColumn("another", F.lit(1)), path, codec=CODEC)
    return rounded(metrics.read_csv(spark, path).select(*_SHOWN))


def s11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a run, written and read again: a row an image."""
    path = new_folder(spark, "manifest")
    metrics.write_manifest(adapters.adapt(spark, sf_dir, adapters.MANIFEST), path)
    return metrics.read_manifest(spark, path).select("image_id", "ok", "dpi", "reason")


def q01_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run from image files to rows of the metrics table, without smoothing and closing, so that shapes are those drawn."""
    options = Options().update(preprocessing__blur=1, preprocessing__closing=0, preprocessing__threshold="simple", cortex__enabled=False)
    shapes = adapters.adapt(spark, sf_dir, scans.DRAWINGS)
    meta = shapes.select("image_id", F.lit("bar").alias("scale_id"), F.col("bar").cast("string").alias("scale"))
    bars = spark.createDataFrame([("bar", 6.0, 0.9)], "image_id string, scale_pixels double, scale_confidence double")
    found = kept(batch.find_contours(scans.drawings(shapes), options))
    rows = metrics.arrange(batch.measured(found, meta, bars, options)[0])
    return rounded(rows.select("image_id", "surface_type", "surface_feature", "scar_count", "total_area", "technical_width", "technical_length", "centroid_x", "centroid_y", "aspect_ratio", "perimeter", "voronoi_num_cells", "top_area", "left_area", "vertical_symmetry", "horizontal_symmetry", "scar_complexity", "is_cortex", "has_arrow", "calibration_method", "pixels_per_mm"))


#: Rows of q01_run: outlines along the outermost dark pixels, and of the hole along the dark ones around it, corners cut; a bar of 6 pixels.
_RUN = f"""WITH d AS ({adapters.duck(scans.DRAWINGS)}), u AS (SELECT *, 6.0::DOUBLE / bar AS f, (w - 1) // 2 AS l, (h - 1) // 2 AS t FROM d)
SELECT image_id, 'Dorsal' AS surface_type, 'Dorsal' AS surface_feature, 1 AS scar_count, round((w - 1) * (h - 1) / (f * f), 2) AS total_area, round((w - 1) / f, 2) AS technical_width, round((h - 1) / f, 2) AS technical_length,
  round((x0 + (w - 1) / 2) / f, 2) AS centroid_x, round((y0 + (h - 1) / 2) / f, 2) AS centroid_y, round(h / w, 2) AS aspect_ratio, round(2 * (w + h - 2) / f, 2) AS perimeter, 2 AS voronoi_num_cells, round(t * w / (f * f), 2) AS top_area, round(l * h / (f * f), 2) AS left_area,
  round(1 - abs(t - (h - t))::DOUBLE / h, 2) AS vertical_symmetry, round(1 - abs(l - (w - l))::DOUBLE / w, 2) AS horizontal_symmetry, NULL::INTEGER AS scar_complexity, false AS is_cortex, false AS has_arrow, 'scale_bar' AS calibration_method, f AS pixels_per_mm FROM u
UNION ALL SELECT image_id, 'Dorsal', 'scar 1', NULL, round(((hw + 1) * (hh + 1) - 2) / (f * f), 2), NULL, NULL, round((x0 + 8 + (hw - 1) / 2) / f, 2), round((y0 + 9 + (hh - 1) / 2) / f, 2), round((hh + 2) / (hw + 2), 2), round((2 * (hw + hh - 2) + 4 * sqrt(2)) / f, 2), NULL, NULL, NULL, NULL, NULL, 0, false, false, 'scale_bar', f FROM u"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (s01_metadata, s03_resolved_images, s07_metrics_csv, s08_appended_metrics, s11_manifest, q01_run)}
ORACLES: dict[str, str] = {
    "s01_metadata": f"SELECT image_id, scale_id, scale, k::VARCHAR AS k FROM ({adapters.duck(IMAGES)}) q",
    "s03_resolved_images": f"""WITH i AS ({adapters.duck(IMAGES)}), f AS ({adapters.duck(FILES)}),
t AS (SELECT image_id, r, image_id || ext AS name FROM i, (VALUES (0, ''), """ + ", ".join(f"({k}, '{e}')" for k, e in enumerate(metadata.EXTENSIONS, 1)) + """) e(r, ext))
SELECT i.image_id, path FROM i LEFT JOIN (SELECT image_id, arg_min('/images/' || name, r) AS path FROM t JOIN f USING (name) GROUP BY 1) q USING (image_id)""",
    "s07_metrics_csv": _ROWS, "s08_appended_metrics": _ROWS,
    "q01_run": _RUN,
    "s11_manifest": _A + "SELECT image_id, ok, dpi, reason FROM m",
}
