"""The metrics table, per-lithic documents and the run manifest on disk."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the metrics table in order.
COLUMNS = {
    "image_id": "string", "surface_type": "string", "surface_feature": "string", "scar_count": "int", "centroid_x": "double", "centroid_y": "double",
    "technical_width": "double", "technical_length": "double", "max_width": "double", "max_length": "double", "total_area": "double", "aspect_ratio": "double",
    "perimeter": "double", "distance_to_max_width": "double", "voronoi_num_cells": "int", "convex_hull_width": "double", "convex_hull_height": "double",
    "convex_hull_area": "double", "voronoi_cell_area": "double", "top_area": "double", "bottom_area": "double", "left_area": "double", "right_area": "double",
    "vertical_symmetry": "double", "horizontal_symmetry": "double", "lateral_convexity": "double", "is_cortex": "boolean", "cortex_area": "double",
    "cortex_percentage": "double", "scar_complexity": "int", "has_arrow": "boolean", "arrow_angle": "double", "calibration_method": "string",
    "pixels_per_mm": "double", "scale_confidence": "double",
}
ROWS_OF_A_PACKED_FILE = 1_000_000
SCHEMA = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
MANIFEST = "schema_version int, timestamp string, total int, successful array<struct<image_id:string,dpi:int>>, failed array<struct<image_id:string,reason:string>>"
MANIFEST += ", messages array<struct<image_id:string,messages:array<string>>>"


def arrange(rows: DataFrame) -> DataFrame:
    """rows with the table's columns first, in order and type (missing ones null), then any others."""
    own = [(F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in COLUMNS.items()]
    return rows.select(*own, *[c for c in rows.columns if c not in COLUMNS])


def write_csv(rows: DataFrame, path: str, codec: str = "none") -> None:
    """rows as CSV with a header and NA for null, packed by a codec that Spark knows; what was there is replaced."""
    _save(arrange(rows), path, "overwrite", codec)


def _save(rows: DataFrame, path: str, mode: str, codec: str) -> None:
    out = rows.write.mode(mode).option("header", True).option("nullValue", "NA").option("emptyValue", "").option("compression", codec)
    if codec != "none":  # a packed file is read by one task
        out = out.option("maxRecordsPerFile", ROWS_OF_A_PACKED_FILE)
    out.csv(path)


def header(spark: SparkSession, path: str) -> list[str] | None:
    """Columns of the CSV at a path; None if there is none."""
    try:
        return spark.read.option("header", True).csv(path).columns or None
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def append_csv(rows: DataFrame, path: str, replace: bool = True, codec: str = "none") -> None:
    """rows added to the CSV at a path, in the columns that it has: new ones are left out, missing ones are NA.

    An image is in the table once: rows of images that it has already replace those, or (replace false) are left out,
    so that what is added twice is there once. Rows are computed once: they are written beside the table, and what they
    replace is found from there. Where no image comes again their files move into the table; else the rest of the table
    is written to them, and they take its place. Files that are there stay as they are packed.
    """
    spark = rows.sparkSession
    columns = header(spark, path)
    if columns is None:
        return write_csv(rows, path, codec)
    own = arrange(rows)
    own = own.select(*[F.col(c) if c in own.columns else F.lit(None).cast("string").alias(c) for c in columns])
    kinds = ", ".join(f"`{c}` {COLUMNS.get(c, 'string')}" for c in columns)
    read = lambda at: spark.read.schema(kinds).option("header", True).option("nullValue", "NA").csv(at)
    old, beside = read(path), f"{path}.next"
    if not replace:
        return _save(own.join(old.select("image_id").distinct(), "image_id", "left_anti").select(*columns), path, "append", codec)
    _save(own, beside, "overwrite", codec)
    again = read(beside).select("image_id").distinct()
    if old.join(again, "image_id", "left_semi").isEmpty():
        return _move_into(spark, beside, path)
    _save(old.join(again, "image_id", "left_anti").select(*columns), beside, "append", codec)
    _take_over(spark, beside, path)


def _move_into(spark: SparkSession, new: str, old: str) -> None:
    """The files of the folder ``new``, whose names nobody else has, into ``old``; ``new`` goes."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(new).getFileSystem(spark._jsc.hadoopConfiguration())
    for one in files.globStatus(path(f"{new}/part-*")):
        if not files.rename(one.getPath(), path(f"{old}/{one.getPath().getName()}")):
            raise OSError(f"{one.getPath()} could not be moved to {old}")
    files.delete(path(new), True)


def _take_over(spark: SparkSession, new: str, old: str) -> None:
    """The folder ``new`` in the place of ``old``; if this stops in between, recover() ends it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(new).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(path(old), True)
    files.rename(path(new), path(old))


def recover(spark: SparkSession, path: str) -> None:
    """Ends a replacement that stopped after the new table was whole and the old one gone; half-written ones go."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    new = at(f"{path}.next")
    if not files.exists(new):
        return
    if files.exists(at(path)) or not files.exists(at(f"{path}.next/_SUCCESS")):
        files.delete(new, True)
    else:
        files.rename(new, at(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A metrics table; a missing one fails. Columns are matched by position, extra ones left out."""
    return spark.read.schema(SCHEMA).option("header", True).option("enforceSchema", True).option("nullValue", "NA").csv(path)


def merge(parts: list[DataFrame]) -> DataFrame:
    """All rows of the parts, with the union of their columns."""
    return arrange(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON line a lithic in a folder of its own; nulls are written."""
    _documents(documents, path, "static")


def append_documents(documents: DataFrame, path: str) -> None:
    """Documents beside those that are there; those of lithics that are there already are replaced."""
    _documents(documents, path, "dynamic")


def _documents(documents: DataFrame, path: str, mode: str) -> None:
    out = documents.withColumn("lithic", F.col("image_id"))
    out.write.mode("overwrite").option("partitionOverwriteMode", mode).option("ignoreNullFields", False).partitionBy("lithic").json(path)


def manifest(status: DataFrame) -> DataFrame:
    """One row from a row an image (image_id, ok, dpi, reason): totals and both lists, in order of id.

    With messages (and position) in status: also what was said of each image, if anything, in order of position.
    """
    listed = lambda c, *cols: F.array_sort(F.collect_list(F.when(c, F.struct(*cols))))
    ok = F.coalesce(F.col("ok"), F.lit(False))
    said = []
    if "messages" in status.columns:
        place = F.col("position") if "position" in status.columns else F.lit(0)
        every = listed(F.size("messages") > 0, place.alias("position"), "image_id", "messages")
        said = [F.transform(every, lambda m: F.struct(m["image_id"].alias("image_id"), m["messages"].alias("messages"))).alias("messages")]
    return status.agg(
        F.lit(2).alias("schema_version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.count(F.lit(1)).cast("int").alias("total"),
        listed(ok, "image_id", F.col("dpi").cast("int").alias("dpi")).alias("successful"), listed(~ok, "image_id", "reason").alias("failed"), *said)


def merge_status(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """One status an image: of those in both the new one."""
    if old is None:
        return new
    return new.unionByName(old.join(new.select("image_id"), "image_id", "left_anti"), allowMissingColumns=True)


def write_manifest(status: DataFrame, path: str) -> None:
    manifest(status).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_manifest(spark: SparkSession, path: str, messages: bool = False) -> DataFrame | None:
    """A row an image (image_id, ok, dpi, reason; with messages also these and their position), or None if the manifest is missing or can't be read."""
    try:
        whole = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    if whole.where("schema_version is not null or successful is not null").isEmpty():
        return None
    good = whole.select(F.explode("successful").alias("s")).select("s.image_id", F.lit(True).alias("ok"), "s.dpi", F.lit(None).cast("string").alias("reason"))
    every = good.unionByName(whole.select(F.explode("failed").alias("s")).select("s.image_id", F.lit(False).alias("ok"), F.lit(None).cast("int").alias("dpi"), "s.reason"))
    if not messages:
        return every
    said = whole.select(F.posexplode("messages").alias("position", "m")).select("m.image_id", F.col("m.messages").alias("messages"), F.col("position").cast("bigint").alias("position"))
    return every.join(said, "image_id", "left").withColumn("messages", F.coalesce("messages", F.array().cast("array<string>")))
