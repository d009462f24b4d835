"""A whole run: images to the metrics table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import rasters
from ..functions.durable import kept as _kept
from ..operators import analyses, calibration, contours, raster, surfaces
from ..options import Options
from ..sources import images, metadata, metrics

COLUMNS = ("image_id", "contour_id", "parent_contour_id", "contour", "width", "height", *raster.TEXTURE, "dpi", "error", "messages")
CONTOURS = raster.OUTLINES + ", " + ", ".join(f"{c} double" for c in raster.TEXTURE) + ", dpi double, error string, messages array<string>"


def _said(dpi: float | None, found: int, options: Options) -> list[str]:
    """What there is to say of an image that was read."""
    scaling, out = options.dpi, []
    if scaling.enabled and not (dpi and dpi > 0):
        out.append("the file has no resolution: kernels are not scaled")
    elif scaling.enabled and scaling.mode in ("conservative", "standard") and dpi / scaling.reference > scaling.most:
        out.append(f"kernel scale {dpi / scaling.reference:.2f} is limited to {scaling.most:.2f}")
    return out if found else [*out, "no contour was found"]


#: Images whose rows a task hands on together: a table an image costs more than the image.
IMAGES_TOGETHER = 64


def _outlined(options: Options) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Contours of each image with the texture of those inside others, and a row without contour_id that has its error and messages."""
    table = lambda rows: pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in COLUMNS})

    def of(image_id: str, content: bytes, dpi: float | None) -> list[dict]:
        about = {"image_id": image_id, "dpi": dpi}
        try:
            binary = rasters.binarised(images.grey_of(images.decode(content)), dpi, options.preprocessing, options.dpi)
            found = rasters.outlines(binary > 0)
            size, made = {"width": binary.shape[1], "height": binary.shape[0]}, []
            for k, (up, c) in enumerate(found):
                up = None if pd.isna(up) else int(up)
                texture = {} if up is None else dict(zip(raster.TEXTURE, rasters.texture(binary, c), strict=True))
                made.append(about | size | texture | {"contour_id": k, "parent_contour_id": up, "contour": [{"x": int(x), "y": int(y)} for x, y in c]})
            return [*made, about | {"messages": _said(dpi, len(found), options)}]
        except Exception as e:  # one bad image is a row with its reason
            return [about | {"error": f"{type(e).__name__}: {e}"[:300], "messages": []}]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for k, (image_id, content, dpi) in enumerate(zip(batch["image_id"], batch["content"], batch["dpi"], strict=True), 1):
                rows += of(image_id, bytes(content), None if pd.isna(dpi) else float(dpi))
                if k % IMAGES_TOGETHER == 0:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    return run


def find_contours(files: DataFrame, options: Options) -> DataFrame:
    """Contours of images (image_id, content, dpi), with size of the image and texture, and a row an image without contour_id."""
    return files.select("image_id", "content", F.col("dpi").cast("double").alias("dpi")).mapInPandas(_outlined(options), CONTOURS)


def levelled(found: DataFrame, options: Options) -> DataFrame:
    """Contours with their measures and level, without those at the frame or too small; no child, but nested ones: promoted."""
    f = options.filtering
    own = contours.measures(found)
    if f.exclude_border:
        own = contours.drop_border_touching(own, F.col("width"), F.col("height"))
    return contours.promote_nested(contours.levels(contours.filter_min_area(own, f.min_area)))


def analyse(level: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Surfaces and features of levelled contours with everything that the options ask for."""
    o = options
    labelled = _kept(surfaces.classify_and_label(level.where("level <> 'nested'"), o.classification.tolerance, o.classification.enabled))
    parents, features = labelled.where("parent_contour_id is null"), labelled.where("parent_contour_id is not null")
    features = analyses.cortex(features, parents, o.cortex.sensitivity) if o.cortex.enabled else features.withColumn("is_cortex", F.lit(False))
    if o.scars.enabled:
        features = analyses.complexity(features, o.scars.distance_threshold)
    parents, features = analyses.cells(analyses.symmetry(parents), features)
    parents = analyses.lateral(parents).withColumn("is_cortex", F.lit(False)).withColumn("has_arrow", F.lit(False))
    if o.arrows.enabled:
        return parents, analyses.arrow_marks(_kept(features), level, o.arrows.solidity, o.arrows.free_solidity)
    return parents, features.withColumn("has_arrow", F.lit(False))


def measured(each: DataFrame, meta: DataFrame, bars: DataFrame | None, options: Options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From what find_contours() gives: the rows of the metrics table, and the levelled contours, surfaces and calibrations behind them."""
    level = _kept(levelled(each.where("contour_id is not null").drop("error", "messages"), options))
    parents, features = analyse(level, options)
    none = level.sparkSession.createDataFrame([], "image_id string, scale_pixels double, scale_confidence double")
    scaled = calibration.calibrate(meta, none if bars is None else bars, options.scale.enabled)
    rows = surfaces.metric_rows(parents, features)
    rows = rows.join(scaled.select("image_id", "calibration_method", "pixels_per_mm", "scale_confidence"), "image_id", "left")
    if not options.legacy_pixel_units:
        rows = surfaces.to_millimetres(rows, F.col("pixels_per_mm"))
    return rows, level, parents, scaled


def run(spark: SparkSession, folder: str, meta: DataFrame, bars: DataFrame | None = None, options: Options | None = None, counters: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """The metrics rows, in all their columns, and a status row an image (image_id, ok, dpi, reason, messages, position).

    An image that is missing or can't be decoded has its reason in the status and no row; it does not stop the others.
    messages: what was done in place of what was asked for, step by step; position: the image's place in the metadata.
    counters: gets images read, images that failed and contours found, counted while images are read.
    """
    options = options or Options()
    meta = meta.withColumn("__place", F.monotonically_increasing_id())
    places = meta.groupBy("image_id").agg(F.min("__place").alias("position"))
    meta = meta.drop("__place")
    at = _kept(metadata.resolve_images(meta, metadata.list_images(spark, folder)).select("image_id", "path"))
    files = images.read_named(spark, at)
    found = find_contours(files.join(at, "path"), options)
    if counters is not None:
        mark = F.col("contour_id").isNull()
        found = found.observe(counters, F.count_if(mark).alias("images"), F.count_if(mark & F.col("error").isNotNull()).alias("failed"), F.count_if(~mark).alias("contours"))
    each = _kept(found)
    marks = each.where("contour_id is null")
    rows, level, parents, scaled = measured(each, meta, bars, options)
    bad = marks.select("image_id", F.col("error"), F.col("messages").alias("__read"))
    status = at.join(files.select("path", "dpi"), "path", "left").join(bad, "image_id", "left")
    reason = F.when(F.col("path").isNull(), "image not found").otherwise(F.col("error"))
    kinds = level.groupBy("image_id").agg(F.lit(True).alias("__left"))
    dorsal = parents.where("surface_type = 'Dorsal'").select("image_id").distinct().withColumn("__dorsal", F.lit(True))
    units = scaled.groupBy("image_id").agg(F.min("calibration_status").alias("__units"))
    status = status.join(kinds, "image_id", "left").join(dorsal, "image_id", "left").join(units, "image_id", "left").join(places, "image_id", "left")
    ok = reason.isNull()
    later = F.array_compact(F.array(
        F.when(ok & F.col("__left").isNull() & ~F.array_contains(F.coalesce("__read", F.array().cast("array<string>")), "no contour was found"), "no contour is left after the filters"),
        F.when(ok & F.col("__left") & F.col("__dorsal").isNull(), "no Dorsal surface: no symmetry and no cells"),
        F.when(ok & (F.col("__units") == "pixels_no_scale"), "no scale: measures are in pixels"), F.when(ok & (F.col("__units") == "pixels_detection_failed"), "the scale was not found or is no number: measures are in pixels")))
    messages = F.concat(F.coalesce("__read", F.array().cast("array<string>")), later)
    return metrics.arrange(rows), status.select("image_id", ok.alias("ok"), "dpi", reason.alias("reason"), messages.alias("messages"), "position")


def resume(spark: SparkSession, folder: str, meta: DataFrame, out: str, bars: DataFrame | None = None, options: Options | None = None, parts: int = 1) -> dict[str, int]:
    """Measures the images that the manifest in ``out`` does not have as measured, and adds them to what is there; returns how many.

    Images are dealt by hash of their id to ``parts``, one after the other, each saved before the next begins: rows
    and documents first, and then the manifest. A run that stops does a part again at most, and what that has saved
    already is replaced, so that every image is there once however often a run is begun.
    """
    total = {"images": 0, "failed": 0, "contours": 0}
    metrics.recover(spark, f"{out}/processed_metrics")
    for k in range(parts):
        done = metrics.read_manifest(spark, f"{out}/run_summary", True)
        todo = meta.where(F.pmod(F.xxhash64("image_id"), F.lit(parts)) == k)
        if done is not None:
            done = _kept(done)  # the manifest is written anew below
            todo = todo.join(done.where("ok").select("image_id"), "image_id", "left_anti")
        if todo.isEmpty():
            continue
        counters = Observation()
        rows, status = run(spark, folder, todo, bars, options, counters)
        first = 0 if done is None else (done.agg(F.max("position")).first()[0] or 0) + 1
        status = _kept(status.withColumn("position", F.col("position") + first))
        save(rows, status, out, options, done)
        total = {c: n + counters.get[c] for c, n in total.items()}
    return total


def save(rows: DataFrame, status: DataFrame, folder: str, options: Options | None = None, known: DataFrame | None = None) -> None:
    """The metrics table, the documents (unless switched off) and the manifest in a folder; beside what is ``known`` there, if given."""
    own = rows.drop("contour_id", "parent_contour_id")
    if known is None:
        metrics.write_csv(own, f"{folder}/processed_metrics")
    else:
        metrics.append_csv(own, f"{folder}/processed_metrics")
    if (options or Options()).json_per_lithic:
        (metrics.write_documents if known is None else metrics.append_documents)(surfaces.documents(rows), f"{folder}/json")
    metrics.write_manifest(metrics.merge_status(known, status), f"{folder}/run_summary")
