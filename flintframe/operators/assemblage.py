"""The assemblage data layer: row filters, summaries and labels of the metrics table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_CONFIDENCE = 0.8
#: Labels that are not the field name in words, and the fields measured as lengths and as areas.
LABELS = {"image_id": "Image ID", "centroid_x": "Centroid X", "centroid_y": "Centroid Y", "voronoi_num_cells": "Voronoi cells"}
LINEAR_FIELDS = ("centroid_x", "centroid_y", "technical_width", "technical_length", "max_width", "max_length", "perimeter", "distance_to_max_width", "convex_hull_width", "convex_hull_height")
AREA_FIELDS = ("total_area", "voronoi_cell_area", "convex_hull_area", "top_area", "bottom_area", "left_area", "right_area", "cortex_area")


def _feature() -> Column:
    return F.lower(F.coalesce(F.col("surface_feature"), F.lit("")))


def is_parent() -> Column:
    return F.coalesce(F.col("surface_feature") == F.col("surface_type"), F.lit(False))


def is_scar() -> Column:
    return ~F.col("surface_feature").eqNullSafe(F.col("surface_type")) & _feature().startswith("scar ")


def is_dorsal_scar() -> Column:
    return F.coalesce(F.col("surface_type") == "Dorsal", F.lit(False)) & _feature().startswith("scar ")


def as_bool(value: Column) -> Column:
    """True for true and for the text ``true`` in any case; false otherwise, null included."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))) == "true", F.lit(False))


def _flag(df: DataFrame, name: str) -> Column:
    return as_bool(F.col(name)) if name in df.columns else F.lit(False)


def parent_rows(df: DataFrame) -> DataFrame:
    return df.where(is_parent())


def dorsal_scars(df: DataFrame) -> DataFrame:
    return df.where(is_dorsal_scar())


def scar_rows(df: DataFrame, with_arrows: bool = False) -> DataFrame:
    return df.where(is_scar() & _flag(df, "has_arrow")) if with_arrows else df.where(is_scar())


def cortex_rows(df: DataFrame) -> DataFrame:
    return df.where(_flag(df, "is_cortex"))


def filter_metrics(df: DataFrame, surface_types: Sequence[str] = (), calibration_methods: Sequence[str] = ()) -> DataFrame:
    """Rows of the given surfaces and calibrations; an empty list passes all."""
    if surface_types:
        df = df.where(F.col("surface_type").isin(*surface_types))
    return df.where(F.col("calibration_method").isin(*calibration_methods)) if calibration_methods else df


def summary(df: DataFrame) -> DataFrame:
    """One row: lithics, calibrated lithics, arrow rate over dorsal scars, share of lithics with cortex."""
    lithics = F.countDistinct("image_id")
    return df.agg(
        lithics.alias("n_lithics"),
        F.countDistinct(F.when(F.col("calibration_method") == "scale_bar", F.col("image_id"))).alias("n_calibrated"),
        F.coalesce(F.avg(F.when(is_dorsal_scar(), _flag(df, "has_arrow").cast("int"))), F.lit(0.0)).alias("arrow_detection_rate"),
        F.coalesce(F.countDistinct(F.when(_flag(df, "is_cortex"), F.col("image_id"))) / F.nullif(lithics, F.lit(0)), F.lit(0.0)).alias("cortex_prevalence"),
    )


def surface_counts(df: DataFrame) -> DataFrame:
    """Parents by surface type, null included."""
    return parent_rows(df).groupBy("surface_type").agg(F.count(F.lit(1)).alias("n_surfaces"))


def calibration_counts(df: DataFrame) -> DataFrame:
    """Lithics by the calibration of their first row."""
    first = df.groupBy("image_id").agg(F.min(F.struct("ord", "calibration_method")).alias("first"))
    return first.groupBy(F.col("first.calibration_method").alias("calibration_method")).agg(F.count(F.lit(1)).alias("n_lithics"))


def overview(df: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """One row of the 13 overview counts. manifest: image_id, ok, dpi; without it all lithics count as successful."""
    distinct_if = lambda c: F.countDistinct(F.when(c, F.col("image_id")))
    dorsal_parent = is_parent() & (F.col("surface_type") == "Dorsal")
    counts = df.agg(
        distinct_if(F.col("scale_confidence").try_cast("double") < LOW_CONFIDENCE).alias("low_confidence_scales"),
        F.count_if(is_parent() & (F.col("surface_type") == "Unclassified")).alias("unclassified_surfaces"),
        distinct_if(dorsal_parent & (F.col("scar_count") == 0)).alias("zero_scar_lithics"),
        distinct_if(F.col("calibration_method") == "pixels").alias("pixel_only_lithics"),
        F.countDistinct("image_id").alias("n_lithics"), F.count_if(is_parent()).alias("n_surfaces"), F.count_if(is_scar()).alias("n_scars"),
        F.count_if(is_scar() & _flag(df, "has_arrow")).alias("n_scars_with_arrows"), F.count_if(_flag(df, "is_cortex")).alias("n_cortex_regions"),
    )
    if manifest is None:
        zero = F.lit(0).cast("bigint")
        return counts.select("*", F.col("n_lithics").alias("successful"), zero.alias("failed"), zero.alias("mixed_dpi"), zero.alias("missing_dpi"))
    return counts.crossJoin(F.broadcast(dpi_counts(manifest)))  # one row by one row


def dpi_counts(manifest: DataFrame) -> DataFrame:
    """One row: images that succeeded and failed, distinct resolutions if they differ, and images without one."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    kinds = F.countDistinct(F.when(ok, F.col("dpi")))
    return manifest.agg(F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.when(kinds < 2, 0).otherwise(kinds).alias("mixed_dpi"), F.count_if(ok & F.col("dpi").isNull()).alias("missing_dpi"))


def label(value: Column) -> Column:
    """A display label: curated, else blanks for underscores, the first letter upper and the rest lower."""
    plain = F.trim(F.replace(value, F.lit("_"), F.lit(" ")))
    out = F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, 2, 1 << 30)))
    for name, text in LABELS.items():
        out = F.when(value == name, text).otherwise(out)
    return out


def unit_suffix(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, unit: mm or mm² if all rows are calibrated, px or px² if none is, empty if mixed or not a measure."""
    kinds = df.where(F.col("calibration_method").isNotNull()).agg(F.collect_set("calibration_method").alias("kinds"))  # a few methods
    one = F.when(F.col("kinds") == F.array(F.lit("scale_bar")), "mm").when(F.col("kinds") == F.array(F.lit("pixels")), "px").otherwise("")
    power = F.when(F.col("field").isin(*AREA_FIELDS), "²").otherwise("")
    named = kinds.select(one.alias("u"), F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    return named.select("field", F.when((F.col("u") != "") & F.col("field").isin(*LINEAR_FIELDS, *AREA_FIELDS), F.concat("u", power)).otherwise("").alias("unit"), label(F.col("field")).alias("label"))


def lithic_ids(df: DataFrame) -> DataFrame:
    return df.select("image_id").distinct().orderBy("image_id")


def drill_down(df: DataFrame, image_id: str) -> DataFrame:
    return df.where(F.col("image_id") == image_id).orderBy("ord")
