"""Surface classes of parents, labels of their features, cortex relabelling, and export rows and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..sources.metrics import COLUMNS
from .assemblage import AREA_FIELDS, LINEAR_FIELDS

TOLERANCE = 0.1
LINEAR = LINEAR_FIELDS
AREAS = (*AREA_FIELDS, "area")
VORONOI = ("voronoi_num_cells", "convex_hull_width", "convex_hull_height", "convex_hull_area", "voronoi_cell_area")
SYMMETRY = ("top_area", "bottom_area", "left_area", "right_area", "vertical_symmetry", "horizontal_symmetry")


def _image() -> WindowSpec:
    """All rows of an image, in the order that numbers follow too, so that one sort serves all steps."""
    return Window.partitionBy("image_id").orderBy("contour_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _typed(df: DataFrame, tolerance: float, parent: Column) -> tuple[DataFrame, Column]:
    """df with what the classes of its parents need beside each row, and the class of a parent as a column."""
    w = _image()
    length, width, area, at = (F.col(c) for c in ("technical_length", "technical_width", "area", "contour_id"))
    df = df.withColumn("__d", F.max(F.when(parent, F.struct(area, (-at).alias("m"), length.alias("l"), width.alias("w")))).over(w))
    d = F.col("__d")
    near = lambda x, y, t=tolerance: F.abs(x - y) <= t * y
    df = df.withColumn("__t", F.when(parent & (at == -d["m"]), "Dorsal"))
    free = parent & F.col("__t").isNull()
    alike = free & near(length, d["l"]) & near(width, d["w"]) & near(area, d["area"])
    df = df.withColumn("__v", F.min(F.when(alike, at)).over(w))
    df = df.withColumn("__t", F.coalesce("__t", F.when(parent & (at == F.col("__v")), "Ventral")))
    smaller = free & (length < d["l"]) & (width < d["w"])
    df = df.withColumn("__p", F.min(F.when(smaller, F.struct(area, at.alias("at"), length.alias("l")))).over(w))
    p = F.col("__p")
    df = df.withColumn("__t", F.coalesce("__t", F.when(parent & (at == p["at"]), "Platform")))
    beside = near(length, d["l"]) & ~near(length, p["l"]) & (width != d["w"])
    alone = p.isNull() & F.col("__v").isNotNull() & near(length, d["l"]) & ~near(width, d["w"])
    side = free & F.when(p.isNotNull(), beside).otherwise(alone)
    df = df.withColumn("__l", F.min(F.when(side, at)).over(w))
    return df, F.coalesce("__t", F.when(at == F.col("__l"), "Lateral"), F.lit("Unclassified"))


def classify(parents: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """parents (image_id, contour_id, technical_length, technical_width, area) with surface_type.

    In turn: Dorsal has the greatest area; Ventral is the first like it in length, width and area; Platform has the
    least area of those shorter and narrower; Lateral is the first as long as the Dorsal but unlike the Platform (or,
    without one but with a Ventral, of another width); the rest are Unclassified. An only parent is Dorsal. First
    means the smallest contour_id. One shuffle by image serves all steps.
    """
    df, surface = _typed(parents, tolerance, F.lit(True))
    return df.select(*parents.columns, surface.alias("surface_type"))


def classify_and_label(contours: DataFrame, tolerance: float = TOLERANCE, enabled: bool = True) -> DataFrame:
    """Parents (null parent_contour_id) and children in one table, with surface_type and surface_feature.

    The same classes as classify() and labels as label_children(): a parent's feature is its type, and features of
    Ventral and Platform surfaces go. A child whose parent is not in the image has neither. All of it takes one
    shuffle by image and one sort. With enabled off, parents are Unclassified.
    """
    parent = F.col("parent_contour_id").isNull()
    df, surface = _typed(contours, tolerance, parent)
    df = df.withColumn("__own", F.when(parent, surface if enabled else F.lit("Unclassified")))
    types = F.map_from_entries(F.collect_list(F.when(parent, F.struct(F.col("contour_id").cast("bigint"), "__own"))).over(_image()))
    df = df.withColumn("surface_type", F.coalesce("__own", types[F.col("parent_contour_id").cast("bigint")]))
    df = df.where(parent | F.coalesce(~F.col("surface_type").isin("Ventral", "Platform"), F.lit(True)))
    df = df.withColumn("__kind", F.when(~parent & F.col("surface_type").isNotNull(), F.when(F.col("surface_type") == "Lateral", "edge").otherwise("scar")))
    so_far = Window.partitionBy("image_id").orderBy("contour_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.when(F.col("__kind") == "edge", F.count_if(F.col("__kind") == "edge").over(so_far)).otherwise(F.count_if(F.col("__kind") == "scar").over(so_far))
    return df.select(*contours.columns, "surface_type", F.when(parent, F.col("surface_type")).when(F.col("__kind").isNotNull(), F.concat_ws(" ", "__kind", n)).alias("surface_feature"))


def label_children(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children (image_id, contour_id, parent_contour_id, ...) with surface_type and surface_feature.

    Features of the Dorsal and of unclassified surfaces are ``scar N``, of the Lateral ``edge N``, numbered in the
    image by contour_id. Those of Ventral and Platform go; orphans stay without a label.
    """
    up = parents.select("image_id", F.col("contour_id").alias("parent_contour_id"), "surface_type")
    joined = children.join(up, ["image_id", "parent_contour_id"], "left").where(F.coalesce(~F.col("surface_type").isin("Ventral", "Platform"), F.lit(True)))
    kind = F.when(F.col("surface_type").isNull(), None).when(F.col("surface_type") == "Lateral", "edge").otherwise("scar")
    numbered = joined.withColumn("__kind", kind).withColumn("__n", F.row_number().over(Window.partitionBy("image_id", "__kind").orderBy("contour_id")))
    return numbered.select(*children.columns, "surface_type", F.when(F.col("__kind").isNotNull(), F.concat_ws(" ", "__kind", "__n")).alias("surface_feature"))


def label_cortex(features: DataFrame, parents: DataFrame) -> DataFrame:
    """features (with cortex flag is_cortex) relabelled: ``cortex N`` in the image, the rest renumbered by surface.

    Adds cortex_area and cortex_percentage of the parent's area.
    """
    up = parents.select("image_id", F.col("contour_id").alias("parent_contour_id"), F.col("area").alias("__pa"))
    kind = F.when(F.col("is_cortex"), "cortex").otherwise(F.split("surface_feature", " ")[0])
    joined = features.join(up, ["image_id", "parent_contour_id"], "left").withColumn("__kind", kind)
    n = F.row_number().over(Window.partitionBy("image_id", "__kind").orderBy("contour_id"))
    out = joined.withColumn("surface_feature", F.when(F.col("__kind").isNotNull(), F.concat_ws(" ", "__kind", n)))
    share = F.round(F.col("area") / F.nullif("__pa", F.lit(0.0)) * 100, 2)
    return out.select(*features.columns, F.when(F.col("is_cortex"), F.col("area")).alias("cortex_area"), F.when(F.col("is_cortex"), share).alias("cortex_percentage"))


def cortex_totals(features: DataFrame, digits: int = 2) -> DataFrame:
    """By image: total area, number and mean area of cortex regions."""
    own = features.where("is_cortex").groupBy("image_id")
    return own.agg(F.round(F.sum("area"), digits).alias("total_cortex_area"), F.count(F.lit(1)).alias("cortex_count"), F.round(F.avg("area"), digits).alias("average_cortex_area"))


def is_cortex(stippling: Column, variance: Column, edges: Column, sensitivity: str = "medium") -> Column:
    """All three texture measures over their limits (fixed values by sensitivity)."""
    s, v, e = {"low": (0.4, 200, 0.1), "medium": (0.2, 100, 0.05), "high": (0.1, 50, 0.02)}[sensitivity]
    return F.coalesce((stippling > s) & (variance > v) & (edges > e), F.lit(False))


def to_millimetres(rows: DataFrame, pixels_per_mm: Column) -> DataFrame:
    """rows with lengths divided by the factor and areas by its square, two digits; unchanged where it is not positive."""
    def conv(c: str, by: Column) -> Column:
        return F.when(pixels_per_mm > 0, F.round(F.col(c) / by, 2)).otherwise(F.col(c))

    return rows.withColumns({c: conv(c, pixels_per_mm) for c in LINEAR if c in rows.columns} | {c: conv(c, pixels_per_mm * pixels_per_mm) for c in AREAS if c in rows.columns})


def metric_rows(parents: DataFrame, features: DataFrame) -> DataFrame:
    """The long table: a row a surface (feature = type, with its scar count if Dorsal), then a row a feature.

    Columns of the metrics table that the inputs have come along.
    """
    more = [c for c in COLUMNS if c not in ("image_id", "surface_type", "surface_feature", "scar_count", "total_area", "technical_length", "technical_width")]
    own = parents.select("image_id", "surface_type", F.col("surface_type").alias("surface_feature"), F.lit(True).alias("__parent"), "contour_id", F.lit(None).cast("int").alias("parent_contour_id"),
                         F.col("area").alias("total_area"), "technical_length", "technical_width", *[c for c in more if c in parents.columns])
    rest = features.select("image_id", F.coalesce("surface_type", F.lit("NA")).alias("surface_type"), "surface_feature", F.lit(False).alias("__parent"), "contour_id", "parent_contour_id",
                           F.col("area").alias("total_area"), *[c for c in more if c in features.columns])
    return _counted(own.unionByName(rest, allowMissingColumns=True))


def rows_of(labelled: DataFrame) -> DataFrame:
    """The long table from classify_and_label(), in place: no further shuffle."""
    parent = F.col("parent_contour_id").isNull()
    more = [c for c in COLUMNS if c in labelled.columns and c not in ("image_id", "surface_type", "surface_feature", "scar_count", "total_area", "technical_length", "technical_width")]
    only = lambda c: F.when(F.col("__parent"), F.col(c)).alias(c)
    return _counted(labelled.withColumn("__parent", parent).select(
        "image_id", F.when(parent, F.col("surface_type")).otherwise(F.coalesce("surface_type", F.lit("NA"))).alias("surface_type"), "surface_feature", "__parent", "contour_id",
        "parent_contour_id", F.col("area").alias("total_area"), only("technical_length"), only("technical_width"), *more))


def _counted(rows: DataFrame) -> DataFrame:
    """rows with scar_count on the Dorsal surface in place of __parent."""
    scars = F.count_if(~F.col("__parent") & F.lower("surface_feature").contains("scar")).over(_image()).cast("int")
    count = F.when(F.col("__parent") & (F.col("surface_type") == "Dorsal"), scars)
    return rows.select("image_id", "surface_type", "surface_feature", count.alias("scar_count"), *[c for c in rows.columns if c not in ("image_id", "surface_type", "surface_feature", "__parent")])


def documents(rows: DataFrame) -> DataFrame:
    """One nested document a lithic, by one grouping: schema_version, calibration, and surfaces by contour_id with their features.

    Fields that rows lack are null. Blocks for cells and symmetry are on the Dorsal surface only, convexity on the
    Lateral only; orphans are in no surface.
    """
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast(COLUMNS[c])
    field = lambda *names: [has(c).alias(c) for c in names]
    is_surface = F.col("parent_contour_id").isNull() & (F.col("surface_feature") == F.col("surface_type"))
    flag = lambda c: F.coalesce(has(c), F.lit(False)).alias(c)
    feature = F.struct("contour_id", "surface_feature", "total_area", *field("centroid_x", "centroid_y", "max_width", "max_length", "aspect_ratio", "voronoi_cell_area", "scar_complexity", "cortex_area", "cortex_percentage", "arrow_angle"), flag("is_cortex"), flag("has_arrow"))
    on = lambda kind, value: F.when(F.col("surface_type") == kind, value)
    surface = F.struct(
        "contour_id", "surface_type", "surface_feature", "scar_count", "total_area",
        *field("centroid_x", "centroid_y", "technical_width", "technical_length", "max_width", "max_length", "aspect_ratio", "perimeter", "distance_to_max_width"),
        on("Dorsal", F.struct(*field(*VORONOI))).alias("voronoi"), on("Dorsal", F.struct(*field(*SYMMETRY))).alias("symmetry"), on("Lateral", has("lateral_convexity")).alias("lateral_convexity"))
    grouped = rows.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.when(is_surface, surface))).alias("__s"), F.array_sort(F.collect_list(F.when(~is_surface, F.struct(F.col("parent_contour_id").alias("of"), feature.alias("f"))))).alias("__f"),
        *[F.first(has(c), ignorenulls=True).alias(c) for c in ("calibration_method", "pixels_per_mm", "scale_confidence")])
    under = lambda s: F.transform(F.filter("__f", lambda f: f["of"] == s["contour_id"]), lambda f: f["f"])
    calibration = F.struct(F.col("calibration_method").alias("method"), "pixels_per_mm", "scale_confidence")
    return grouped.where(F.size("__s") > 0).select("image_id", F.lit(1).alias("schema_version"), calibration.alias("calibration"), F.transform("__s", lambda s: s.withField("features", under(s))).alias("surfaces"))


def flatten_documents(docs: DataFrame) -> DataFrame:
    """A row a feature of each surface, one without a feature where there is none."""
    each = docs.select("image_id", F.explode("surfaces").alias("s")).select("image_id", "s.surface_type", F.explode_outer("s.features").alias("f"))
    return each.select("image_id", "surface_type", F.col("f.surface_feature").alias("surface_feature"), F.col("f.total_area").alias("total_area"))


def mean_scar_area(rows: DataFrame) -> DataFrame:
    """Mean area of scars by lithic, with the scar count of its Dorsal surface."""
    scars = rows.where(F.lower("surface_feature").startswith("scar ")).groupBy("image_id").agg(F.avg("total_area").alias("mean_scar_area"))
    return rows.where((F.col("surface_type") == "Dorsal") & (F.col("surface_feature") == "Dorsal")).select("image_id", "scar_count").join(scars, "image_id")
