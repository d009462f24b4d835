"""Queries of the data layer and the statistics, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assemblage as A
from ..operators import statistics as S
from ..sources.metrics import COLUMNS
from . import adapters

Make = Callable[[DataFrame], DataFrame]
_VIEW = f"WITH a AS ({adapters.duck(adapters.ASSEMBLAGE)}), m AS ({adapters.duck(adapters.MANIFEST)}),\n"
_VIEW += "p AS (SELECT * FROM a WHERE surface_feature = surface_type), s AS (SELECT * FROM a WHERE surface_type = 'Dorsal' AND lower(surface_feature) LIKE 'scar %'),\n"
_VIEW += "d AS (SELECT * FROM p WHERE surface_type = 'Dorsal'),\n"
_VIEW += """sums AS (SELECT d.image_id, d.total_area AS dorsal_area, d.scar_count AS num_scars, d.calibration_method, total_scar_area, mean_scar_area, sd_scar_area,
  CASE WHEN total_scar_area IS NOT NULL THEN least(greatest(total_scar_area / nullif(d.total_area, 0), 0), 1) * 100 END AS coverage_pct, sd_scar_area / nullif(mean_scar_area, 0) AS cv
  FROM d LEFT JOIN (SELECT image_id, sum(total_area) AS total_scar_area, avg(total_area) AS mean_scar_area, stddev_samp(total_area) AS sd_scar_area FROM s GROUP BY image_id) q USING (image_id))
"""


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """df with doubles rounded, and minus zero as zero."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


FOUND: dict[str, tuple[Make, str]] = {
    "d01_parent_rows": (lambda a: A.parent_rows(a).select("image_id", "surface_type", "total_area"), "SELECT image_id, surface_type, round(total_area, 4) AS total_area FROM p"),
    "d02_dorsal_scars": (lambda a: A.dorsal_scars(a).select("image_id", "surface_feature", "total_area"), "SELECT image_id, surface_feature, round(total_area, 4) AS total_area FROM s"),
    "d03_scar_rows": (lambda a: A.scar_rows(a, with_arrows=True).select("image_id", "surface_feature"), "SELECT image_id, surface_feature FROM a WHERE surface_feature IS DISTINCT FROM surface_type AND lower(surface_feature) LIKE 'scar %' AND has_arrow"),
    "d04_cortex_rows": (lambda a: A.cortex_rows(a).select("image_id", "surface_feature"), "SELECT image_id, surface_feature FROM a WHERE is_cortex"),
    "d05_lenient_bool": (lambda a: a.select(A.as_bool(F.when(F.col("has_arrow"), " TRUE ").otherwise(F.lit("no"))).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n")), "SELECT has_arrow AS flag, count(*) AS n FROM a GROUP BY 1"),
    "d06_filter_metrics": (lambda a: A.filter_metrics(a, ["Dorsal", "Ventral"], ["scale_bar"]).select("image_id", "surface_feature"), "SELECT image_id, surface_feature FROM a WHERE surface_type IN ('Dorsal', 'Ventral') AND calibration_method = 'scale_bar'"),
    "d07_assemblage_summary": (A.summary, """SELECT count(DISTINCT image_id) AS n_lithics, count(DISTINCT CASE WHEN calibration_method = 'scale_bar' THEN image_id END) AS n_calibrated,
  round((SELECT avg(CASE WHEN has_arrow THEN 1.0 ELSE 0.0 END) FROM s), 4) AS arrow_detection_rate, round(count(DISTINCT CASE WHEN is_cortex THEN image_id END)::DOUBLE / count(DISTINCT image_id), 4) AS cortex_prevalence FROM a"""),
    "d07_surface_counts": (A.surface_counts, "SELECT surface_type, count(*) AS n_surfaces FROM p GROUP BY 1"),
    "d07_calibration_counts": (A.calibration_counts, "SELECT calibration_method, count(*) AS n_lithics FROM a WHERE ord = 0 GROUP BY 1"),
    "d09_low_confidence": (lambda a: A.overview(a).select("low_confidence_scales", "successful"), "SELECT count(DISTINCT CASE WHEN scale_confidence < 0.8 THEN image_id END) AS low_confidence_scales, count(DISTINCT image_id) AS successful FROM a"),
    "d10_quality_counts": (lambda a: A.overview(a).select("unclassified_surfaces", "zero_scar_lithics", "pixel_only_lithics"), """SELECT (SELECT count(*) FROM p WHERE surface_type = 'Unclassified') AS unclassified_surfaces,
  (SELECT count(*) FROM d WHERE scar_count = 0) AS zero_scar_lithics, (SELECT count(DISTINCT image_id) FROM a WHERE calibration_method = 'pixels') AS pixel_only_lithics"""),
    "d12_labels": (lambda a: a.select(F.explode(F.array(*[F.lit(c) for c in sorted(COLUMNS)])).alias("name")).distinct().select("name", A.label(F.col("name")).alias("label")), "SELECT name, CASE name WHEN 'image_id' THEN 'Image ID' WHEN 'centroid_x' THEN 'Centroid X' WHEN 'centroid_y' THEN 'Centroid Y' WHEN 'voronoi_num_cells' THEN 'Voronoi cells' ELSE upper(name[1]) || lower(replace(name[2:], '_', ' ')) END AS label FROM (SELECT DISTINCT unnest([" + ", ".join(f"'{c}'" for c in sorted(COLUMNS)) + "]) AS name FROM a) q"),
    "d13_unit_suffix": (lambda a: A.unit_suffix(A.filter_metrics(a, [], ["scale_bar"]), ["perimeter", "total_area", "aspect_ratio"]).unionByName(A.unit_suffix(a, ["max_width"])).unionByName(A.unit_suffix(A.filter_metrics(a, [], ["pixels"]), ["cortex_area"])),
        "SELECT * FROM (VALUES ('perimeter', 'mm', 'Perimeter'), ('total_area', 'mm²', 'Total area'), ('aspect_ratio', '', 'Aspect ratio'), ('max_width', '', 'Max width'), ('cortex_area', 'px²', 'Cortex area')) v(field, unit, label)"),
    "d14_drill_down": (lambda a: A.drill_down(a, "lithic-7").select("image_id", "surface_feature", "ord"), "SELECT image_id, surface_feature, ord FROM a WHERE image_id = 'lithic-7'"),
    "d14_lithic_ids": (A.lithic_ids, "SELECT DISTINCT image_id FROM a"),
    "p01_top_filter": (lambda a: S.top_filter(a).select("image_id", "surface_type"), "SELECT image_id, surface_type FROM d"),
    "p02_aspect_by_surface": (S.aspect_by_surface, """SELECT surface_type, n, round(least, 4) AS least, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(most, 4) AS most,
  CASE WHEN n <= 20 THEN 'large' WHEN n <= 100 THEN 'medium' ELSE 'small' END AS point_style,
  row_number() OVER (ORDER BY CASE surface_type WHEN 'Dorsal' THEN 0 WHEN 'Ventral' THEN 1 WHEN 'Platform' THEN 2 WHEN 'Lateral' THEN 3 ELSE 4 END, surface_type)::INTEGER AS position
  FROM (SELECT surface_type, count(*) AS n, min(aspect_ratio) AS least, quantile_cont(aspect_ratio, 0.25) AS q1, median(aspect_ratio) AS median, quantile_cont(aspect_ratio, 0.75) AS q3, max(aspect_ratio) AS most FROM p WHERE aspect_ratio IS NOT NULL GROUP BY 1) q"""),
    "p03_perimeters": (S.perimeters, "SELECT image_id, round(perimeter, 4) AS perimeter, image_id || ' (' || surface_type || ')' AS label FROM p WHERE perimeter IS NOT NULL"),
    "p04_dimension_pairs": (lambda a: S.pairs(a, "technical_width", "technical_length"), "SELECT image_id, surface_type, technical_width, technical_length FROM p WHERE technical_width IS NOT NULL AND technical_length IS NOT NULL"),
    "p05_asymmetry": (S.asymmetry, "SELECT image_id, round((top_area - bottom_area) / (top_area + bottom_area), 4) + 0.0 AS vertical_bias, round((right_area - left_area) / (left_area + right_area), 4) + 0.0 AS horizontal_bias FROM d WHERE top_area + bottom_area > 0 AND left_area + right_area > 0"),
    "p05_asymmetry_axis": (S.asymmetry_axis, "SELECT round(greatest(0.1, 1.2 * max(greatest(abs((top_area - bottom_area) / (top_area + bottom_area)), abs((right_area - left_area) / (left_area + right_area))))), 4) AS axis FROM d WHERE top_area + bottom_area > 0 AND left_area + right_area > 0"),
    "p06_symmetry_ecdf": (S.symmetry_ecdf, """SELECT measure, round(value, 4) AS value, row_number() OVER (PARTITION BY measure ORDER BY value) AS rank, round(row_number() OVER (PARTITION BY measure ORDER BY value)::DOUBLE / count(*) OVER (PARTITION BY measure), 4) AS share
  FROM (SELECT 'vertical_symmetry' AS measure, vertical_symmetry AS value FROM d UNION ALL SELECT 'horizontal_symmetry', horizontal_symmetry FROM d) q WHERE value IS NOT NULL"""),
    "p06_symmetry_summary": (S.symmetry_summary, "SELECT round(median(vertical_symmetry), 4) AS vertical_median, round(median(horizontal_symmetry), 4) AS horizontal_median, round(least(min(vertical_symmetry), min(horizontal_symmetry)), 4) AS x_floor FROM d"),
    "p07_scar_summary": (S.scar_summary, "SELECT image_id, round(dorsal_area, 4) AS dorsal_area, num_scars, calibration_method, round(total_scar_area, 4) AS total_scar_area, round(mean_scar_area, 4) AS mean_scar_area, round(sd_scar_area, 4) + 0.0 AS sd_scar_area, round(coverage_pct, 4) AS coverage_pct, round(cv, 4) + 0.0 AS cv FROM sums"),
    "p08_linear_fit": (lambda a: S.fit_line(S.scar_summary(a), "dorsal_area", "num_scars"), """, f AS (SELECT regr_slope(num_scars::DOUBLE, dorsal_area) AS slope, regr_intercept(num_scars::DOUBLE, dorsal_area) AS intercept, min(dorsal_area) AS lo, max(dorsal_area) AS hi FROM sums)
  SELECT k::INTEGER AS k, round(lo + (hi - lo) * k / 49, 4) AS x, round(slope * (lo + (hi - lo) * k / 49) + intercept, 4) + 0.0 AS y FROM f, range(50) r(k)"""),
    "p09_outliers": (lambda a: S.outliers(S.scar_summary(a), "dorsal_area", "num_scars").select("image_id", "is_outlier"), """, f AS (SELECT regr_slope(num_scars::DOUBLE, dorsal_area) AS slope, regr_intercept(num_scars::DOUBLE, dorsal_area) AS intercept FROM sums), r AS (SELECT image_id, num_scars - (slope * dorsal_area + intercept) AS e FROM sums, f)
  SELECT image_id, abs(e) > 2 * (SELECT stddev_pop(e) FROM r) AS is_outlier FROM r"""),
    "p10_count_vs_area": (lambda a: S.outliers(S.scar_summary(a), "dorsal_area", "num_scars").where("is_outlier").select("image_id", "dorsal_area", "num_scars", "residual"), """, f AS (SELECT regr_slope(num_scars::DOUBLE, dorsal_area) AS slope, regr_intercept(num_scars::DOUBLE, dorsal_area) AS intercept FROM sums), r AS (SELECT *, num_scars - (slope * dorsal_area + intercept) AS e FROM sums, f)
  SELECT image_id, round(dorsal_area, 4) AS dorsal_area, num_scars, round(e, 4) AS residual FROM r WHERE abs(e) > 2 * (SELECT stddev_pop(e) FROM r)"""),
    "p11_coverage_vs_area": (lambda a: S.coverage(S.scar_summary(a)), "SELECT count(*) AS n, round(median(coverage_pct), 4) AS median_coverage, round(max(dorsal_area), 4) AS largest FROM sums WHERE coverage_pct IS NOT NULL"),
    "p12_complexity_histogram": (lambda a: S.integer_histogram(S.complexity(a), "scar_complexity"), "SELECT scar_complexity::BIGINT AS bin, count(*) AS n FROM s WHERE scar_complexity IS NOT NULL GROUP BY 1"),
    "p13_complexity_grid": (S.complexity_grid, """, k AS (SELECT image_id, median(scar_complexity) AS median FROM s GROUP BY 1 HAVING count(*) >= 2), c AS (SELECT image_id, scar_complexity, count(*) AS n, any_value(median) AS median FROM s JOIN k USING (image_id) GROUP BY 1, 2)
  SELECT image_id, scar_complexity, n, median, round(6 + (n - 1) * 22 / ((SELECT max(n) FROM c) - 1)::DOUBLE, 4) AS size FROM c"""),
    "p14_scar_size_ecdf": (lambda a: S.ecdf(S.scar_values(a, "total_area"), "total_area"), "SELECT round(total_area, 4) AS total_area, row_number() OVER (ORDER BY total_area) AS rank, round(row_number() OVER (ORDER BY total_area)::DOUBLE / count(*) OVER (), 4) AS share FROM s WHERE total_area > 0"),
    "p15_scar_aspect_ecdf": (lambda a: S.ecdf(S.scar_values(a, "aspect_ratio"), "aspect_ratio"), "SELECT round(aspect_ratio, 4) AS aspect_ratio, row_number() OVER (ORDER BY aspect_ratio) AS rank, round(row_number() OVER (ORDER BY aspect_ratio)::DOUBLE / count(*) OVER (), 4) AS share FROM s WHERE aspect_ratio > 0"),
    "p16_cv_vs_count": (lambda a: S.cv_vs_count(a), "SELECT image_id, num_scars, round(cv, 4) + 0.0 AS cv FROM sums WHERE num_scars >= 2 AND cv IS NOT NULL"),
    "p17_voronoi_histogram": (lambda a: S.integer_histogram(A.parent_rows(a).where("surface_type = 'Dorsal'"), "voronoi_num_cells"), "SELECT voronoi_num_cells::BIGINT AS bin, count(*) AS n FROM d GROUP BY 1"),
    "p18_hull_vs_dorsal": (lambda a: S.hull_ratios(a).select("image_id", "total_area", "convex_hull_area"), "SELECT image_id, round(total_area, 4) AS total_area, round(convex_hull_area, 4) AS convex_hull_area FROM d WHERE convex_hull_area > 0"),
    "p19_hull_ratio": (lambda a: S.ecdf(S.hull_ratios(a).select(F.round("ratio", 4).alias("ratio")), "ratio").select("ratio", (F.col("rank") - 1).alias("rank")), "SELECT round(convex_hull_area / total_area, 4) AS ratio, row_number() OVER (ORDER BY round(convex_hull_area / total_area, 4)) - 1 AS rank FROM d WHERE convex_hull_area > 0"),
    "p20_cortex_summary": (S.cortex_summary, "SELECT count(*) FILTER (is_cortex) AS n_regions, count(DISTINCT CASE WHEN is_cortex THEN image_id END) AS n_with_cortex, count(DISTINCT image_id) AS n_lithics, round(count(DISTINCT CASE WHEN is_cortex THEN image_id END) * 100.0 / count(DISTINCT image_id), 4)::DOUBLE AS prevalence_pct FROM a"),
    "p20_cortex_areas": (lambda a: S.histogram(A.cortex_rows(a), "total_area"), """, c AS (SELECT total_area AS v, min(total_area) OVER () AS lo, max(total_area) OVER () AS hi FROM a WHERE is_cortex)
  SELECT least(14, floor((v - lo) * 15 / (hi - lo)))::BIGINT AS bin, count(*) AS n, round(min(v), 4) AS least, round(max(v), 4) AS most FROM c GROUP BY 1"""),
    "p20_cortex_percentages": (lambda a: S.histogram(S.cortex_percentages(a), "cortex_percentage"), """, c AS (SELECT v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM (SELECT round(k.total_area / d.total_area * 100, 2) AS v FROM a k JOIN d USING (image_id) WHERE k.is_cortex) z)
  SELECT least(14, floor((v - lo) * 15 / (hi - lo)))::BIGINT AS bin, count(*) AS n, round(min(v), 4) AS least, round(max(v), 4) AS most FROM c GROUP BY 1"""),
    "p21_caption": (lambda a: S.caption(A.dorsal_scars(a), "total_area"), """, q AS (SELECT median(total_area) AS median, quantile_cont(total_area, 0.25) AS q1, quantile_cont(total_area, 0.75) AS q3, count(*) AS n FROM s),
  f AS (SELECT *, [CASE WHEN v = floor(v) THEN format('{:,}', v::BIGINT) ELSE format('{:,}', trunc(v::DECIMAL(28,6)::DECIMAL(24,2))::BIGINT) || '.' || lpad((abs(v::DECIMAL(28,6)::DECIMAL(24,2) * 100)::BIGINT % 100)::VARCHAR, 2, '0') END FOR v IN [median, q1, q3]] AS t FROM q)
  SELECT round(median, 4) AS median, round(q1, 4) AS q1, round(q3, 4) AS q3, n, 'Median: ' || t[1] || ' · IQR: ' || t[2] || '–' || t[3] || ' · N: ' || n AS text FROM f"""),
}


def _query(make: Make) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(make(adapters.adapt(spark, sf_dir, adapters.ASSEMBLAGE)))


def d08_overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.overview(adapters.adapt(spark, sf_dir, adapters.ASSEMBLAGE), adapters.adapt(spark, sf_dir, adapters.MANIFEST))


def d11_dpi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dpi_counts(adapters.adapt(spark, sf_dir, adapters.MANIFEST))


_DPI = "count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, CASE WHEN count(DISTINCT dpi) < 2 THEN 0 ELSE count(DISTINCT dpi) END AS mixed_dpi, count(*) FILTER (ok AND dpi IS NULL) AS missing_dpi"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(make) for name, (make, _) in FOUND.items()} | {"d08_overview_counts": d08_overview_counts, "d11_dpi_counts": d11_dpi_counts}
ORACLES: dict[str, str] = {name: _VIEW + sql for name, (_, sql) in FOUND.items()} | {
    "d11_dpi_counts": _VIEW + f"q AS (SELECT 1) SELECT {_DPI} FROM m".replace("q AS (SELECT 1) ", ""),
    "d08_overview_counts": _VIEW + f"""SELECT count(DISTINCT CASE WHEN scale_confidence < 0.8 THEN image_id END) AS low_confidence_scales, (SELECT count(*) FROM p WHERE surface_type = 'Unclassified') AS unclassified_surfaces,
  (SELECT count(*) FROM d WHERE scar_count = 0) AS zero_scar_lithics, count(DISTINCT CASE WHEN calibration_method = 'pixels' THEN image_id END) AS pixel_only_lithics, count(DISTINCT image_id) AS n_lithics, (SELECT count(*) FROM p) AS n_surfaces,
  (SELECT count(*) FROM s) AS n_scars, (SELECT count(*) FROM s WHERE has_arrow) AS n_scars_with_arrows, count(*) FILTER (is_cortex) AS n_cortex_regions, any_value(q.successful) AS successful, any_value(q.failed) AS failed, any_value(q.mixed_dpi) AS mixed_dpi, any_value(q.missing_dpi) AS missing_dpi
  FROM a, (SELECT {_DPI} FROM m) q""",
}
