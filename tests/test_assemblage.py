import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flintframe.operators import assemblage as A
from flintframe.operators import statistics as S

COLS = "image_id string, surface_type string, surface_feature string, scar_count int, total_area double, is_cortex string, has_arrow string, scar_complexity int, calibration_method string, scale_confidence string, ord int"
ROWS = [
    ("a.png", "Dorsal", "Dorsal", 2, 100.0, "False", "False", None, "scale_bar", "0.5", 0), ("a.png", "Dorsal", "scar 1", None, 30.0, "False", "True", 1, "scale_bar", "0.5", 1),
    ("a.png", "Dorsal", "scar 2", None, 20.0, "False", "False", 1, "scale_bar", "0.5", 2), ("a.png", "Dorsal", "cortex 1", None, 10.0, "True", None, None, "scale_bar", "x", 3),
    ("a.png", "Ventral", "Ventral", None, 90.0, "False", None, None, "scale_bar", None, 4), ("b.png", "Dorsal", "Dorsal", 0, 50.0, "False", "False", None, "pixels", None, 0),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, COLS)


def test_summary(rows):
    got = A.summary(rows).first()
    assert (got.n_lithics, got.n_calibrated, got.arrow_detection_rate, got.cortex_prevalence) == (2, 1, 0.5, 0.5)
    assert {r.surface_type: r.n_surfaces for r in A.surface_counts(rows).collect()} == {"Dorsal": 2, "Ventral": 1}
    assert {r.calibration_method: r.n_lithics for r in A.calibration_counts(rows).collect()} == {"scale_bar": 1, "pixels": 1}


def test_overview(rows, spark):
    got = A.overview(rows).first().asDict()
    assert got == {"low_confidence_scales": 1, "unclassified_surfaces": 0, "zero_scar_lithics": 1, "pixel_only_lithics": 1, "n_lithics": 2, "n_surfaces": 3, "n_scars": 2, "n_scars_with_arrows": 1, "n_cortex_regions": 1, "successful": 2, "failed": 0, "mixed_dpi": 0, "missing_dpi": 0}
    status = spark.createDataFrame([("a", True, 300, None), ("b", True, 600, None), ("c", True, None, None), ("d", False, None, "bad")], "image_id string, ok boolean, dpi int, reason string")
    got = A.overview(rows, status).first()
    assert (got.successful, got.failed, got.mixed_dpi, got.missing_dpi) == (3, 1, 2, 1)


def test_empty(rows):
    none = rows.limit(0)
    got = A.summary(none).first()
    assert (got.n_lithics, got.arrow_detection_rate, got.cortex_prevalence) == (0, 0.0, 0.0)
    assert S.scar_summary(none).isEmpty() and S.ecdf(none, "total_area").isEmpty() and S.fit_line(none, "total_area", "scar_count").isEmpty()


def test_scar_summary(rows):
    got = {r.image_id: r for r in S.scar_summary(rows).collect()}
    assert got["a.png"].coverage_pct == 50 and got["a.png"].cv == pytest.approx(math.sqrt(50) / 25)
    assert got["b.png"].cv is None and got["b.png"].num_scars == 0


def test_labels(spark):
    df = spark.createDataFrame([("total_area",), ("voronoi_num_cells",), ("is_cortex",)], "f string")
    assert [r[0] for r in df.select(A.label(F.col("f"))).collect()] == ["Total area", "Voronoi cells", "Is cortex"]


def test_ecdf_and_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 1, 2, 2, 10)], "v double")
    got = sorted((r.v, r.rank, r.share) for r in S.ecdf(df, "v").collect())
    assert got == [(1, 1, 0.2), (2, 2, 0.4), (2, 3, 0.6), (3, 4, 0.8), (10, 5, 1.0)]
    pts = spark.createDataFrame([(float(k), float(2 * k + (40 if k == 5 else 0))) for k in range(20)], "x double, y double")
    assert [r.x for r in S.outliers(pts, "x", "y").where("is_outlier").collect()] == [5.0]
    assert S.outliers(pts.limit(2), "x", "y").where("is_outlier").isEmpty()
    assert S.caption(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double"), "v").first().q1 == 1.75


def test_ranks_of_many_values(spark):
    """Ranks run from 1 without gap or overlap, though the quantiles that split the values are approximate."""
    rows = spark.range(0, 600_000, 1, 16).select(F.pmod(F.xxhash64("id"), F.lit(300_000)).cast("double").alias("v"))
    ranks = S.ecdf(rows, "v").select("rank", F.row_number().over(Window.orderBy("v", "rank")).alias("k"))
    assert ranks.agg(F.count(F.lit(1)), F.countDistinct("rank"), F.count_if(F.col("rank") != F.col("k"))).first() == (600_000, 600_000, 0)
