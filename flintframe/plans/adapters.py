"""Deterministic inputs for the operators, derived from the driver's tables; the same SQL runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The long metrics table: one lithic an order, a row for each surface and each feature (line item).
ASSEMBLAGE = """
SELECT image_id, surface_type, surface_feature, scar_count, technical_length, technical_width, total_area, perimeter,
  round(technical_length / technical_width, 2) AS aspect_ratio, top_area, bottom_area, left_area, right_area, vertical_symmetry, horizontal_symmetry,
  voronoi_num_cells, convex_hull_area, is_cortex, scar_complexity, has_arrow, calibration_method, pixels_per_mm, scale_confidence, ord
FROM (
  SELECT concat('lithic-', cast(o_orderkey AS varchar(20))) AS image_id, 'Dorsal' AS surface_type, 'Dorsal' AS surface_feature, coalesce(n_scars, 0) AS scar_count,
    cast(10 + o_orderkey % 97 AS double) AS technical_length, cast(5 + o_orderkey % 53 AS double) AS technical_width, o_totalprice AS total_area,
    o_totalprice / 4 AS perimeter, cast(o_custkey % 50 AS double) AS top_area, cast(o_custkey % 37 AS double) AS bottom_area,
    cast(o_orderkey % 41 AS double) AS left_area, cast(o_orderkey % 29 AS double) AS right_area,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE round(cast(o_custkey % 101 AS double) / 100, 2) END AS vertical_symmetry,
    round(cast(o_orderkey % 89 AS double) / 100, 2) AS horizontal_symmetry, coalesce(n_scars, 0) + 1 AS voronoi_num_cells, o_totalprice * (0.5E0 + 0.25E0 * (o_orderkey % 3)) AS convex_hull_area,
    false AS is_cortex, cast(NULL AS integer) AS scar_complexity, false AS has_arrow,
    CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' THEN 'scale_bar' ELSE 'pixels' END AS calibration_method,
    CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' THEN cast(1 + o_orderkey % 20 AS double) END AS pixels_per_mm,
    CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' THEN cast(o_orderkey % 11 AS double) / 10 END AS scale_confidence, 0 AS ord
  FROM {orders} o LEFT JOIN (SELECT l_orderkey, cast(sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 0 ELSE 1 END) AS integer) AS n_scars FROM {lineitem} GROUP BY l_orderkey) n ON o.o_orderkey = n.l_orderkey
  UNION ALL
  SELECT concat('lithic-', cast(o_orderkey AS varchar(20))), t, t, cast(NULL AS integer), cast(4 + o_orderkey % 61 AS double), cast(3 + o_orderkey % 31 AS double), o_totalprice * 0.5E0, o_totalprice / 4,
    NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, NULL, false,
    CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' THEN 'scale_bar' ELSE 'pixels' END, NULL, NULL, 1
  FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'Ventral' WHEN 'O' THEN 'Platform' ELSE 'Unclassified' END AS t FROM {orders}) x
  UNION ALL
  SELECT concat('lithic-', cast(l_orderkey AS varchar(20))), 'Dorsal', CASE WHEN cortex THEN concat('cortex ', cast(k AS varchar(20))) ELSE concat('scar ', cast(k AS varchar(20))) END, NULL,
    l_quantity, cast(1 + l_linenumber AS double), l_extendedprice * 0.25E0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, cortex,
    CASE WHEN cortex THEN NULL ELSE l_linenumber END, l_returnflag = 'R', NULL, NULL, NULL, cast(10 + k AS integer)
  FROM (SELECT *, l_returnflag = 'N' AND l_linestatus = 'O' AS cortex,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS k FROM {lineitem}) y
) z"""

#: Unclassified parents: the line items of an order with the sizes of their parts.
SURFACES = """
SELECT concat('lithic-', cast(l_orderkey AS varchar(20))) AS image_id,
  cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS integer) AS contour_id,
  cast(p_size AS double) AS technical_length, l_quantity AS technical_width, l_extendedprice AS area
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""

#: A forest of three levels: regions, their nations, and customers of these; images are regions.
HIERARCHY = """
SELECT concat('img-', cast(r_regionkey AS varchar(20))) AS image_id, cast(r_regionkey AS bigint) AS contour_id, cast(NULL AS bigint) AS parent_contour_id, 5000.0E0 + r_regionkey AS area FROM {region}
UNION ALL SELECT concat('img-', cast(n_regionkey AS varchar(20))), cast(100 + n_nationkey AS bigint), cast(n_regionkey AS bigint), cast(40 + n_nationkey AS double) FROM {nation}
UNION ALL SELECT concat('img-', cast(n_regionkey AS varchar(20))), cast(1000 + c_custkey AS bigint), cast(100 + c_nationkey AS bigint), abs(c_acctbal) / 10 FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""

#: The same without the nations of one region, so that its customers have no parent in the image.
ORPHANED = HIERARCHY.replace("FROM {nation}\nUNION", "FROM {nation} WHERE n_regionkey <> 1\nUNION")

#: Vertices of 64-gons around a grid, radius from the embedding; eight to an image. Unit vectors are exact thousandths.
VERTICES = """
SELECT concat('img-', cast(vec_id // 8 AS varchar(20))) AS image_id, cast(vec_id AS bigint) AS contour_id, i,
  cast(floor(200 + 170 * (vec_id % 4) + (80 + 60 * e) * ux / 1000) AS integer) AS x,
  cast(floor(200 + 170 * ((vec_id // 4) % 2) + (80 + 60 * e) * uy / 1000) AS integer) AS y
FROM (SELECT vec_id, i, cast(e AS double) AS e,
    cast(round(1000 * cos(2 * pi() * i / 64)) AS integer) AS ux, cast(round(1000 * sin(2 * pi() * i / 64)) AS integer) AS uy FROM {points}) q"""

#: Quadrilaterals of any four points, many of which cross themselves; eight to an image.
QUADS = """
SELECT concat('img-', cast(vec_id AS varchar(20))) AS image_id, cast(vec_id * 8 + i // 8 AS bigint) AS contour_id, cast(i % 8 // 2 AS integer) AS i,
  max(CASE WHEN i % 2 = 0 THEN cast(floor(500 + 1500 * cast(e AS double)) AS integer) END) AS x, max(CASE WHEN i % 2 = 1 THEN cast(floor(500 + 1500 * cast(e AS double)) AS integer) END) AS y
FROM {points} GROUP BY vec_id, i // 8, i % 8 // 2"""

#: 8 by 8 grey rasters, a pixel a row.
PIXELS = """
SELECT concat('img-', cast(vec_id AS varchar(20))) AS image_id, cast(i // 8 AS integer) AS y, cast(i % 8 AS integer) AS x,
  cast(greatest(0, least(255, floor((cast(e AS double) * 3 + 1) * 127.5E0))) AS integer) AS v FROM {points}"""

#: Grey rasters of 64 columns, a vector a row and up to 64 rows an image.
SHEETS = """
SELECT concat('sheet-', cast(vec_id // 64 AS varchar(20))) AS image_id, cast(vec_id % 64 AS integer) AS y, cast(i AS integer) AS x,
  cast(greatest(0, least(255, floor((cast(e AS double) * 3 + 1) * 127.5E0))) AS integer) AS v FROM {points}"""

MANIFEST = """
SELECT concat('lithic-', cast(c_custkey AS varchar(20))) AS image_id, c_custkey % 23 <> 0 AS ok,
  CASE WHEN c_custkey % 23 <> 0 AND c_custkey % 7 <> 0 THEN cast(150 * (1 + c_custkey % 4) AS integer) END AS dpi,
  CASE WHEN c_custkey % 23 = 0 THEN 'unreadable' END AS reason FROM {customer}"""

POINTS = {
    "spark": "(SELECT vec_id, i, e FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS i, e)",
    "duckdb": "(SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)",
}
TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "supplier", "embeddings")


def adapt(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the inputs above as a DataFrame."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql or t == "embeddings" and "{points}" in sql}
    return spark.sql(sql.replace("{points}", POINTS["spark"]).replace(" // ", " DIV ").replace("varchar(20)", "string"), **frames)


def duck(sql: str) -> str:
    """The same input as DuckDB SQL over the driver's views."""
    return sql.replace("{points}", POINTS["duckdb"]).format(**{t: t for t in TABLES})
