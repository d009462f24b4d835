import random

import pytest
from pyspark.sql import functions as F

from flintframe.functions import geometry as G
from flintframe.operators import arrows, contours, raster, spatial, surfaces
from flintframe.plans import contour_queries

RECT = [(50, 50), (99, 50), (99, 109), (50, 109)]
POLY = "image_id string, contour_id bigint, contour array<struct<x:int,y:int>>"


def polygons(spark, shapes):
    return spark.createDataFrame([("i", k, p) for k, p in enumerate(shapes)], POLY)


def chain(points):
    points = sorted(set(points))
    if len(points) < 3:
        return points
    out = []
    for part in (points, points[::-1]):
        half = []
        for v in part:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (v[1] - half[-2][1]) - (half[-1][1] - half[-2][1]) * (v[0] - half[-2][0]) <= 0:
                half.pop()
            half.append(v)
        out += half[:-1]
    return out


def test_measures(spark):
    m = contours.measures(polygons(spark, [RECT, [(0, 0), (0, 9)], [(1, 1)]])).orderBy("contour_id").collect()
    assert (m[0].area, m[0].perimeter, m[0].centroid_x, m[0].centroid_y) == (49 * 59, 216, 74.5, 79.5)
    assert (m[0].technical_length, m[0].technical_width, m[0].aspect_ratio) == (59, 49, 1.2)
    assert m[0].max_length == round((49**2 + 59**2) ** 0.5, 2)
    assert m[1].area == 0 and m[1].technical_width == 0 and m[1].centroid_y == 5 and m[2].max_length == 0


def test_hull(spark):
    rnd = random.Random(3)
    shapes = [[(rnd.randrange(12), rnd.randrange(12)) for _ in range(n)] for n in (1, 2, 3, 5, 8, 13, 30, 60) for _ in range(3)] + [[(k, 2 * k) for k in range(6)]]
    got = polygons(spark, shapes).orderBy("contour_id").select(G.hull(F.col("contour")).alias("h")).collect()
    for s, r in zip(shapes, got, strict=True):
        assert [tuple(v) for v in r.h] == chain(s)


def test_contains_and_raster(spark):
    rnd = random.Random(4)
    shapes = [RECT, [(0, 0), (10, 0), (10, 10), (5, 3), (0, 10)], [(2, 2), (9, 2), (9, 2), (4, 7)]] + [[(rnd.randrange(15), rnd.randrange(15)) for _ in range(6)] for _ in range(8)]
    polys = polygons(spark, shapes)
    got = {(r.contour_id, r.x, r.y) for r in spatial.rasterize(polys).collect()}
    grid = polys.where("contour_id > 0").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(15))))
    want = {(r.contour_id, r.x, r.y) for r in grid.where(G.contains(F.col("contour"), F.col("x"), F.col("y"))).collect()}
    assert {g for g in got if g[0] > 0} == want
    assert sum(g[0] == 0 for g in got) == 50 * 60


def test_adjacency(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    shapes = [square(0, 0, 20), square(30, 0, 20), square(200, 200, 20), square(5, 5, 4), [(215, 190), (215, 240), (216, 240)], [(1, 1), (2, 2)]]
    got = {r.contour_id: r.scar_complexity for r in spatial.scar_complexity(polygons(spark, shapes)).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0}


def test_symmetry_invariants(spark):
    mask = spatial.rasterize(polygons(spark, [RECT]))
    r = spatial.symmetry(mask, spark.createDataFrame([("i", 0, 74.5, 79.5)], "image_id string, contour_id bigint, cx double, cy double")).first()
    assert r.top_area + r.bottom_area == r.left_area + r.right_area == mask.count()
    assert 0 <= r.vertical_symmetry <= 1 and r.horizontal_symmetry > 0.9


def test_cells_cover_the_mask(spark):
    mask = spatial.rasterize(polygons(spark, [RECT])).select("image_id", "x", "y")
    sites = spark.createDataFrame([("i", k, 55 + 9 * k, 60 + 7 * (k % 3)) for k in range(5)], "image_id string, site_id int, sx int, sy int")
    got = spatial.cell_summary(spatial.cells(mask, sites)).collect()
    assert sum(r.voronoi_cell_area for r in got) == mask.count() and sum(r.shared_edges for r in got) % 2 == 0


def test_arrow(spark):
    head = [(0, 20), (20, 0), (40, 20), (33, 20), (26, 21), (25, 24), (25, 40), (25, 60), (24, 70), (20, 72), (16, 70), (15, 60), (15, 40), (15, 24), (14, 21), (7, 20)]
    r = arrows.detect(polygons(spark, [head, RECT])).orderBy("contour_id").collect()
    assert r[0].has_arrow and not r[1].has_arrow and r[1].arrow_angle is None
    assert r[0].triangle_height >= 8 and 0 <= r[0].arrow_angle <= 360 and r[0].shaft_solidity >= r[0].tip_solidity


def test_classification(spark):
    rows = [("a", 1, 100.0, 50.0, 5000.0), ("a", 2, 98.0, 51.0, 4900.0), ("a", 3, 20.0, 30.0, 400.0), ("a", 4, 99.0, 10.0, 900.0), ("b", 1, 5.0, 5.0, 5.0), ("c", 1, 100.0, 50.0, 5000.0), ("c", 2, 100.0, 50.0, 5000.0), ("c", 3, 100.0, 80.0, 100.0)]
    got = {(r.image_id, r.contour_id): r.surface_type for r in surfaces.classify(spark.createDataFrame(rows, "image_id string, contour_id int, technical_length double, technical_width double, area double")).collect()}
    assert got == {("a", 1): "Dorsal", ("a", 2): "Ventral", ("a", 3): "Platform", ("a", 4): "Lateral", ("b", 1): "Dorsal", ("c", 1): "Dorsal", ("c", 2): "Ventral", ("c", 3): "Lateral"}


def _image(rows):
    return [("i", y, x, 255 * int(c == "#")) for y, line in enumerate(rows) for x, c in enumerate(line)]


def test_region_tree(spark):
    art = ["..............", ".#########....", ".#.......#..#.", ".#.###...#....", ".#.#.#...#.##.", ".#.###...#.##.", ".#.......#....", ".#########....", ".............."]
    tree = raster.region_tree(spark.createDataFrame(_image(art), "image_id string, y int, x int, v int")).collect()
    top = {r.root: r for r in tree}
    assert sorted((r.hole, r.area) for r in tree) == sorted([(False, 28), (True, 35 - 9), (False, 8), (True, 1), (False, 1), (False, 4)])
    depth = lambda r: 0 if r.parent_root is None else 1 + depth(next(x for x in tree if x.root == r.parent_root and x.hole != r.hole))
    assert sorted(depth(r) for r in tree) == [0, 0, 0, 1, 2, 3] and len(top) == 6


def test_regions_match_flood_fill(spark):
    rnd = random.Random(9)
    art = ["".join(rnd.choice("#..") for _ in range(14)) for _ in range(14)]
    rows = _image(art)
    on = {(y, x) for _, y, x, v in rows if v}
    want, seen = [], set()
    for p in sorted(on):
        if p not in seen:
            stack, n = [p], 0
            seen.add(p)
            while stack:
                y, x = stack.pop()
                n += 1
                for q in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if q in on and q not in seen:
                        seen.add(q)
                        stack.append(q)
            want.append(n)
    got = raster.regions(spark.createDataFrame(rows, "image_id string, y int, x int, v int")).groupBy("root").count().collect()
    assert sorted(r["count"] for r in got) == sorted(want)


def test_hull_needs_points(spark):
    assert polygons(spark, [[(0, 0), (4, 0), (4, 4), (0, 4)]]).select(G.solidity(F.col("contour"))).first()[0] == pytest.approx(1.0)


def test_queries_take_all_contours_and_pixels(spark):
    def inside(p, x, y):
        e = list(zip(p, p[1:] + p[:1], strict=True))
        on = any((v[0] - u[0]) * (y - u[1]) == (v[1] - u[1]) * (x - u[0]) and min(u[0], v[0]) <= x <= max(u[0], v[0]) and min(u[1], v[1]) <= y <= max(u[1], v[1]) for u, v in e)
        return on or sum((u[1] > y) != (v[1] > y) and x < (v[0] - u[0]) * (y - u[1]) / (v[1] - u[1]) + u[0] for u, v in e) % 2 == 1

    own = {3: [(10, 10), (50, 12), (47, 61), (8, 55)], 16: [(55, 15), (99, 20), (70, 66)], 97: [(15, 90), (18, 90), (18, 93), (15, 93)], 240: [(60, 70), (90, 75), (80, 110), (62, 99)], 1999: [(23, 91), (26, 91), (26, 94), (23, 94)]}
    vert = spark.createDataFrame([("i", k, i, x, y) for k, p in own.items() for i, (x, y) in enumerate(p)], "image_id string, contour_id bigint, i int, x int, y int")
    run = lambda name: contour_queries.FOUND[name][1](vert).collect()
    mask = {k: {(x, y) for x in range(120) for y in range(120) if inside(p, x, y)} for k, p in own.items()}
    assert {(r.contour_id, r.pixels, r.sx) for r in run("r11_rasterize")} == {(k, len(m), sum(x for x, _ in m)) for k, m in mask.items()}
    assert {(r.contour_id, r.top_area + r.bottom_area) for r in run("y01_symmetry")} == {(k, len(m)) for k, m in mask.items()}
    assert {r.contour_id: r.scar_complexity for r in run("j02_adjacency")} == {3: 1, 16: 2, 97: 1, 240: 1, 1999: 1}
    sites = {r.site_id: (r.sx, r.sy) for r in contour_queries._sites(vert).collect()}
    label = {p: min(sites, key=lambda s: ((p[0] - sites[s][0]) ** 2 + (p[1] - sites[s][1]) ** 2, s)) for p in set().union(*mask.values())}
    beside = {k: set() for k in own}
    for (x, y), s in label.items():
        for q in ((x + 1, y), (x, y + 1)):
            if label.get(q, s) != s:
                beside[s].add(label[q])
                beside[label[q]].add(s)
    assert {(r.site_id, r.voronoi_cell_area, r.shared_edges) for r in run("v03_cells_all")} == {(k, list(label.values()).count(k), len(beside[k])) for k in own}
    assert [r.voronoi_num_cells for r in run("v04_num_cells_all")] == [5]


def test_cells_of_many_sites(spark):
    rnd = random.Random(4)
    sites = [("i", k, rnd.randrange(-40, 200), rnd.randrange(-40, 200)) for k in range(60)] + [("i", 60, 5, 5), ("i", 61, 5, 5), ("j", 0, -900, 70)]
    mask = [(im, x, y) for im in "ij" for x in range(-20, 150, 3) for y in range(-7, 120, 4)]
    got = spatial.cells(spark.createDataFrame(mask, "image_id string, x int, y int"), spark.createDataFrame(sites, "image_id string, site_id bigint, sx int, sy int")).collect()
    assert {(r.image_id, r.x, r.y): r.site_id for r in got} == {(im, x, y): min(((x - a) ** 2 + (y - b) ** 2, k) for j, k, a, b in sites if j == im)[1] for im, x, y in mask}
    assert len(got) == len(mask)


def test_pixel_cells_by_runs(spark):
    rnd = random.Random(11)
    shapes = [[(rnd.randrange(25), rnd.randrange(25)) for _ in range(6)] for _ in range(3)] + [[(900_000, 900_000), (900_001, 900_000), (900_001, 900_001)]]  # far apart: no room for all pixels between
    polys = polygons(spark, shapes)
    pixels = {(r.x, r.y) for r in spatial.rasterize(polys).collect()}
    for sites in ([(k, rnd.randrange(25), rnd.randrange(25)) for k in range(7)] + [(7, 4, 4), (8, 4, 4), (9, 900_000, 900_001)], [(k, rnd.randrange(50) / 2 + 0.25, rnd.randrange(50) / 2) for k in range(6)]):
        rows = spark.createDataFrame([("i", k, float(x), float(y)) for k, x, y in sites], "image_id string, site_id bigint, sx double, sy double")
        label = {p: min(sites, key=lambda s: ((p[0] - s[1]) ** 2 + (p[1] - s[2]) ** 2, s[0]))[0] for p in pixels}
        beside = {k: set() for k, *_ in sites}
        for (x, y), s in label.items():
            for q in ((x + 1, y), (x, y + 1)):
                if label.get(q, s) != s:
                    beside[s].add(label[q])
                    beside[label[q]].add(s)
        got = {(r.site_id, r.voronoi_cell_area, r.shared_edges) for r in spatial.pixel_cells(polys, rows).collect()}
        assert got == {(k, list(label.values()).count(k), len(beside[k])) for k in set(label.values())}


def test_one_sort_serves_the_steps_by_image(spark):
    rows = spark.createDataFrame([("i", k, 1 if k > 2 else None, 9.0 - k, 5.0 - k % 2, 80.0 / k) for k in range(1, 8)], "image_id string, contour_id int, parent_contour_id int, technical_length double, technical_width double, area double")
    made = surfaces.rows_of(surfaces.classify_and_label(rows))
    plan = made._jdf.queryExecution().sparkPlan().toString() + made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count(" Sort [") == 1, plan
    got = [(r.contour_id, r.surface_type, r.surface_feature, r.scar_count) for r in made.orderBy("contour_id").collect()]
    assert got[0] == (1, "Dorsal", "Dorsal", 5) and [g[2] for g in got[2:]] == [f"scar {k}" for k in range(1, 6)]
