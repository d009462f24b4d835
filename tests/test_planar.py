"""Outlines that cross themselves, distances and cells, against hand-made cases and pixels."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flintframe.functions import geometry as G
from flintframe.functions import planar, polygons, rasters
from flintframe.operators import spatial

POLY = "image_id string, contour_id bigint, contour array<struct<x:int,y:int>>"
BOX = [(0, 0), (10, 0), (10, 10), (0, 10)]


def enclosed(points):
    return planar.area(planar.repaired(points))


def test_what_crossing_outlines_enclose():
    assert enclosed(BOX) == enclosed(BOX[::-1]) == enclosed(BOX * 2) == enclosed([(0, 0), (0, 0), *BOX]) == 100
    assert enclosed([(0, 0), (10, 10), (10, 0), (0, 10)]) == pytest.approx(25)  # two equal loops: one stays
    assert enclosed([(0, 0), (20, 20), (20, 0), (0, 10)]) == pytest.approx(400 / 3)  # the larger loop
    assert enclosed([(0, 0), (10, 0), (20, 0), (10, 0), (10, 10), (0, 10)]) == pytest.approx(100)  # a spike goes
    assert enclosed([(0, 0), (10, 0), (5, 5), (10, 10), (0, 10), (5, 5)]) == pytest.approx(50)  # loops that touch both stay
    assert enclosed([(0, 0), (30, 0), (30, 30), (0, 30), (0, 0), (10, 10), (10, 20), (20, 20), (20, 10), (10, 10)]) == pytest.approx(800)  # a hole in the other sense
    assert enclosed([(0, 0), (30, 0), (30, 30), (0, 30), (0, 0), (10, 10), (20, 10), (20, 20), (10, 20), (10, 10)]) == pytest.approx(900)  # the same sense: gone around twice
    assert len(planar.repaired([(0, 0), (5, 0), (9, 0)])) == len(planar.repaired([(3, 3)])) == len(planar.repaired([])) == 0


def test_enclosed_area_against_winding_numbers():
    rnd = np.random.default_rng(2)
    for _ in range(40):
        p = [tuple(v) for v in rnd.integers(0, 12, (rnd.integers(3, 9), 2)).tolist()]
        e = planar.sides(p)
        total = float((e[:, 0] * e[:, 3] - e[:, 1] * e[:, 2]).sum())
        y, x = np.mgrid[0:12:0.05, 0:12:0.05] + 0.0251
        q = np.stack((x.ravel(), y.ravel() + 0.0003), axis=1)
        want = (planar.winding(e, q) * (1 if total > 0 else -1) >= 1).sum() * 0.0025
        assert enclosed(p) == pytest.approx(want, abs=1.2)


def test_distance_to_the_loop_that_stays():
    eight = [(0, 0), (40, 40), (40, 0), (0, 20)]  # the loop on the left goes
    left, right = [(-6, 8), (-2, 8), (-2, 12), (-6, 12)], [(43, 10), (50, 10), (50, 20), (43, 20)]
    d = lambda a, b: planar.distance(planar.repaired(a), planar.repaired(b))
    assert d(eight, right) == 3 and d(right, eight) == 3
    assert d(eight, left) > 12 and d([(0, 0), (9, 0)], left) is None
    assert d(BOX, [(2, 2), (4, 2), (4, 4), (2, 4)]) == 0 == d(BOX, [(5, 5), (30, 5), (30, 8), (5, 8)]) and d(BOX, [(10, 0), (20, 0), (20, 9)]) == 0


def test_complexity_of_crossing_scars(spark):
    rows = [("i", 1, [(0, 0), (40, 40), (40, 0), (0, 20)]), ("i", 2, [(-6, 8), (-2, 8), (-2, 12), (-6, 12)]), ("i", 3, [(43, 10), (50, 10), (50, 20), (43, 20)]), ("i", 4, [(1, 1), (5, 1), (9, 1)]), ("i", 5, [(1, 1), (2, 2)])]
    got = {r.contour_id: r.scar_complexity for r in spatial.scar_complexity(spark.createDataFrame([(i, c, [{"x": x, "y": y} for x, y in p]) for i, c, p in rows], POLY), 10).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0}
    area = {r.contour_id: r.a for r in spark.createDataFrame([(i, c, [{"x": x, "y": y} for x, y in p]) for i, c, p in rows], POLY).select("contour_id", G.enclosed(F.col("contour")).alias("a")).collect()}
    assert area[1] == pytest.approx(1600 / 3) and area[2] == 16 and area[4] == area[5] == 0


U = [(0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30)]


def test_the_larger_piece_is_the_cell():
    assert planar.cells(U, [(15, 5), (15, 28)]) == [(430.0, 1), (135.0, 1)]
    comb = [(0, 0), (50, 0), (50, 30), (40, 30), (40, 10), (30, 10), (30, 26), (20, 26), (20, 10), (10, 10), (10, 30), (0, 30)]
    low, high = planar.cells(comb, [(25, 5), (25, 35)])
    assert low == (800.0, 1) and high == (100.0, 1)
    beside = planar.cells(comb, [(25, 5), (24.9, 35), (25.1, 35)])
    assert [n for _, n in beside[1:]] == [1, 1]  # both have an arm of their own and share no border with each other
    for turn in (1, -1):  # arms that meet in a corner on the line are apart, and so are those beside a side on it
        notched = [(0, 0), (40, 0), (40, 40), (20, 20), (6, 40), (0, 40)][::turn]
        assert planar.cells(notched, [(20, 10), (20, 30)])[1] == (260.0, 1)
        flat = [(0, 0), (40, 0), (40, 40), (30, 20), (15, 20), (0, 40)][::turn]
        assert planar.cells(flat, [(20, 10), (20, 30)])[1] == (150.0, 1)
        assert [a for a, _ in planar.cells([(0, 0), (40, 0), (40, 20), (0, 20)][::turn], [(20, 10), (20, 30)])] == [800.0, 0.0]
    assert planar.cells(BOX, [(5, 5)]) == [(100.0, 0)] and planar.cells(BOX, [(5, 5), (5, 5)]) == [(100.0, 0), (0.0, 0)]
    assert planar.cells(BOX, [(5, 5), (500, 5)])[1] == (0.0, 0) and planar.cells(BOX, []) == []


def pieces_by_pixels(outline, sites, scale):
    """Pixels of the largest piece of each site's part, at ``scale`` pixels a unit."""
    p = np.asarray(outline) * scale
    w, h = p.max(axis=0) + 1
    mask = rasters.filled([tuple(v) for v in p.tolist()], 0, 0, w, h)
    y, x = np.mgrid[0:h, 0:w] / scale
    near = np.where(mask, np.argmin([(x - a) ** 2 + (y - b) ** 2 for a, b in sites], axis=0), -1)
    return [max(np.bincount(rasters.labels(near == k, False).ravel())[1:].tolist(), default=0) / scale**2 for k in range(len(sites))]


def test_cells_against_pixels_of_pieces():
    rnd = np.random.default_rng(7)
    for _ in range(6):
        n = 40
        angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
        r = rnd.uniform(12, 60, n)
        outline = [(int(60 + a * np.cos(t)), int(60 + a * np.sin(t))) for a, t in zip(r, angle)]
        sites = [tuple(s) for s in rnd.uniform(5, 115, (9, 2)).tolist()]
        got = [a for a, _ in planar.cells(outline, sites)]
        want = pieces_by_pixels(outline, sites, 8)
        assert np.allclose(got, want, atol=40) and sum(got) <= planar.area(planar.repaired(outline)) + 1e-6


def test_neighbours_alone_cut_a_cell(monkeypatch):
    rnd = np.random.default_rng(3)
    angle = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    outline = [(int(500 + 400 * (1 + 0.2 * np.sin(7 * t)) * np.cos(t)), int(500 + 400 * (1 + 0.2 * np.sin(7 * t)) * np.sin(t))) for t in angle]
    sites = [tuple(s) for s in rnd.uniform(100, 900, (2000, 2)).tolist()]
    began = time.process_time()
    got = planar.cells(outline, sites)
    assert time.process_time() - began < 5  # under a second on a machine of its own
    assert sum(a for a, _ in got) == pytest.approx(planar.area(planar.repaired(outline)), rel=1e-3)
    few = sites[:150]
    def by_all(sites, i, low, high):
        ring = [(low[0], low[1], -1), (high[0], low[1], -1), (high[0], high[1], -1), (low[0], high[1], -1)]
        for j in range(len(sites)):
            if j != i and ring:
                ring = planar._cut(ring, *(sites[j] - sites[i]).tolist(), float(sites[j] @ sites[j] - sites[i] @ sites[i]) / 2, j)
        return ring
    near = planar.cells(outline, few)
    monkeypatch.setattr(planar, "_region", by_all)
    plain = planar.cells(outline, few)
    assert np.allclose([a for a, _ in near], [a for a, _ in plain]) and [n for _, n in near] == [n for _, n in plain]


def test_farthest_corners_by_antipodal_pairs():
    rnd = np.random.default_rng(6)
    shapes = [[tuple(v) for v in rnd.integers(0, k, (n, 2)).tolist()] for n in (1, 2, 3, 5, 40) for k in (3, 10, 1000) for _ in range(15)]
    shapes += [[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (9, 0), (3, 0)], [(round(900 * np.cos(t)), round(900 * np.sin(t))) for t in np.linspace(0, 2 * np.pi, 12, endpoint=False)]]
    for p in shapes:
        d2, i, j = min((-((p[i][0] - p[j][0]) ** 2 + (p[i][1] - p[j][1]) ** 2), i, j) for i in range(len(p)) for j in range(i, len(p)) if p.index(p[i]) == i and p.index(p[j]) == j and (i < j or len(set(p)) == 1))
        assert polygons.chord(p) == (-d2, i, j)
    wide = [(round(1e9 * np.cos(t)), round(1e9 * np.sin(t))) for t in np.linspace(0, 2 * np.pi, 20_000, endpoint=False)]
    assert len(polygons.antipodal(polygons.hull(wide))) < 3 * len(wide) and polygons.chord(wide)[0] == pytest.approx(4e18, rel=1e-6)


def test_runs_of_pixels(spark):
    rnd = np.random.default_rng(9)
    shapes = [("i", k, [{"x": int(x), "y": int(y)} for x, y in rnd.integers(-5, 25, (6, 2))]) for k in range(8)] + [("j", 9, [{"x": 3, "y": 4}]), ("j", 10, [])]
    df = spark.createDataFrame(shapes, POLY)
    runs = [tuple(r) for r in spatial.spans(df).collect()]
    assert len(runs) == len({(i, c, y, x0) for i, c, y, x0, _ in runs}) and all(a <= b for *_, a, b in runs)
    pixels = {}
    for i, c, y, a, b in runs:
        pixels.setdefault((i, c), set()).update((x, y) for x in range(a, b + 1))
    for i, c, p in shapes:
        if p:
            mask = rasters.filled([(v["x"], v["y"]) for v in p], -10, -10, 40, 40)
            assert pixels[i, c] == {(int(x) - 10, int(y) - 10) for y, x in zip(*np.nonzero(mask))}
    every = spark.createDataFrame(runs, "image_id string, contour_id bigint, y int, x0 int, x1 int")
    assert {(r.a, r.b): r.pixels for r in spatial.span_overlaps(every).collect()} == {(a, b): n for a in range(8) for b in range(a + 1, 8) if (n := len(pixels["i", a] & pixels["i", b]))}
    both = [tuple(r) for r in spatial.union_spans(every).select("image_id", "y", "x0", "x1").collect()]
    assert {(x, y) for i, y, a, b in both if i == "i" for x in range(a, b + 1)} == set().union(*(pixels["i", k] for k in range(8)))
    assert all(not any(i == j and y == v and a < c <= b + 1 for j, v, c, _ in both) for i, y, a, b in both)
    assert {r.contour_id: (r.pixels, r.sx, r.sy) for r in spatial.span_areas(every).collect()} == {c: (len(s), sum(x for x, _ in s), sum(y for _, y in s)) for (_, c), s in pixels.items()}


def test_runs_are_handed_on_in_turn():
    n = 2 * spatial.CONTOURS_TOGETHER + 9
    square = lambda k: ([k, k + 3, k + 3, k], [0, 0, 2, 2])
    made = [None if k == 5 else square(k) for k in range(n)]
    batch = pa.RecordBatch.from_pylist([{"image_id": "i", "contour_id": k, "xs": m and m[0], "ys": m and m[1]} for k, m in enumerate(made)],
                                       pa.schema([("image_id", pa.string()), ("contour_id", pa.int64()), ("xs", pa.list_(pa.int32())), ("ys", pa.list_(pa.int32()))]))
    parts = [p.to_pylist() for p in spatial._spans_of([batch])]
    assert [len({r["contour_id"] for r in p}) for p in parts] == [spatial.CONTOURS_TOGETHER - 1, spatial.CONTOURS_TOGETHER, 9]
    assert sorted((r["contour_id"], r["y"], r["x0"], r["x1"]) for p in parts for r in p) == [(k, y, k, k + 3) for k in range(n) if k != 5 for y in range(3)]
