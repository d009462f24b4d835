"""A whole run on drawings made here, and its parts against plain versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from flintframe import __main__ as command
from flintframe.functions import planar, polygons, rasters
from flintframe.operators import analyses, contours, raster, spatial, surfaces
from flintframe.options import Options, from_arguments, parser
from flintframe.plans import batch
from flintframe.sources import images, metrics

from .test_sources import png

POLY = "image_id string, contour_id bigint, contour array<struct<x:int,y:int>>"


def test_outlines_enclose_what_the_frame_does_not_reach():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        a = rnd.random((12, 13)) < 0.55
        reached = rasters.labels(np.pad(~a, 1, constant_values=True), False)
        want = (reached != reached[0, 0])[1:-1, 1:-1]
        got = np.zeros_like(a)
        found = rasters.outlines(a)
        for up, corners in found:
            if up is None:
                got |= rasters.filled(corners, 0, 0, 13, 12)
        assert (got == want).all()
        assert len(found) == rasters.labels(a).max() + reached.max() - 1
        assert all(up is None or up < k or found[up][0] != k for k, (up, _) in enumerate(found))


def test_ring(spark):
    a = np.zeros((12, 14), int)
    a[2:9, 2:11] = 255
    a[4:7, 4:9] = 0
    a[5, 6] = 255
    px = spark.createDataFrame([("i", y, x, int(a[y, x])) for y in range(12) for x in range(14)] + [("j", 0, 0, 0)], "image_id string, y int, x int, v int")
    got = contours.measures(raster.outlines(px)).orderBy("contour_id").collect()
    assert [(r.contour_id, r.parent_contour_id, r.area, r.technical_length, r.technical_width) for r in got] == [(0, None, 48.0, 6.0, 8.0), (1, 0, 22.0, 4.0, 6.0), (2, 1, 0.0, 0.0, 0.0)]


def test_canny_finds_the_border_of_a_square():
    a = np.zeros((20, 20), int)
    a[5:15, 5:15] = 255
    edge = rasters.canny(a)
    assert edge.any() and not edge[8:12, 8:12].any() and not edge[:3].any() and not edge[:, :3].any()
    assert not rasters.canny(np.full((9, 9), 200)).any()


def test_kernels_of_the_resolution():
    scaling = Options().update(dpi__enabled=True).dpi
    assert rasters.kernel_scale(None, scaling) == rasters.kernel_scale(0, scaling) == 1 and rasters.kernel_scale(1200, scaling) == 2.5
    assert sum(rasters.gaussian(11)) == pytest.approx(1) and rasters.odd(4.9) == 5 and rasters.odd(0.2) == 1
    grey = np.random.default_rng(0).integers(0, 256, (40, 40))
    for method in ("standard", "clahe", "off"):
        for kind in ("otsu", "simple", "default", "adaptive"):
            o = Options().update(preprocessing__grey=method, preprocessing__threshold=kind)
            assert set(np.unique(rasters.binarised(grey, 600, o.preprocessing, o.dpi))) <= {0, 255}
    for wrong in ({"preprocessing__grey": "x"}, {"preprocessing__normalise": "x"}, {"preprocessing__threshold": "x"}):
        o = Options().update(**wrong)
        with pytest.raises(ValueError):
            rasters.binarised(grey, None, o.preprocessing, o.dpi)


def test_cells_against_pixels():
    outline = [(0, 0), (99, 0), (99, 79), (60, 79), (60, 40), (30, 40), (30, 79), (0, 79)]
    sites = [(20.0, 20.0), (75.0, 30.0), (45.0, 10.0), (15.0, 70.0), (75.0, 30.0)]
    got = planar.cells(outline, sites)
    assert sum(a for a, _ in got) == pytest.approx(polygons.area(outline) - 169 / 12) and got[4] == (0, 0)  # a smaller piece is left
    y, x = np.mgrid[0:80:0.25, 0:100:0.25]
    inside = (x < 99) & (y < 79) & ~((x > 30) & (x < 60) & (y > 40))
    near = np.argmin([(x - a) ** 2 + (y - b) ** 2 for a, b in sites], axis=0)
    for k, (a, _) in enumerate(got[:4]):
        assert a == pytest.approx((inside & (near == k)).sum() / 16, abs=30)
    label = np.full(near.shape, -1)
    for k in range(5):  # the largest piece of each
        pieces = rasters.labels(inside & (near == k), False)
        if pieces.any():
            label[pieces == np.bincount(pieces[pieces > 0]).argmax()] = k
    touch = {(int(a), int(b)) for u, v in ((label[:, :-1], label[:, 1:]), (label[:-1], label[1:])) for a, b in zip(u.ravel(), v.ravel()) if a != b and min(a, b) >= 0}
    assert [n for _, n in got] == [len({b for a, b in touch | {(b, a) for a, b in touch} if a == k}) for k in range(5)]


def scene():
    px = np.full((320, 420, 1), 240, np.uint8)
    px[20:220, 20:220] = 20
    for y, x in ((40, 40), (40, 120), (130, 40)):
        px[y : y + 60, x : x + 60] = 240
    for y in range(134, 186, 7):
        for x in range(44, 96, 7):
            px[y : y + 3, x : x + 3] = 20
    px[20:218, 260:330] = 20
    px[250:290, 60:140] = 20
    return px


def test_whole_run(spark, tmp_path):
    folder = tmp_path / "data" / "images"
    folder.mkdir(parents=True)
    (folder / "a.png").write_bytes(png(scene(), 300))
    (folder / "b.png").write_bytes(b"broken")
    (tmp_path / "data" / "meta.csv").write_text("image_id,scale_id,scale\na,,\nb.png,,\nc,,\n")
    out = tmp_path / "out"
    code = command.main(["--data_dir", str(tmp_path / "data"), "--meta_file", str(tmp_path / "data" / "meta.csv"), "--output_dir", str(out), "--no_closing"])
    assert code == 0
    rows = metrics.read_csv(spark, str(out / "processed_metrics")).collect()
    by = {r.surface_feature: r for r in rows}
    assert set(by) == {"Dorsal", "Lateral", "Platform", "scar 1", "scar 2", "cortex 1"}
    dorsal, side = by["Dorsal"], by["Lateral"]
    assert dorsal.voronoi_num_cells == 4 and dorsal.scar_count == sum("scar" in k for k in by) and dorsal.vertical_symmetry > 0.95
    assert dorsal.top_area + dorsal.bottom_area == dorsal.left_area + dorsal.right_area > 0
    assert sum(r.voronoi_cell_area or 0 for r in rows) == pytest.approx(dorsal.total_area, rel=1e-3)
    assert side.lateral_convexity == 1.0 and side.distance_to_max_width is not None and dorsal.lateral_convexity is None
    assert by["cortex 1"].is_cortex and by["cortex 1"].cortex_percentage > 5 and by["cortex 1"].scar_complexity is None
    assert by["scar 1"].scar_complexity is not None and by["scar 1"].max_length > 0 and not dorsal.has_arrow
    doc = json.loads(next((out / "json").rglob("part-*.json")).read_text().splitlines()[0])
    assert doc["schema_version"] == 1 and {s["surface_type"] for s in doc["surfaces"]} == {"Dorsal", "Lateral", "Platform"}
    status = {r.image_id: r for r in metrics.read_manifest(spark, str(out / "run_summary")).collect()}
    assert status["a"].ok and not status["b.png"].ok and status["c"].reason == "image not found"


def test_arrows_of_nested_contours(spark):
    head = [(0, 20), (20, 0), (40, 20), (33, 20), (26, 21), (25, 24), (25, 40), (25, 60), (24, 70), (20, 72), (16, 70), (15, 60), (15, 40), (15, 24), (14, 21), (7, 20)]
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    shifted = [(x + 12, y + 12) for x, y in head]
    rows = [("i", 0, None, box(0, 0, 300, 200), "parent"), ("i", 1, 0, box(5, 5, 90, 90), "child"), ("i", 2, 0, box(120, 5, 90, 90), "child"), ("i", 3, 1, shifted, "nested"), ("i", 4, 3, box(20, 20, 2, 2), "nested")]
    every = spark.createDataFrame(rows, "image_id string, contour_id bigint, parent_contour_id bigint, contour array<struct<x:int,y:int>>, level string")
    features = every.where("level = 'child'").drop("level").withColumn("is_cortex", F.lit(False))
    got = {r.contour_id: r for r in analyses.arrow_marks(features, every).collect()}
    assert got[1].has_arrow and got[1].arrow_angle is not None and not got[2].has_arrow
    crust = {r.contour_id: r for r in analyses.arrow_marks(features.withColumn("is_cortex", F.col("contour_id") == 1), every).collect()}
    assert not crust[1].has_arrow


def test_one_pass_labels_as_two(spark):
    rnd = np.random.default_rng(8)
    rows = [(f"i{k % 40}", int(k // 40), None if k < 160 else int(rnd.integers(0, 6)), float(rnd.choice([100, 98, 50, 20])), float(rnd.choice([60, 61, 30])), float(rnd.choice([5000, 4900, 800]))) for k in range(400)]
    table = spark.createDataFrame(rows, "image_id string, contour_id int, parent_contour_id int, technical_length double, technical_width double, area double")
    parents = surfaces.classify(table.where("parent_contour_id is null"))
    children = surfaces.label_children(table.where("parent_contour_id is not null"), parents)
    want = {(r.image_id, r.contour_id): (r.surface_type, r.surface_type) for r in parents.collect()} | {(r.image_id, r.contour_id): (r.surface_type, r.surface_feature) for r in children.collect()}
    assert {(r.image_id, r.contour_id): (r.surface_type, r.surface_feature) for r in surfaces.classify_and_label(table).collect()} == want


def test_png_depths():
    import struct
    import zlib

    def made(w, h, depth, kind, lines, extra=b"", interlace=0):
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, interlace)) + extra + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    bits = made(10, 2, 1, 0, b"\x00\xaa\x80\x00\x55\x40")
    assert images.decode_png(bits)[:, :, 0].tolist() == [[255, 0] * 5, [0, 255] * 5]
    chunk = struct.pack(">I", 6) + b"PLTE" + bytes([1, 2, 3, 9, 8, 7]) + b"\0" * 4
    assert images.decode_png(made(2, 1, 8, 3, b"\x00\x01\x00", chunk))[0].tolist() == [[9, 8, 7], [1, 2, 3]]
    assert images.decode_png(made(1, 1, 16, 0, b"\x00\xfe\x01"))[0, 0, 0] == 254
    full = np.arange(48, dtype=np.uint8).reshape(8, 6)
    passes = b"".join(b"\x00" + full[y, x0::dx].tobytes() for x0, y0, dx, dy in images._PASSES if x0 < 6 for y in range(y0, 8, dy))
    assert (images.decode_png(made(6, 8, 8, 0, passes, interlace=1))[:, :, 0] == full).all()
    rows = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    bmp = b"BM" + struct.pack("<IHHI", 78, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, 2, 1, 24, 0, 24, 0, 0, 0, 0) + rows[::-1, :, ::-1].tobytes()
    assert (images.decode(bmp) == rows).all()


def test_options_from_files_and_arguments(tmp_path, monkeypatch):
    path = tmp_path / "o.json"
    path.write_text('{"cortex": {"sensitivity": "low"}, "dpi": {"enabled": true}}')
    given = parser().parse_args(["--data_dir", "d", "--meta_file", "m", "--config_file", str(path), "--cortex_sensitivity", "high", "--force_pixels", "--scar_distance", "4"])
    o = from_arguments(given)
    assert o.cortex.sensitivity == "high" and o.dpi.enabled and not o.scale.enabled and o.scars.distance_threshold == 4 and o.arrows.enabled
    assert Options.load(str(path)).cortex.sensitivity == "low" and Options.load(str(tmp_path / "none.json")) == Options()
    path.write_text('{"unknown": {"a": 1}}')
    monkeypatch.setenv("FLINTFRAME_CONFIG", str(path))
    assert Options.load() == Options()


def test_outline_cells_of_two_images(spark):
    shapes = [("a", 0, [(0, 0), (40, 0), (40, 20), (0, 20)]), ("b", 0, [(0, 0), (10, 0), (10, 10), (0, 10)])]
    sites = spark.createDataFrame([("a", 1, 10.0, 10.0), ("a", 2, 30.0, 10.0), ("b", 7, 5.0, 5.0)], "image_id string, site_id bigint, sx double, sy double")
    got = {(r.image_id, r.site_id): (r.area, r.shared_edges) for r in spatial.outline_cells(spark.createDataFrame(shapes, POLY), sites).collect()}
    assert got == {("a", 1): (400.0, 1), ("a", 2): (400.0, 1), ("b", 7): (100.0, 0)}


def test_batch_options(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(scene(), 300))
    meta = spark.createDataFrame([("a", None, None)], "image_id string, scale_id string, scale string")
    off = Options().update(cortex__enabled=False, scars__enabled=False, arrows__enabled=False, classification__enabled=False)
    rows, _ = batch.run(spark, str(tmp_path), meta, options=off)
    got = rows.collect()
    assert {r.surface_type for r in got} == {"Unclassified"} and all(r.scar_complexity is None and not r.is_cortex for r in got)


def test_regions_by_tiles(spark):
    rnd = np.random.default_rng(11)
    h, w = 40, 50
    snake = np.zeros((h, w), int)  # one component that crosses every tile, and a hook back into a tile
    snake[::4] = 1
    snake[:, 0][2::8] = snake[:, -1][0:0] = 1
    for k in range(0, h - 4, 4):
        snake[k : k + 5, (0 if k % 8 else w - 1)] = 1
    spots = (rnd.random((h, w)) < 0.45).astype(int)
    corners = np.zeros((h, w), int)
    for k in range(min(h, w)):
        corners[k, k] = 1  # diagonal: tiles touch at corners only
    for k in range(h):
        corners[k, w - 1 - k] = 1
    rows = [(name, y, x, int(a[y, x])) for name, a in (("snake", snake), ("spots", spots), ("corners", corners), ("none", corners * 0)) for y in range(h) for x in range(w)]
    px = spark.createDataFrame(rows, "image_id string, y int, x int, v int").cache()
    want = {(r.image_id, r.y, r.x): r.root for r in raster.regions(px).collect()}
    for tile in (7, 64):
        assert {(r.image_id, r.y, r.x): r.root for r in raster.tiled_regions(px, tile).collect()} == want
    assert len({root for (i, _, _), root in want.items() if i == "corners"}) == 1
    assert raster.tiled_regions(px.where("image_id = 'none'"), 7).count() == 0
