import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from flintframe.operators import calibration
from flintframe.options import Options
from flintframe.plans import batch
from flintframe.sources import images, metadata, metrics


def png(px, dpi=None, kind=0):
    h, w, k = px.shape
    lines, up = b"", np.zeros(w * k, np.uint8)
    for row in px.reshape(h, w * k):
        left = np.concatenate((np.zeros(k, np.uint8), row[:-k]))
        corner = np.concatenate((np.zeros(k, np.uint8), up[:-k]))
        p = left.astype(int) + up - corner
        near = np.stack((abs(p - left), abs(p - up.astype(int)), abs(p - corner.astype(int))))
        guess = np.choose(near.argmin(axis=0), (left, up, corner))
        coded = {0: row, 1: row - left, 2: row - up, 3: row - ((left.astype(int) + up) // 2).astype(np.uint8), 4: row - guess}[kind]
        lines += bytes([kind]) + coded.astype(np.uint8).tobytes()
        up = row
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[k], 0, 0, 0))
    if dpi:
        out += chunk(b"pHYs", struct.pack(">IIB", round(dpi / 0.0254), round(dpi / 0.0254), 1))
    return out + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png_round_trip():
    px = np.random.default_rng(0).integers(0, 256, (9, 7, 3), np.uint8)
    for kind in range(5):
        assert (images.decode_png(png(px, kind=kind)) == px).all()


def drawing(h=60, w=80):
    px = np.full((h, w, 1), 240, np.uint8)
    px[10:50, 10:60] = 20
    px[20:34, 20:36] = 240
    return px


def test_batch(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    (folder / "one.png").write_bytes(png(drawing(), 300))
    (folder / "two.png").write_bytes(b"not an image")
    (tmp_path / "meta.csv").write_text("image_id,scale_id,scale\none,bar,10\ntwo.png,,x\nthree,,5\n")
    meta = metadata.read_metadata(spark, str(tmp_path / "meta.csv"))
    assert metadata.validate(meta) == [] and metadata.validate(meta.drop("scale")) == ["column scale is missing"]
    bars = spark.createDataFrame([("bar", 100.0, 0.9)], "image_id string, scale_pixels double, scale_confidence double")
    rows, status = batch.run(spark, str(folder), meta, bars)
    got = {r.image_id: r for r in status.collect()}
    assert got["one"].ok and got["one"].dpi == 300 and not got["two.png"].ok and got["three"].reason == "image not found"
    out = {r.surface_feature: r for r in rows.collect()}
    assert set(out) == {"Dorsal", "scar 1"} and out["Dorsal"].scar_count == 1 and out["Dorsal"].calibration_method == "scale_bar"
    pixels = {r.surface_feature: r for r in batch.run(spark, str(folder), meta, bars, Options(legacy_pixel_units=True))[0].collect()}
    assert out["Dorsal"].total_area == round(pixels["Dorsal"].total_area / 100, 2) and out["Dorsal"].technical_length == round(pixels["Dorsal"].technical_length / 10, 2)


def test_metadata_missing(spark, tmp_path):
    none = metadata.read_metadata(spark, str(tmp_path / "none.csv"))
    assert none.isEmpty() and metadata.validate(none) == ["no row"]


def test_resolution_order(spark):
    files = spark.createDataFrame([("a.bmp", "/a.bmp"), ("a.jpg", "/a.jpg"), ("b", "/b"), ("b.png", "/b.png")], "name string, path string")
    meta = spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string")
    assert {r.image_id: r.path for r in metadata.resolve_images(meta, files).collect()} == {"a": "/a.jpg", "b": "/b", "c": None}
    found = metadata.artefacts(spark.createDataFrame([("x.png",)], "image_id string"), spark.createDataFrame([("x_labelled.png", "/p")], "name string, path string"), {"labelled": "_labelled.png", "voronoi": "_voronoi.png"}).first()
    assert (found.labelled, found.voronoi) == ("/p", None)


def test_metrics_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Dorsal", "Dorsal", 2, True), ("a", "Dorsal", "scar 1", None, None)], "image_id string, surface_type string, surface_feature string, scar_count int, has_arrow boolean")
    metrics.write_csv(rows, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m").glob("part-*"))
    assert text.startswith("image_id,surface_type,surface_feature,scar_count") and ",NA," in text
    back = metrics.read_csv(spark, str(tmp_path / "m"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, metrics.arrange(rows).collect()))
    both = metrics.merge([rows, rows.withColumn("extra", F.lit(1))])
    assert both.columns[-1] == "extra" and both.count() == 4


def test_packed_metrics(spark, tmp_path):
    rows = metrics.arrange(spark.range(2000).selectExpr("concat('a', id) AS image_id", "'Dorsal' AS surface_type", "id / 8 AS total_area").coalesce(1))
    size = {}
    for codec in ("none", "gzip"):
        metrics.write_csv(rows, str(tmp_path / codec), codec)
        assert sorted(map(repr, metrics.read_csv(spark, str(tmp_path / codec)).collect())) == sorted(map(repr, rows.collect()))
        size[codec] = sum(p.stat().st_size for p in (tmp_path / codec).glob("part-*"))
    assert size["gzip"] * 4 < size["none"]


def test_manifest(spark, tmp_path):
    status = spark.createDataFrame([("b", True, 300, None), ("a", True, None, None), ("c", False, None, "bad")], "image_id string, ok boolean, dpi int, reason string")
    metrics.write_manifest(status, str(tmp_path / "run"))
    back = metrics.read_manifest(spark, str(tmp_path / "run"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, status.collect()))
    assert metrics.read_manifest(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad.json").write_text("{nonsense")
    assert metrics.read_manifest(spark, str(tmp_path / "bad.json")) is None


def test_calibration(spark):
    meta = spark.createDataFrame([("a", "s", "10"), ("b", "", "10"), ("c", "s", "-1"), ("d", "t", "5"), ("e", None, "x")], "image_id string, scale_id string, scale string")
    bars = spark.createDataFrame([("s", 200.0, 0.95)], "image_id string, scale_pixels double, scale_confidence double")
    got = {r.image_id: (r.calibration_status, r.calibration_method, r.factor) for r in calibration.calibrate(meta, bars).collect()}
    assert got == {"a": ("scale_bar", "scale_bar", 20.0), "b": ("pixels_no_scale", "pixels", 1.0), "c": ("pixels_detection_failed", "pixels", 1.0), "d": ("pixels_detection_failed", "pixels", 1.0), "e": ("pixels_no_scale", "pixels", 1.0)}
    px = spark.createDataFrame([("s", y, x, 0 if 5 <= y < 15 and 10 <= x < 210 else 255) for y in range(20) for x in range(220)], "image_id string, y int, x int, v int")
    assert tuple(calibration.detect_scale_bars(px).first()) == ("s", 200.0, 1.0)


def test_options():
    o = Options.from_dict({"filtering": {"min_area": 7}, "legacy_pixel_units": True})
    assert o.filtering.min_area == 7 and o.legacy_pixel_units and o.cortex.sensitivity == "medium"
    for bad in ({"nope": {"a": 1}}, {"filtering": {"nope": 1}}):
        try:
            Options.from_dict(bad)
        except (KeyError, TypeError):
            continue
        raise AssertionError(bad)


def test_images_are_filed_once(spark):
    """Files are filed under the ids that they can be of; ids are not multiplied by the extensions and joined."""
    files = spark.createDataFrame([("a.tiff", "/1"), ("a.jpg", "/2"), ("b.png", "/3"), ("b", "/4"), (".bmp", "/5"), ("c.gif", "/6"), (None, "/7")], "name string, path string")
    meta = spark.createDataFrame([("a",), ("a.tiff",), ("b",), ("b.png",), ("",), ("c",), (None,)], "image_id string")
    found = metadata.resolve_images(meta, files)
    assert {r.image_id: r.path for r in found.collect()} == {"a": "/2", "a.tiff": "/1", "b": "/4", "b.png": "/3", "": "/5", "c": None, None: None}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
