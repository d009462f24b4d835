"""JPEG and TIFF files: known coefficients, subsampled colours, all kinds of strips and tiles, files that are not supported."""

import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from flintframe.plans import batch, scans
from flintframe.sources import images, jpeg, metadata, tiff

from .test_sources import drawing, png


def lit(block):
    """Samples of a block of coefficients, by the definition."""
    c = lambda k: 1 / 2**0.5 if k == 0 else 1.0
    out = np.zeros((8, 8))
    for y, x in np.ndindex(8, 8):
        out[y, x] = sum(c(u) * c(v) / 4 * block[u * 8 + v] * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) + 128
    return np.clip(np.floor(out + 0.5), 0, 255)


def blocks(rnd, rows, columns, spread=40):
    out = rnd.integers(-spread, spread, (rows, columns, 64)) * (rnd.random((rows, columns, 64)) < 0.15)
    out[:, :, 0] = rnd.integers(-300, 300, (rows, columns))
    return out


def test_zigzag():
    assert jpeg.ZIGZAG[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-3:] == [55, 62, 63] and sorted(jpeg.ZIGZAG) == list(range(64))


def test_grey_jpeg_of_known_coefficients():
    rnd = np.random.default_rng(3)
    for restart in (0, 1, 2, 5):
        b = blocks(rnd, 3, 4)
        got = images.decode(scans.jpeg_of([(1, 1, b)], 29, 20, restart))
        assert got.shape == (20, 29, 1)
        for r, c in np.ndindex(3, 4):
            want = lit(b[r, c] * scans.STEPS)[: 20 - 8 * r, : 29 - 8 * c]
            assert (got[8 * r : 8 * r + 8, 8 * c : 8 * c + 8, 0] == want).all()


def test_subsampled_colours():
    rnd = np.random.default_rng(4)
    for h, v in ((1, 1), (2, 1), (1, 2), (2, 2), (4, 1)):
        luma, cb, cr = (blocks(rnd, 2 * v, 2 * h, 8), *(blocks(rnd, 2, 2, 8) for _ in range(2)))
        width, height = 16 * h - 3, 16 * v - 1
        got = images.decode(scans.jpeg_of([(h, v, luma), (1, 1, cb), (1, 1, cr)], width, height, 3)).astype(int)
        plane = lambda b: np.block([[lit(x * scans.STEPS) for x in row] for row in b])
        y = plane(luma)[:height, :width]
        small = [plane(c)[: -(-height // v), : -(-width // h)].astype(int) for c in (cb, cr)]
        wide = []
        for p in small:  # each sample three parts the nearer and one the farther neighbour, sums rounded as fixed by the public decoder
            if (h, v) in ((2, 1), (1, 2)):
                q = p if h == 2 else p.T
                q = np.array([[(3 * row[k // 2] + row[min(max(k // 2 + (1 if k % 2 else -1), 0), len(row) - 1)] + (2 if k % 2 else 1)) // 4 for k in range(2 * len(row))] for row in q])
                wide.append(q if h == 2 else q.T)
            elif (h, v) == (2, 2):
                near = lambda a, k: a[min(max(k // 2 + (1 if k % 2 else -1), 0), len(a) - 1)]
                tall = [3 * p[k // 2] + near(p, k) for k in range(2 * len(p))]
                wide.append(np.array([[(3 * row[k // 2] + near(row, k) + (7 if k % 2 else 8)) // 16 for k in range(2 * len(row))] for row in tall]))
            else:
                wide.append(np.kron(p, np.ones((v, h), int)))
        b, r = (p[:height, :width] - 128 for p in wide)
        want = np.stack((y + 1.402 * r, y - 0.344136286 * b - 0.714136286 * r, y + 1.772 * b), axis=2)
        assert (got == np.clip(np.floor(want + 0.5), 0, 255)).all()


def test_separate_scans_of_components():
    """Scans of one component each go by their own blocks, without those that only fill up units."""
    rnd = np.random.default_rng(5)
    luma, chroma = blocks(rnd, 2, 4, 8), blocks(rnd, 2, 2, 8)
    both = scans.jpeg_of([(2, 1, luma), (1, 1, chroma), (1, 1, chroma)], 24, 16)
    cut = both.index(b"\xff\xda")
    part = lambda c, b, columns: (s := scans.jpeg_of([(1, 1, b[:, :columns])], 8 * columns, 16))[s.index(b"\xff\xda") : -2].replace(b"\xff\xda\x00\x08\x01\x01", b"\xff\xda\x00\x08\x01" + bytes([c]), 1)
    apart = both[:cut] + part(1, luma, 3) + part(2, chroma, 2) + part(3, chroma, 2) + b"\xff\xd9"
    assert (images.decode(apart)[:, :24] == images.decode(both)[:, :24]).all()


def test_jpegs_that_are_not_supported():
    b = blocks(np.random.default_rng(0), 1, 1)
    for kind, said in ((0xC2, "progressive"), (0xC3, "lossless"), (0xC9, "arithmetic")):
        with pytest.raises(ValueError, match=said):
            images.decode(scans.jpeg_of([(1, 1, b)], 8, 8, kind=kind))
    good = scans.jpeg_of([(1, 1, blocks(np.random.default_rng(0), 4, 4))], 32, 32)
    with pytest.raises(ValueError, match="no picture"):
        images.decode(good[: good.index(b"\xff\xda")])
    with pytest.raises(ValueError):
        images.decode(good[: good.index(b"\xff\xda") + 14] + b"\xff\xd9")


def test_upright():
    a = np.arange(6).reshape(2, 3, 1)
    want = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.swapaxes(0, 1), 6: np.rot90(a, -1), 7: a.swapaxes(0, 1)[::-1, ::-1], 8: np.rot90(a, 1)}
    assert all((images.turned(a, k) == v).all() for k, v in want.items())
    b = blocks(np.random.default_rng(1), 1, 2)
    camera = struct.pack("<2sHIH", b"II", 42, 8, 1) + struct.pack("<HHIHH", tiff.ORIENTATION, 3, 1, 6, 0) + b"\0\0\0\0"
    app1 = b"\xff\xe1" + struct.pack(">H", len(camera) + 8) + b"Exif\0\0" + camera
    plain, turned = scans.jpeg_of([(1, 1, b)], 16, 8), scans.jpeg_of([(1, 1, b)], 16, 8, extra=app1)
    assert (images.decode(turned) == np.rot90(images.decode(plain), -1)).all()
    broken = scans.jpeg_of([(1, 1, b)], 16, 8, extra=b"\xff\xe1" + struct.pack(">H", 12) + b"Exif\0\0junk")
    assert (images.decode(broken) == images.decode(plain)).all()


def test_tiff_kinds():
    rnd = np.random.default_rng(0)
    for order, how, bits, tile, per, predictor in itertools.product("<>", (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS), (1, 8, 16), (0, 16), (1, 3), (1, 2)):
        if bits == 1 and (per > 1 or predictor == 2):
            continue
        px = rnd.integers(0, 1 << bits, (37, 45, per))
        px[10:20, 5:30] = px[0, 0]
        data = tiff.encode(px, order, how, bits, tile, predictor=predictor, dpi=300)
        assert (images.decode(data) == (px * 255 if bits == 1 else px >> 8 if bits == 16 else px)).all()
        assert images.resolution(data) == 300
    one = rnd.integers(0, 2, (9, 11, 1))
    assert (images.decode(tiff.encode(one, bits=1, white_is_zero=True)) == 255 - 255 * one).all()
    wide = rnd.integers(0, 256, (120, 300, 3))  # the table of strings fills up and starts anew
    assert (images.decode(tiff.encode(wide, how=tiff.LZW, rows=120)) == wide).all()


def test_packed_bytes_of_the_public_documents():
    assert tiff.unpack_lzw(bytes.fromhex("800B6050220C0C8501"), 10) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    said = bytes.fromhex("FEAA028000 2AFDAA0380002A22F7AA".replace(" ", ""))
    assert tiff.unpack_bits(said, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    with pytest.raises(ValueError):
        tiff.unpack_lzw(bytes.fromhex("807FFF"), 10)


def test_tiffs_that_are_not_supported():
    data = tiff.encode(np.zeros((4, 4, 1), int))
    swap = lambda tag, value: data.replace(struct.pack("<HHIHH", tag, 3, 1, 1 if tag != tiff.BITS else 8, 0), struct.pack("<HHIHH", tag, 3, 1, value, 0))
    for bad, said in ((swap(tiff.COMPRESSION, 4), "compression 4"), (swap(tiff.PHOTOMETRIC, 6), "colours 6"), (swap(tiff.BITS, 32), "32"), (swap(tiff.PREDICTOR, 3), "predictor"), (b"II\x2b\0" + data[4:], "64-bit"), (b"IIxx", "not a TIFF")):
        with pytest.raises(ValueError, match=said):
            images.decode(bad)


def test_resolutions():
    b = blocks(np.random.default_rng(0), 1, 1)
    data = scans.jpeg_of([(1, 1, b)], 8, 8, dpi=240)
    assert images.resolution(data) == 240 and images.resolution(scans.jpeg_of([(1, 1, b)], 8, 8)) is None
    metric = data.replace(b"JFIF\0\1\1\1", b"JFIF\0\1\1\2")
    assert images.resolution(metric) == pytest.approx(240 * 2.54)
    bmp = b"BM" + struct.pack("<IHHI", 78, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, 2, 1, 24, 0, 24, 11811, 11811, 0, 0)
    assert round(images.resolution(bmp)) == 300 and images.resolution(b"II") is None and images.resolution(b"") is None


def test_run_over_jpeg_and_tiff(spark, tmp_path):
    """The same drawing in three formats: the same rows, and the reason of a file that is not supported."""
    folder = tmp_path / "images"
    folder.mkdir()
    px = np.pad(drawing(), ((0, 4), (0, 0), (0, 0)), constant_values=240)
    flat = np.zeros((8, 10, 64), int)  # blocks of one value: lossless
    solid = np.kron(np.where(np.arange(80).reshape(8, 10) % 10 < 7, 1, 0), np.ones((8, 8), int)) * 0 + px[:, :, 0]
    solid = solid.reshape(8, 8, 10, 8).mean(axis=(1, 3)).round().astype(int)
    flat[:, :, 0] = (solid - 128) * 8
    even = np.kron(solid, np.ones((8, 8), int))[:, :, None]
    (folder / "one.jpg").write_bytes(scans.jpeg_of([(1, 1, flat)], 80, 64, 4, 300))
    (folder / "two.tif").write_bytes(tiff.encode(even, ">", tiff.LZW, tile=32, predictor=2, dpi=300))
    (folder / "three.jpeg").write_bytes(scans.jpeg_of([(1, 1, flat)], 80, 64, kind=0xC2))
    assert (images.decode((folder / "one.jpg").read_bytes()) == even).all()
    meta = spark.createDataFrame([("one", None, None), ("two", None, None), ("three", None, None)], "image_id string, scale_id string, scale string")
    rows, status = batch.run(spark, str(folder), meta)
    got = {r.image_id: r for r in status.collect()}
    assert (got["one"].dpi, got["two"].dpi, got["three"].dpi) == (300, 300, None) and "progressive" in got["three"].reason
    by = {k: sorted(str(r[1:]) for r in rows.where(F.col("image_id") == k).collect()) for k in ("one", "two")}
    assert by["one"] == by["two"] != []


def test_only_named_files_are_read(spark, tmp_path):
    names = ["a.png", "b [1].png", "c{x}*.png", "not named.png"]
    for k, name in enumerate(names):
        (tmp_path / name).write_bytes(png(drawing(), 100 * (k + 1)))
    listed = metadata.list_images(spark, str(tmp_path))
    named = listed.where("name <> 'not named.png'").unionByName(listed.limit(1).withColumn("path", F.lit(None).cast("string")))
    got = images.read_named(spark, named)
    assert sorted(r.dpi for r in got.select("dpi").collect()) == [100, 200, 300] and len(got.inputFiles()) == 3
    assert images.read_named(spark, named.limit(0)).count() == 0 == images.read_named(spark, named.where("path is null")).count()
