"""Images as pixel tables, or as one row an image with its grey pixels.

PNG of all bit depths, with palette and interlace, sequential JPEG, TIFF and uncompressed BMP are decoded; other files
are reported with their reason.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jpeg, tiff

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row and steps of the seven passes of an interlaced image.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
DEFAULT_DPI = 300


def png_dpi(content: Column) -> Column:
    """Dots an inch from a PNG's resolution chunk, or null. The chunk stands before the pixels, in the first 64 KB."""
    head = F.hex(F.substring(content, 1, 65536))
    found = F.regexp_instr(head, F.lit("^(?:..)*?70485973"))
    at = F.when(found > 0, F.length(F.regexp_extract(head, "^((?:..)*?)70485973", 1)) + 1)
    pixels = F.length(F.regexp_extract(head, "^((?:..)*?)49444154", 1))
    per_metre = F.conv(F.substring(head, at + 8, F.lit(8)), 16, 10).cast("double")
    metric = F.substring(head, at + 24, F.lit(2)) == "01"
    return F.when(at.isNotNull() & metric & ((pixels == 0) | (at <= pixels)) & F.startswith(head, F.lit("89504E47")), F.round(per_metre * 0.0254).cast("int"))


def _unpacked(lines: np.ndarray, depth: int, count: int) -> np.ndarray:
    """Values of 8 bits of each line from samples of 1 to 16 bits."""
    if depth == 8:
        return lines[:, :count]
    if depth == 16:
        return lines[:, 0 : 2 * count : 2]
    bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)[:, :count]
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)


def _lines(raw: np.ndarray, h: int, row: int, step: int) -> np.ndarray:
    """Unfiltered lines of ``row`` bytes; a pixel is ``step`` bytes."""
    raw = raw[: h * (1 + row)].reshape(h, 1 + row)
    out = np.zeros((h + 1, row), np.uint8)
    for y in range(h):
        line, up, kind = raw[y, 1:], out[y], raw[y, 0]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            for k in range(step):
                out[y + 1, k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            out[y + 1] = line + up
        else:
            _recall(out[y + 1], line, up, step, int(kind))
    return out[1:]


def decode_png(data: bytes) -> np.ndarray:
    """Rows, columns and channels of a PNG, 8 bits each; other files fail."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, size, palette = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + n
    if size is None or size[3] not in _CHANNELS or size[2] not in (1, 2, 4, 8, 16) or size[3] == 3 and palette is None:
        raise ValueError("unsupported PNG")
    w, h, depth, k = size[0], size[1], size[2], _CHANNELS[size[3]]
    raw, out = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8), np.zeros((h, w, k), np.uint8)
    for x0, y0, dx, dy in _PASSES if size[6] else ((0, 0, 1, 1),):
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw <= 0 or ph <= 0:
            continue
        row = -(-pw * k * depth // 8)
        out[y0::dy, x0::dx] = _unpacked(_lines(raw, ph, row, max(1, k * depth // 8)), depth, pw * k).reshape(ph, pw, k)
        raw = raw[ph * (1 + row) :]
    if size[3] == 3:
        return palette[np.minimum(out[:, :, 0], len(palette) - 1)]
    return out * np.uint8(255 // ((1 << depth) - 1)) if depth < 8 else out


def decode_bmp(data: bytes) -> np.ndarray:
    """Rows, columns and channels (red first) of an uncompressed BMP of 8, 24 or 32 bits; other files fail."""
    start, w, h, depth, packed = struct.unpack("<10xI4xii2xHI", data[:34])
    if data[:2] != b"BM" or depth not in (8, 24, 32) or packed not in (0, 3):
        raise ValueError("unsupported BMP")
    row = -(-w * depth // 32) * 4
    lines = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:: -1 if h > 0 else 1]
    px = lines[:, : w * depth // 8].reshape(abs(h), w, depth // 8)
    if depth > 8:
        return px[:, :, 2::-1]
    colours = np.frombuffer(data, np.uint8, start - 54, 54).reshape(-1, 4)[:, 2::-1]
    return colours[np.minimum(px[:, :, 0], len(colours) - 1)]


def turned(px: np.ndarray, orientation: int) -> np.ndarray:
    """An image upright, from the number by which a file says how it lies: mirrored, turned, or both."""
    if orientation > 4:
        px = px.swapaxes(0, 1)
    down, right = orientation in (3, 4, 7, 8), orientation in (2, 3, 6, 7)
    return px[:: -1 if down else 1, :: -1 if right else 1]


def decode(data: bytes) -> np.ndarray:
    """Rows, columns and channels (red first), 8 bits each, upright."""
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:2] == b"\xff\xd8":
        return turned(jpeg.decode(data), _camera(data).get(tiff.ORIENTATION, [1])[0])
    if data[:2] in (b"II", b"MM"):
        return turned(tiff.decode(data), tiff.tags(data)[1].get(tiff.ORIENTATION, [1])[0])
    return decode_png(data)


def _camera(data: bytes) -> dict[int, list]:
    """Camera data of a JPEG; none where they are broken."""
    try:
        block = jpeg.exif(data)
        return tiff.tags(block)[1] if block else {}
    except (ValueError, struct.error):
        return {}


def resolution(data: bytes) -> float | None:
    """Dots an inch by the header of a JPEG, TIFF or BMP; None if it does not say or can't be read."""
    try:
        if data[:2] == b"BM":
            return struct.unpack("<i", data[38:42])[0] * 0.0254 or None
        if data[:2] == b"\xff\xd8":
            return jpeg.resolution(data) or tiff.resolution(_camera(data))
        return tiff.resolution(tiff.tags(data)[1]) if data[:2] in (b"II", b"MM") else None
    except (ValueError, struct.error):
        return None


@F.pandas_udf(T.DoubleType())
def _resolutions(contents: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else resolution(bytes(c)) for c in contents], dtype=float)


def dpi(content: Column) -> Column:
    """Dots an inch (whole) from the header of a file, or null. Files that begin as PNG are read in expressions alone."""
    png = F.startswith(F.hex(F.substring(content, 1, 4)), F.lit("89504E47"))
    return F.coalesce(png_dpi(content), F.round(_resolutions(F.when(~png, content))).cast("int"))


def _recall(row: np.ndarray, line: np.ndarray, up: np.ndarray, k: int, kind: int) -> None:
    """A line coded by the mean of, or the nearest to, its neighbours."""
    for i in range(len(line)):
        a, b, c = (int(row[i - k]) if i >= k else 0), int(up[i]), (int(up[i - k]) if i >= k else 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        row[i] = (int(line[i]) + guess) & 255


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                px = decode(bytes(content))
            except Exception as e:  # one bad file is a row with its reason
                yield pd.DataFrame({"path": [path], "y": [None], "channels": [None], "error": [f"{type(e).__name__}: {e}"[:300]]})
                continue
            h, w, k = px.shape
            rgb = px[:, :, :3] if k >= 3 else np.repeat(px[:, :, :1], 3, axis=2)
            yield pd.DataFrame({"path": path, "y": np.arange(h, dtype=np.int32), "channels": [r.astype(np.int32).ravel() for r in rgb], "error": None})


def pixels(files: DataFrame) -> DataFrame:
    """path, y, x, r, g, b of each pixel of each file (path, content); one that can't be decoded is one row with error set."""
    rows = files.select("path", "content").mapInPandas(_decoded, "path string, y int, channels array<int>, error string")
    at = rows.select("path", "y", "error", "channels", F.explode_outer(F.when(F.size("channels") > 0, F.sequence(F.lit(0), (F.size("channels") / 3 - 1).cast("int")))).alias("x"))
    pick = lambda k: F.get("channels", F.col("x") * 3 + k)
    return at.select("path", "y", "x", pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"), "error")


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """pixels() of the files of a folder."""
    return pixels(spark.read.format("binaryFile").load(folder))


def read_dpi(spark: SparkSession, folder: str) -> DataFrame:
    """path, dpi (null where the file says none) and used_dpi (DEFAULT_DPI then)."""
    found = dpi(F.col("content")).alias("dpi")
    return spark.read.format("binaryFile").load(folder).select("path", found).withColumn("used_dpi", F.coalesce("dpi", F.lit(DEFAULT_DPI)))


def grey_of(px: np.ndarray) -> np.ndarray:
    """Grey values of an image of one to four channels."""
    if px.shape[2] < 3:
        return px[:, :, 0].astype(int)
    return np.floor(px[:, :, :3] @ (0.299, 0.587, 0.114) + 0.5).astype(int)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, content and dpi of each file of a folder, a row an image."""
    return _with_dpi(spark.read.format("binaryFile").load(folder))


def read_named(spark: SparkSession, named: DataFrame) -> DataFrame:
    """path, content and dpi of the files that are named (path); no other file of their folder is opened.

    The names go to the driver, as those of all files that Spark reads do.
    """
    paths = [r["path"] for r in named.select("path").where("path is not null").distinct().collect()]
    if not paths:
        return spark.createDataFrame([], "path string, content binary, dpi int")
    plain = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]  # names are no patterns
    return _with_dpi(spark.read.format("binaryFile").load(plain))


def _with_dpi(files: DataFrame) -> DataFrame:
    return files.select("path", "content", dpi(F.col("content")).alias("dpi"))
