"""Image files made of the driver's tables, so that queries have scans of all formats to read."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources import jpeg, tiff

#: Quantised coefficients of 8 by 8 blocks, four of them (two by two) to an image; i: place in the block, row by row.
COEFFICIENTS = """
SELECT concat('scan-', cast(vec_id // 4 AS varchar(20))) AS image_id, cast(vec_id % 4 AS integer) AS block, cast(i AS integer) AS i,
  cast(floor(cast(e AS double) * CASE WHEN i = 0 THEN 700 ELSE 90 END) AS integer) AS q FROM {points}"""
#: Steps of the quantiser, by place.
STEPS = np.add.outer(np.arange(8), np.arange(8)).ravel() + 1
#: DuckDB: pixels of these blocks by the definition of the inverse cosine transform.
PIXELS_OF = """, co AS (SELECT image_id, block, i // 8 AS u, i % 8 AS w, q * (i // 8 + i % 8 + 1) AS c FROM coef),
spots AS (SELECT y, x FROM (SELECT unnest(range(8)) AS y), (SELECT unnest(range(8)) AS x)),
light AS (SELECT image_id, block, y, x, sum(c * CASE WHEN u = 0 THEN sqrt(0.125::DOUBLE) ELSE 0.5::DOUBLE END * CASE WHEN w = 0 THEN sqrt(0.125::DOUBLE) ELSE 0.5::DOUBLE END
  * cos((2 * y + 1) * u * pi() / 16) * cos((2 * x + 1) * w * pi() / 16)) AS s FROM co, spots GROUP BY ALL)
SELECT image_id, (block // 2 * 8 + y)::INTEGER AS y, (block % 2 * 8 + x)::INTEGER AS x, greatest(0, least(255, floor(s + 128.5::DOUBLE)))::INTEGER AS v FROM light"""


def _code(symbols: list[int]) -> tuple[bytes, dict[int, str]]:
    """A table segment's body and the code of each symbol: the first has two bits, four more have four, others nine."""
    lengths = [2] + [4] * 4 + [9] * (len(symbols) - 5)
    counts = bytes(lengths.count(n) for n in range(1, 17))
    code, last, made = 0, 2, {}
    for symbol, n in zip(symbols, lengths, strict=True):
        code <<= n - last
        made[symbol], last, code = f"{code:0{n}b}", n, code + 1
    return counts + bytes(symbols), made


_DC, _DC_CODE = _code(list(range(12)))
_AC, _AC_CODE = _code([0, 1, 2, 3, 17] + [s for s in range(256) if s == 0xF0 or 1 <= s & 15 <= 10 and s not in (1, 2, 3, 17)])


def _value(v: int, size: int) -> str:
    return f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""


def _coded(block: np.ndarray, before: int) -> str:
    """Bits of a block (coefficients row by row) after one with this first coefficient."""
    step = int(block[0]) - before
    size = abs(step).bit_length()
    out, run = [_DC_CODE[size] + _value(step, size)], 0
    for k in range(1, 64):
        v = int(block[jpeg.ZIGZAG[k]])
        if not v:
            run += 1
            continue
        size = abs(v).bit_length()
        out.append(_AC_CODE[0xF0] * (run // 16) + _AC_CODE[run % 16 << 4 | size] + _value(v, size))
        run = 0
    return "".join(out) + (_AC_CODE[0] if run else "")


def jpeg_of(parts: list[tuple[int, int, np.ndarray]], width: int, height: int, restart: int = 0, dpi: int = 0, steps: np.ndarray = STEPS, kind: int = 0xC0, extra: bytes = b"") -> bytes:
    """A file of components (sampling across, sampling down, blocks by row, column and place), interleaved unit by unit."""
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    high, wide = len(parts[0][2]) // parts[0][1], parts[0][2].shape[1] // parts[0][0]
    before, bits, body, n = [0] * len(parts), [], b"", 0
    packed = lambda text: int(text.ljust(-(-len(text) // 8) * 8, "1") or "0", 2).to_bytes(-(-len(text) // 8), "big").replace(b"\xff", b"\xff\0")
    for my in range(high):
        for mx in range(wide):
            if restart and n and n % restart == 0:
                body += packed("".join(bits)) + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
                before, bits = [0] * len(parts), []
            for c, (h, v, blocks) in enumerate(parts):
                for y in range(v):
                    for x in range(h):
                        own = blocks[my * v + y, mx * h + x]
                        bits.append(_coded(own, before[c]))
                        before[c] = int(own[0])
            n += 1
    head = b"\xff\xd8" + (segment(0xE0, b"JFIF\0\1\1\1" + struct.pack(">HHBB", dpi, dpi, 0, 0)) if dpi else b"") + extra
    head += segment(0xDB, b"\0" + bytes(int(steps[k]) for k in jpeg.ZIGZAG)) + segment(0xC4, b"\0" + _DC) + segment(0xC4, b"\x10" + _AC)
    head += segment(kind, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v, _) in enumerate(parts)))
    if restart:
        head += segment(0xDD, struct.pack(">H", restart))
    scan = segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in range(len(parts))) + b"\0\x3f\0")
    return head + scan + body + packed("".join(bits)) + b"\xff\xd9"


def jpegs(coefficients: DataFrame) -> DataFrame:
    """path (the image's id) and content: a JPEG of 16 by 16 pixels of each image's four blocks."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        blocks = np.zeros((4, 64), np.int64)
        blocks[rows["block"], rows["i"]] = rows["q"]
        image_id = rows["image_id"].iloc[0]
        number = int(image_id.rpartition("-")[2])
        return pd.DataFrame({"path": [image_id], "content": [jpeg_of([(1, 1, blocks.reshape(2, 2, 64))], 16, 16, number % 3, 72 + number % 500)]})

    return coefficients.groupBy("image_id").applyInPandas(run, "path string, content binary")


#: Kinds of files that tiffs() makes in turn.
TIFF_KINDS = [(order, how, tile, predictor) for how in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for order in "<>" for tile, predictor in ((0, 1), (0, 2), (16, 1))]


def tiffs(pixels: DataFrame) -> DataFrame:
    """path (the image's id) and content: a TIFF of each grey image (image_id, y, x, v), of one kind after the other."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        px = np.zeros((rows["y"].max() + 1, rows["x"].max() + 1, 1), np.uint8)
        px[rows["y"], rows["x"], 0] = rows["v"]
        image_id = rows["image_id"].iloc[0]
        number = int(image_id.rpartition("-")[2])
        order, how, tile, predictor = TIFF_KINDS[number % len(TIFF_KINDS)]
        return pd.DataFrame({"path": [image_id], "content": [tiff.encode(px, order, how, tile=tile, rows=3, predictor=predictor, dpi=72 + number % 500)]})

    return pixels.groupBy("image_id").applyInPandas(run, "path string, content binary")


#: One drawing a supplier: a dark rectangle (x0, y0, w, h) with a light one (hw, hh) in it.
DRAWINGS = """
SELECT concat('drawing-', cast(s_suppkey AS varchar(20))) AS image_id, cast(5 + s_suppkey % 4 AS integer) AS x0, cast(6 + s_suppkey % 5 AS integer) AS y0, cast(40 + s_suppkey % 30 AS integer) AS w,
  cast(50 + s_suppkey % 23 AS integer) AS h, cast(10 + s_suppkey % 7 AS integer) AS hw, cast(9 + s_suppkey % 11 AS integer) AS hh, cast(1 + s_suppkey % 3 AS integer) AS bar FROM {supplier}"""


def drawings(shapes: DataFrame) -> DataFrame:
    """image_id, content and dpi of a TIFF of each drawing. Drawings are dealt out before they are made: their rows are few bytes in one file."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for d in b.itertuples():
                px = np.full((100, 100, 1), 240, np.uint8)
                px[d.y0 : d.y0 + d.h, d.x0 : d.x0 + d.w] = 20
                px[d.y0 + 9 : d.y0 + 9 + d.hh, d.x0 + 8 : d.x0 + 8 + d.hw] = 240
                made.append(tiff.encode(px, how=tiff.PACKBITS, dpi=300))
            yield pd.DataFrame({"image_id": b["image_id"], "content": made, "dpi": 300.0})

    dealt = shapes.repartition(int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id")
    return dealt.mapInPandas(run, "image_id string, content binary, dpi double")
