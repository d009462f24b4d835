"""Sequential JPEG files as arrays: entropy decoding, dequantisation, inverse cosine transform, upsampling, colours."""

from __future__ import annotations

import struct

import numpy as np

#: Place in the 8 by 8 block (row by row) of each coefficient of the file: diagonals from the upper left, in turns.
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
_FREQUENCY, _AT = np.mgrid[0:8, 0:8]
#: Rows: cosines of a frequency at the eight places, scaled so that the matrix is orthogonal.
COSINES = np.cos((2 * _AT + 1) * _FREQUENCY * np.pi / 16) * np.where(_FREQUENCY, 0.5, 0.125**0.5)


def huffman(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """For each 16 bits to come: length and symbol of the code that they begin with; (0, 0) where there is none."""
    table, at = [(0, 0)] * 65536, 0
    made = iter(symbols)
    for length, n in enumerate(counts, 1):
        span = 1 << (16 - length)
        for _ in range(n):
            table[at : at + span] = [(length, next(made))] * span
            at += span
    if at > 65536:
        raise ValueError("broken JPEG: codes overlap")
    return table


class _Component:
    def __init__(self, name: int, sampling: int, quantiser: int) -> None:
        self.name, self.h, self.v, self.quantiser = name, sampling >> 4, sampling & 15, quantiser

    def lay_out(self, width: int, height: int, most_h: int, most_v: int) -> None:
        """Size in samples and in blocks; with blocks that fill up whole units."""
        self.width, self.height = -(-width * self.h // most_h), -(-height * self.v // most_v)
        self.columns, self.rows = -(-self.width // 8), -(-self.height // 8)
        self.stride = -(-width // (8 * most_h)) * self.h
        self.blocks = np.zeros((-(-height // (8 * most_v)) * self.v * self.stride, 64), np.int32)


def _units(parts: list[_Component]) -> list[list[tuple[_Component, int]]]:
    """The blocks of each unit of a scan, in order of the file. A scan of one component goes by its own blocks."""
    if len(parts) == 1:
        own = parts[0]
        return [[(own, y * own.stride + x)] for y in range(own.rows) for x in range(own.columns)]
    wide, high = parts[0].stride // parts[0].h, len(parts[0].blocks) // parts[0].stride // parts[0].v
    return [[(c, (my * c.v + y) * c.stride + mx * c.h + x) for c in parts for y in range(c.v) for x in range(c.h)] for my in range(high) for mx in range(wide)]


def _scan(body: list[bytes], parts: list[tuple[_Component, list, list]], interval: int) -> None:
    """Coefficients of a scan; body: its stretches between restarts, without stuffing."""
    units = _units([c for c, _, _ in parts])
    tables = {id(c): (dc, ac) for c, dc, ac in parts}
    step = interval or len(units)
    for k in range(0, len(units), step):
        if k // step >= len(body):
            raise ValueError("broken JPEG: the scan ends early")
        data = body[k // step] + b"\0" * 16
        end, at = 8 * (len(data) - 8), 0
        before = dict.fromkeys(tables, 0)
        found: dict[int, tuple[list[int], list[int]]] = {key: ([], []) for key in tables}
        for unit in units[k : k + step]:
            for c, block in unit:
                dc, ac = tables[id(c)]
                places, values = found[id(c)]
                base, spot = 64 * block, 0
                while spot < 64:
                    # five bytes hold what is left of the first, a code of 16 bits and as many of its value
                    window = int.from_bytes(data[at >> 3 : (at >> 3) + 5], "big") << (at & 7)
                    length, symbol = (ac if spot else dc)[window >> 24 & 0xFFFF]
                    if not length or at > end:
                        raise ValueError("broken JPEG: no such code")
                    size = symbol & 15 if spot else symbol
                    at += length + size
                    value = 0
                    if size:
                        value = (window & 0xFFFFFFFFFF) >> (40 - length - size) & ((1 << size) - 1)
                        if not value >> (size - 1):
                            value -= (1 << size) - 1
                    if not spot:
                        before[id(c)] += value
                        places.append(base)
                        values.append(before[id(c)])
                        spot = 1
                        continue
                    if not size:
                        if symbol != 0xF0:
                            break
                        spot += 16
                        continue
                    spot += symbol >> 4
                    if spot > 63:
                        raise ValueError("broken JPEG: a block is too long")
                    places.append(base + ZIGZAG[spot])
                    values.append(value)
                    spot += 1
        for c, _, _ in parts:
            places, values = found[id(c)]
            c.blocks.reshape(-1)[places] = values


def samples(blocks: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """Blocks of 8 by 8 samples from 0 to 255 from quantised coefficients."""
    x = (blocks * quantiser).reshape(-1, 8, 8).astype(float)
    return np.clip(np.floor(COSINES.T @ x @ COSINES + 128.5), 0, 255).astype(np.uint8)


def _plane(c: _Component, quantiser: np.ndarray) -> np.ndarray:
    tiles = samples(c.blocks, quantiser).reshape(-1, c.stride, 8, 8)
    return tiles.transpose(0, 2, 1, 3).reshape(8 * len(tiles), 8 * c.stride)[: c.height, : c.width].astype(int)


def _doubled(a: np.ndarray, axis: int, unit: int, biases: tuple[int, int]) -> np.ndarray:
    """Twice as many samples: three parts the nearer and one part the farther, over ``unit``; those at the ends stand alone."""
    a = np.moveaxis(a, axis, 0)
    out = np.empty((2 * len(a), *a.shape[1:]), int)
    out[0::2] = 3 * a + np.concatenate((a[:1], a[:-1])) + biases[0]
    out[1::2] = 3 * a + np.concatenate((a[1:], a[-1:])) + biases[1]
    return np.moveaxis(out // unit, 0, axis)


def upsampled(a: np.ndarray, right: int, down: int, width: int, height: int) -> np.ndarray:
    """A plane in the size of the image; planes of half the samples are blended, others repeated."""
    if (right, down) == (2, 1) and a.shape[1] > 2:
        a = _doubled(a, 1, 4, (1, 2))
    elif (right, down) == (1, 2):
        a = _doubled(a, 0, 4, (1, 2))
    elif (right, down) == (2, 2) and a.shape[1] > 2:
        a = _doubled(_doubled(a, 0, 1, (0, 0)), 1, 16, (8, 7))
    else:
        a = np.repeat(np.repeat(a, down, axis=0), right, axis=1)
    return a[:height, :width]


def _coloured(planes: np.ndarray, transform: int | None, named: bool) -> np.ndarray:
    """Rows, columns and channels (red first). transform: what the file says of its colours, if anything."""
    if len(planes) < 3:
        return planes[0][:, :, None]
    luma = transform == 1 or transform == 2 or (transform is None and len(planes) == 3 and not named)
    if luma:
        y, cb, cr = planes[0], planes[1] - 128.0, planes[2] - 128.0
        rgb = np.stack((y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb))
        planes = np.concatenate((np.clip(np.floor(rgb + 0.5), 0, 255), planes[3:]))
    if len(planes) == 4:  # inks, kept as what they let through
        planes = np.floor(planes[:3] * planes[3] / 255 + 0.5)
    return np.moveaxis(planes[:3], 0, 2)


def _stretches(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded bytes from a place on, parted at restarts, and where they end."""
    parts, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*parts, data[start:].replace(b"\xff\0", b"\xff")], len(data)
        kind = data[at + 1]
        if 0xD0 <= kind <= 0xD7:
            parts.append(data[start:at].replace(b"\xff\0", b"\xff"))
            start = at + 2
        elif kind and kind != 0xFF:
            return [*parts, data[start:at].replace(b"\xff\0", b"\xff")], at
        at += 1 + (kind != 0xFF)


def segments(data: bytes):
    """(marker, place of its body, body) of each segment; the bytes of a scan are left to who reads it."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if kind in (0, 1, 0xFF) or 0xD0 <= kind <= 0xD8:
            at += 1 + (kind != 0xFF)
            continue
        if kind == 0xD9:
            return
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        yield kind, at + 4, data[at + 4 : at + 2 + n]
        at += 2 + n


def decode(data: bytes) -> np.ndarray:
    """Rows, columns and channels of a baseline or extended sequential JPEG of 8 bits; other kinds fail with their name."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    quantisers: dict[int, np.ndarray] = {}
    codes: dict[int, list] = {}
    parts: list[_Component] = []
    width = height = interval = 0
    transform, over = None, 0
    for kind, at, body in segments(data):
        if at < over:
            continue
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                q = np.zeros(64, np.int64)
                q[ZIGZAG] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1)
                quantisers[body[0] & 15], body = q, body[65 + 64 * (wide > 0) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]], body = huffman(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif kind in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or not width or not height or n not in (1, 3, 4):
                raise ValueError(f"unsupported JPEG: {n} components of {depth} bits, {width} by {height}")
            parts = [_Component(*body[6 + 3 * k : 9 + 3 * k]) for k in range(n)]
            if not all(1 <= c.h <= 4 and 1 <= c.v <= 4 for c in parts):
                raise ValueError("broken JPEG: sampling")
            most = max(c.h for c in parts), max(c.v for c in parts)
            if n == 1:
                parts[0].h = parts[0].v = 1
                most = (1, 1)
            for c in parts:
                c.lay_out(width, height, *most)
        elif kind in (0xC2, 0xC6, 0xCA, 0xCE):
            raise ValueError("unsupported JPEG: progressive")
        elif 0xC3 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError(f"unsupported JPEG: {'arithmetic coding' if kind > 0xC8 else 'lossless or differential'}")
        elif kind == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body[:5] == b"Adobe":
            transform = body[11]
        elif kind == 0xDA:
            own = [(next(c for c in parts if c.name == body[1 + 2 * k]), codes[body[2 + 2 * k] >> 4], codes[16 + (body[2 + 2 * k] & 15)]) for k in range(body[0])]
            stretches, over = _stretches(data, at + len(body))
            _scan(stretches, own, interval)
    if not parts or not over:
        raise ValueError("broken JPEG: no picture")
    planes = [upsampled(_plane(c, quantisers[c.quantiser]), most[0] // c.h, most[1] // c.v, width, height) for c in parts]
    return _coloured(np.stack(planes), transform, [c.name for c in parts] == [*b"RGB"]).astype(np.uint8)


def resolution(data: bytes) -> float | None:
    """Dots an inch by the file's first header segment, if it gives them."""
    for kind, _, body in segments(data):
        if kind == 0xE0 and body[:5] == b"JFIF\0" and len(body) >= 12:
            unit, x = body[7], struct.unpack(">H", body[8:10])[0]
            return {1: float(x), 2: x * 2.54}.get(unit) if x else None
        if kind == 0xDA:
            return None
    return None


def exif(data: bytes) -> bytes | None:
    """The TIFF-like block of camera data, if there is one."""
    for kind, _, body in segments(data):
        if kind == 0xE1 and body[:6] == b"Exif\0\0":
            return body[6:]
        if kind == 0xDA:
            return None
    return None
