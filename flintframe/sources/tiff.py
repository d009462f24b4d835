"""TIFF files as arrays: directory, strips and tiles, PackBits, LZW and deflate, predictor; and a plain writer."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Tags of a directory.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL, OFFSETS, ORIENTATION, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 262, 266, 273, 274, 277, 278, 279
X_RESOLUTION, PLANAR, UNIT, PREDICTOR, PALETTE, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 282, 284, 296, 317, 320, 322, 323, 324, 325, 339
#: Numbers of the compressions.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_KINDS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}
_FLIPPED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1)[:, 0]


def tags(data: bytes) -> tuple[str, dict[int, list]]:
    """Byte order and the entries of the first directory, by number; fractions as floats."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("unsupported TIFF: 64-bit offsets" if order and data[2:4] in (b"\x2b\0", b"\0\x2b") else "not a TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    found: dict[int, list] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind in (5, 10):
            place = struct.unpack(order + "I", entry[8:])[0]
            pairs = struct.unpack(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", data[place : place + 8 * n])
            found[tag] = [a / b if b else 0.0 for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
        elif kind in _KINDS:
            size = struct.calcsize(order + _KINDS[kind]) * n
            place = struct.unpack(order + "I", entry[8:])[0]
            found[tag] = list(struct.unpack(f"{order}{n}{_KINDS[kind]}", entry[8 : 8 + size] if size <= 4 else data[place : place + size]))
    return order, found


def resolution(found: dict[int, list]) -> float | None:
    """Dots an inch by a directory, if it gives them."""
    x, unit = found.get(X_RESOLUTION, [0])[0], found.get(UNIT, [2])[0]
    return {2: float(x), 3: x * 2.54}.get(unit) if x else None


def unpack_bits(data: bytes, size: int) -> bytes:
    """Runs and literals to ``size`` bytes."""
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Strings of a table that grows with what was read; codes of 9 to 12 bits, the greater bits first, a code wider one early."""
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, last = list(single), 9, b""
    out, held, have = bytearray(), 0, 0
    for byte in data:
        held, have = (held << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = held >> have & ((1 << width) - 1)
        if code == 256:
            table, width, last = list(single), 9, b""
            continue
        if code == 257 or len(out) >= size:
            break
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("broken TIFF: no such LZW code")
        text = table[code] if code < len(table) else last + last[:1]
        out += text
        if last:
            table.append(last + text[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        last = text
    return bytes(out)


def _unpacked(data: bytes, how: int, size: int) -> np.ndarray:
    if how == NONE:
        raw = data
    elif how == LZW:
        raw = unpack_lzw(data, size)
    elif how in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(data)
    elif how == PACKBITS:
        raw = unpack_bits(data, size)
    else:
        raise ValueError(f"unsupported TIFF: compression {how}")
    return np.frombuffer(raw[:size].ljust(size, b"\0"), np.uint8)


def _samples(raw: np.ndarray, rows: int, columns: int, per: int, bits: int, order: str) -> np.ndarray:
    """rows, columns and ``per`` samples of a strip or tile; each of its rows begins at a byte."""
    lines = raw.reshape(rows, -1)
    if bits == 8:
        return lines.reshape(rows, columns, per)
    if bits == 16:
        return lines.reshape(-1).view(order + "u2").astype(np.uint16).reshape(rows, columns, per)
    places = np.unpackbits(lines, axis=1)[:, : columns * per * bits].reshape(rows, columns * per, bits)
    return (places @ (1 << np.arange(bits)[::-1])).astype(np.uint8).reshape(rows, columns, per)


def decode(data: bytes) -> np.ndarray:
    """Rows, columns and channels (8 bits each) of a file's first picture; what is not supported fails with its name."""
    order, t = tags(data)
    one = lambda tag, default: t.get(tag, [default])[0]
    w, h, per, how, kind = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(COMPRESSION, 1), one(PHOTOMETRIC, 1)
    depth = set(t.get(BITS, [1]))
    if len(depth) > 1 or not depth <= {1, 2, 4, 8, 16} or one(FORMAT, 1) != 1 or kind not in (0, 1, 2, 3) or not w or not h:
        raise ValueError(f"unsupported TIFF: {sorted(depth)} bits, colours {kind}, sample format {one(FORMAT, 1)}")
    bits, apart = depth.pop(), one(PLANAR, 1) == 2 and per > 1
    tiled = TILE_OFFSETS in t
    tw, th = (one(TILE_WIDTH, w), one(TILE_HEIGHT, h)) if tiled else (w, min(one(ROWS, h), h))
    offsets, sizes = (t[TILE_OFFSETS], t[TILE_COUNTS]) if tiled else (t[OFFSETS], t.get(COUNTS, [len(data)]))
    across, down, own = -(-w // tw), -(-h // th), 1 if apart else per
    out = np.zeros((down * th, across * tw, per), np.uint16 if bits == 16 else np.uint8)
    for k, (place, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, spot = divmod(k, across * down)
        y, x = divmod(spot, across)
        rows = th if tiled else min(th, h - y * th)
        body = data[place : place + size]
        if one(FILL, 1) == 2:
            body = _FLIPPED[np.frombuffer(body, np.uint8)].tobytes()
        part = _samples(_unpacked(body, how, rows * -(-tw * own * bits // 8)), rows, tw, own, bits, order)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype)
        elif one(PREDICTOR, 1) != 1:
            raise ValueError("unsupported TIFF: predictor")
        out[y * th : y * th + rows, x * tw : (x + 1) * tw, slice(plane, plane + 1) if apart else slice(None)] = part
    out = out[:h, :w]
    if kind == 3:
        colours = np.asarray(t[PALETTE]).reshape(3, -1).T >> 8
        return colours[np.minimum(out[:, :, 0], len(colours) - 1)].astype(np.uint8)
    out = (out >> 8).astype(np.uint8) if bits == 16 else out * np.uint8(255 // ((1 << bits) - 1))
    return 255 - out if kind == 0 else out


def pack_bits(line: bytes) -> bytes:
    """Runs of three and more as such, the rest as literals."""
    out, at = bytearray(), 0
    while at < len(line):
        n = 1
        while at + n < len(line) and n < 128 and line[at + n] == line[at]:
            n += 1
        if n > 2:
            out += bytes([257 - n, line[at]])
        else:
            n = 1
            while at + n < len(line) and n < 128 and line[at + n : at + n + 1] * 3 != line[at + n : at + n + 3]:
                n += 1
            out += bytes([n - 1]) + line[at : at + n]
        at += n
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    table = {bytes([k]): k for k in range(256)}
    codes, size, width, text = [(256, 9)], 258, 9, b""
    for k in range(len(data)):
        longer = text + data[k : k + 1]
        if longer in table:
            text = longer
            continue
        codes.append((table[text], width))
        table[longer], size = size, size + 1
        if size == (1 << width) and width < 12:
            width += 1
        if size >= 4094:
            codes.append((256, width))
            table, size, width = {bytes([j]): j for j in range(256)}, 258, 9
        text = data[k : k + 1]
    if text:
        codes.append((table[text], width))
        width += (size + 1 == 1 << width) and width < 12
    bits = "".join(f"{c:0{n}b}" for c, n in [*codes, (257, width)])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def encode(px: np.ndarray, order: str = "<", how: int = NONE, bits: int = 8, tile: int = 0, rows: int = 16, predictor: int = 1, dpi: int = 0, white_is_zero: bool = False) -> bytes:
    """A file of one picture (rows, columns, channels of 1, 8 or 16 bits), in strips of ``rows`` or tiles of ``tile`` pixels."""
    h, w, per = px.shape
    px = px.astype({1: np.uint8, 8: np.uint8, 16: np.uint16}[bits])
    tw, th = (tile, tile) if tile else (w, rows)
    bodies = []
    for y in range(0, h, th):
        for x in range(0, w, tw):
            part = px[y : y + th, x : x + tw]
            if tile:
                part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=part[:, :1] * 0)
            lines = np.packbits(part.reshape(len(part), -1), axis=1) if bits == 1 else part.reshape(len(part), -1).astype(order + ("u2" if bits == 16 else "u1"))
            raw = lines.tobytes()
            bodies.append({NONE: lambda r: r, LZW: pack_lzw, DEFLATE: zlib.compress, PACKBITS: pack_bits}[how](raw))
    entries = [(WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [bits] * per), (COMPRESSION, "H", [how]), (PHOTOMETRIC, "H", [2 if per > 2 else 0 if white_is_zero else 1])]
    entries += [(SAMPLES, "H", [per]), (PREDICTOR, "H", [predictor])] + ([(X_RESOLUTION, "R", [dpi, 1]), (UNIT, "H", [2])] if dpi else [])
    entries += [(TILE_WIDTH, "I", [tw]), (TILE_HEIGHT, "I", [th])] if tile else [(ROWS, "I", [rows])]
    at, starts = 8, []
    for b in bodies:
        starts.append(at)
        at += len(b) + len(b) % 2
    entries += [(TILE_OFFSETS if tile else OFFSETS, "I", starts), (TILE_COUNTS if tile else COUNTS, "I", [len(b) for b in bodies])]
    extra, made = bytearray(), []
    begin = at + 2 + 12 * len(entries) + 4
    for tag, kind, values in sorted(entries):
        body = struct.pack(f"{order}{len(values)}{'I' if kind == 'R' else kind}", *values)
        if len(body) > 4:
            body, extra = struct.pack(order + "I", begin + len(extra)), extra + body
        made.append(struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "R": 5}[kind], len(values) // (2 if kind == "R" else 1)) + body.ljust(4, b"\0"))
    head = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, at)
    return head + b"".join(b + b"\0" * (len(b) % 2) for b in bodies) + struct.pack(order + "H", len(made)) + b"".join(made) + b"\0\0\0\0" + bytes(extra)
