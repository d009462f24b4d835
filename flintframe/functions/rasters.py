"""Steps over one image held as an array: the kernels that tasks run, a whole image at a time."""

from __future__ import annotations

import numpy as np

#: Small smoothing kernels; larger ones follow from the size.
SMALL = {1: (1.0,), 3: (0.25, 0.5, 0.25), 5: (0.0625, 0.25, 0.375, 0.25, 0.0625), 7: (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125)}
#: Neighbours of a pixel, clockwise from the right (y down).
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def odd(size: float) -> int:
    """The size as a whole odd number of at least one."""
    whole = max(1, int(size))
    return whole + 1 - whole % 2


def gaussian(size: int) -> tuple[float, ...]:
    """Weights of a smoothing kernel of an odd size; its spread grows with the size."""
    if size in SMALL:
        return SMALL[size]
    sigma = 0.3 * ((size - 1) / 2 - 1) + 0.8
    w = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return tuple(w / w.sum())


def stretched(a: np.ndarray, low: float = 0, high: float = 255) -> np.ndarray:
    """Values between low and high by the extremes of the image; low where all are equal."""
    least, span = int(a.min()), int(a.max()) - int(a.min())
    return np.floor(low + (a - least) * float(high - low) / span + 0.5).astype(int) if span else np.full(a.shape, low, int)


def deviations(a: np.ndarray) -> np.ndarray:
    s = a.std()
    return (a - a.mean()) / s if s else np.zeros(a.shape)


def equalised(a: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Local contrast: each tile's histogram, clipped, gives a curve; pixels blend the curves of the nearest tiles.

    What is clipped goes to all levels alike, and the rest to levels at equal steps from the lowest. An image that tiles
    do not divide both ways grows below and to the right, mirrored, by what the tiles lack (by one pixel a tile where
    they lack nothing).
    """
    h, w = a.shape
    whole = a.astype(int)
    if h % tiles or w % tiles:
        for axis, n in ((0, h), (1, w)):
            at = np.arange(n + tiles - n % tiles) % max(1, 2 * n - 2)
            whole = np.take(whole, n - 1 - np.abs(at - (n - 1)), axis)
    th, tw = whole.shape[0] // tiles, whole.shape[1] // tiles
    limit = max(1, int(clip * th * tw / 256))
    curves = np.zeros((tiles, tiles, 256))
    for i, j in np.ndindex(tiles, tiles):
        n = np.bincount(whole[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
        over = int(np.maximum(n - limit, 0).sum())
        n = np.minimum(n, limit) + over // 256
        rest = over % 256
        if rest:
            n[:: max(1, 256 // rest)][:rest] += 1
        curves[i, j] = np.minimum(255, np.rint(np.cumsum(n) * (255 / (th * tw))))
    y, x = np.arange(h) / th - 0.5, np.arange(w) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda i, j: curves[np.clip(i, 0, tiles - 1)[:, None], np.clip(j, 0, tiles - 1)[None, :], a.astype(int)]
    top, low = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx, at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.rint(top * (1 - fy) + low * fy).astype(int)


def _smooth(a: np.ndarray, weights: tuple[float, ...], axis: int, frame: str) -> np.ndarray:
    half, n = len(weights) // 2, a.shape[axis]
    if not half:
        return a * weights[0]
    pad = [(0, 0), (0, 0)]
    pad[axis] = (half, half)
    wide = np.pad(a, pad, mode=frame if n > 1 else "edge")
    take = lambda k: wide[k : k + n] if axis == 0 else wide[:, k : k + n]
    out = take(half) * weights[half]
    for k in range(1, half + 1):
        out = out + (take(half - k) + take(half + k)) * weights[half - k]
    return out


def blurred(a: np.ndarray, weights: tuple[float, ...], frame: str = "reflect") -> np.ndarray:
    """Weighted mean along rows, then columns; beyond the frame mirrored without the frame itself, or ("edge") as at the frame."""
    return _smooth(_smooth(a.astype(float), weights, 1, frame), weights, 0, frame)


def above_local_mean(a: np.ndarray, weights: tuple[float, ...], offset: float = 2) -> np.ndarray:
    """Where values are above their weighted local mean, as a whole number, less the offset."""
    return a > whole(blurred(a, weights, "edge")) - offset


def whole(a: np.ndarray) -> np.ndarray:
    return np.floor(a + 0.5).astype(int)


def otsu(a: np.ndarray) -> int:
    """The level that best parts the values in two classes; the smallest of equals."""
    v, n = np.unique(a, return_counts=True)
    n0, s0 = np.cumsum(n).astype(float), np.cumsum(n * v).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.round((s0 * n0[-1] - s0[-1] * n0) ** 2 / (n0 * (n0[-1] - n0)), 3)
    return int(v[np.argmax(np.nan_to_num(between, posinf=0.0))])


def closed(a: np.ndarray, size: int) -> np.ndarray:
    """Dilation, then erosion, with a square; what is beyond the frame does not count."""
    before, after = size // 2, size - 1 - size // 2
    for fill, pick, lo, hi in ((a.min(), np.maximum, before, after), (a.max(), np.minimum, after, before)):
        for axis in (1, 0):
            n = a.shape[axis]
            pad = [(0, 0), (0, 0)]
            pad[axis] = (lo, hi)
            wide = np.pad(a, pad, constant_values=fill)
            out = np.take(wide, np.arange(n), axis)
            for k in range(1, size):
                out = pick(out, np.take(wide, np.arange(k, k + n), axis))
            a = out
    return a


def labels(on: np.ndarray, eight: bool = True) -> np.ndarray:
    """0 where off, else a number of the component, in order of its first pixel (row by row).

    Rows are cut into runs; runs that touch in following rows take the smaller number until nothing changes.
    """
    h, w = on.shape
    edge = np.diff(np.pad(on.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    wide, slack = w + 4, int(eight)
    lo = np.searchsorted(row * wide + end + 2, (row + 1) * wide + start + 2 - slack, side="right")
    hi = np.maximum(lo, np.searchsorted(row * wide + start + 2, (row + 1) * wide + end + 2 + slack, side="left"))
    a = np.repeat(np.arange(len(row)), hi - lo)
    b = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange(len(a)) if len(a) else a
    up = np.arange(len(row))
    while len(a):
        x, y = up[a], up[b]
        if (x == y).all():
            break
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
    _, number = np.unique(up, return_inverse=True)
    out = np.zeros(h * w, np.int64)
    n = end - start
    out[np.repeat(row * w + start - (np.cumsum(n) - n), n) + np.arange(n.sum())] = np.repeat(number + 1, n)
    return out.reshape(h, w)


def _first(numbers: np.ndarray) -> np.ndarray:
    """Place in the flat array of the first pixel of each number from 1."""
    found, at = np.unique(numbers.ravel(), return_index=True)
    return at[found > 0]


def _followed(on: np.ndarray, start: tuple[int, int], off: int) -> list[tuple[int, int]]:
    """Pixels (y, x) of the border through start, whose neighbour in direction off is not set; corners only.

    The border is walked with what is outside on one side, until it leaves the start the way it first did.
    """
    turn = lambda y, x, d, step: next((k % 8 for k in range(d, d + 8 * step, step) if on[y + _AROUND[k % 8][0], x + _AROUND[k % 8][1]]), None)
    y, x = start
    back = turn(y, x, off, 1)
    if back is None:
        return [start]
    last = (y + _AROUND[back][0], x + _AROUND[back][1])
    d, path = back, []
    while True:
        d = turn(y, x, d - 1 + 8, -1)
        path.append((y, x, d))
        ny, nx = y + _AROUND[d][0], x + _AROUND[d][1]
        if (ny, nx) == start and (y, x) == last:
            break
        y, x, d = ny, nx, (d + 4) % 8
    return [(a, b) for k, (a, b, d) in enumerate(path) if d != path[k - 1][2]]


def outlines(on: np.ndarray) -> list[tuple[int | None, list[tuple[int, int]]]]:
    """All borders of a binary image as (number of the border around it or None, corners (x, y)).

    Set pixels join over eight neighbours, others over four. Each component has an outer border, and one around each
    hole in it, along its own pixels. Borders are in order of the first pixel of their component or hole.
    """
    framed = np.pad(on, 1)
    fore, back = labels(framed, True), labels(~framed, False)
    w = framed.shape[1]
    frame = back[0, 0]
    starts = [(int(p), True, k + 1) for k, p in enumerate(_first(fore))] + [(int(p), False, k + 1) for k, p in enumerate(_first(back)) if k + 1 != frame]
    starts.sort()
    number = {(outer, k): i for i, (_, outer, k) in enumerate(starts)}
    found = []
    for p, outer, _ in starts:
        y, x = divmod(p, w)
        beside = (back if outer else fore)[y, x - 1]
        corners = _followed(framed, (y, x), 4) if outer else _followed(framed, (y, x - 1), 0)
        found.append((number.get((not outer, beside)), [(b - 1, a - 1) for a, b in corners]))
    return found


def filled(points: list[tuple[int, int]], x0: int, y0: int, w: int, h: int) -> np.ndarray:
    """Pixels of a window that are inside a polygon (x, y) or on its outline."""
    p = np.asarray(points, np.int64).reshape(-1, 2) - (x0, y0)
    q = np.roll(p, -1, axis=0)
    out = np.zeros((h, w), bool)
    flips = np.zeros((h, w + 1), np.int64)
    for (ax, ay), (bx, by) in zip(p.tolist(), q.tolist(), strict=True):
        lo, hi = min(ay, by), max(ay, by)
        y = np.arange(max(lo, 0), min(hi, h - 1) + 1)
        if ay == by:
            if 0 <= ay < h:
                out[ay, max(0, min(ax, bx)) : max(0, max(ax, bx) + 1)] = True
            continue
        top = (bx - ax) * (y - ay)
        x = ax + top // (by - ay)
        exact = top % (by - ay) == 0
        on = exact & (x >= 0) & (x < w)
        out[y[on], x[on]] = True
        half = y < hi
        np.add.at(flips, (y[half], np.clip(x + ~exact, 0, w)[half]), 1)
    return out | (np.cumsum(flips, axis=1)[:, :w] % 2 == 1)


def canny(a: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edge pixels: gradients that are greatest across the edge and over high, or over low and joined to such."""
    wide = np.pad(a.astype(int), 1, mode="edge")
    h, w = a.shape
    at = lambda dy, dx: wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    size = np.abs(gx) + np.abs(gy)
    ring = np.pad(size, 1)
    to = lambda dy, dx: ring[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    x, y = np.abs(gx), np.abs(gy)
    flat, steep = y < np.tan(np.pi / 8) * x, y > np.tan(3 * np.pi / 8) * x
    down = (gx < 0) == (gy < 0)
    across = np.where(flat, (size > to(0, -1)) & (size >= to(0, 1)), np.where(steep, (size > to(-1, 0)) & (size >= to(1, 0)), np.where(down, (size > to(-1, -1)) & (size > to(1, 1)), (size > to(-1, 1)) & (size > to(1, -1)))))
    weak = across & (size > low)
    parts = labels(weak, True)
    strong = np.unique(parts[weak & (size > high)])
    return weak & np.isin(parts, strong)


def texture(a: np.ndarray, points: list[tuple[int, int]], most: int = 50) -> tuple[float, float, float]:
    """Of a polygon's pixels: small components a thousand, variance after smoothing, and share of edge pixels.

    The image is cut to the polygon's box and is 0 outside the polygon. Boxes of five pixels or less have no variance.
    """
    p = np.asarray(points, int).reshape(-1, 2)
    x0, y0 = p.min(axis=0)
    w, h = p.max(axis=0) - (x0, y0) + 1
    mask = filled(points, x0, y0, w, h)
    part = np.where(mask, a[y0 : y0 + h, x0 : x0 + w], 0)
    pixels = int(mask.sum())
    sizes = np.bincount(labels(part > 0).ravel())[1:]
    spread = float(np.var(whole(blurred(part, SMALL[5]))[mask])) if min(w, h) > 5 else 0.0
    return int(((sizes >= 1) & (sizes <= most)).sum()) / pixels * 1000, spread, float(canny(part).sum()) / pixels


def binarised(grey: np.ndarray, dpi: float | None, p, scaling) -> np.ndarray:
    """A grey image as a binary one with the drawing set: contrast, smoothing, threshold, inversion, closing.

    p and scaling are the sections of the options; kernels grow with a known resolution where scaling is on.
    """
    scale = kernel_scale(dpi, scaling)
    if p.grey == "clahe":
        grey = equalised(grey)
    elif p.grey not in ("standard", "off"):
        raise ValueError(f"unknown grey method {p.grey}")
    if p.normalise not in ("minmax", "zscore", "off"):
        raise ValueError(f"unknown normalisation {p.normalise}")
    even = {"minmax": lambda: stretched(grey, *p.clip), "zscore": lambda: deviations(grey), "off": lambda: grey}[p.normalise]()
    smooth = blurred(even, gaussian(odd(p.blur * scale)))
    smooth = smooth if p.normalise == "zscore" else whole(smooth)
    if p.threshold == "otsu":
        on = smooth > otsu(smooth)
    elif p.threshold == "adaptive":
        on = above_local_mean(smooth, gaussian(odd(p.block * scale)))
    elif p.threshold in ("simple", "default"):
        on = smooth > p.threshold_at
    else:
        raise ValueError(f"unknown threshold {p.threshold}")
    binary = np.where(on, 0, 255)
    return (closed(binary, max(1, int(p.closing * scale))) if p.closing else binary).astype(np.uint8)


def kernel_scale(dpi: float | None, scaling) -> float:
    """The factor by which kernels grow with the resolution; 1 if disabled or unknown."""
    if not scaling.enabled or not dpi or dpi <= 0:
        return 1.0
    raw = dpi / scaling.reference
    by = {"conservative": min(1 + (raw - 1) / 2, scaling.most), "standard": min(raw, scaling.most)}
    return max(1.0, by.get(scaling.mode, raw))
