"""Raster operators on pixel tables (image_id, y, x, v), a dense row a pixel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rasters
from ..functions.durable import kept
from ..options import Options

GAUSS5 = rasters.SMALL[5]
TEXTURE = ("stippling_density", "texture_variance", "edge_density")


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).cast("int")


def _gathered(pixels: DataFrame) -> DataFrame:
    """A row an image: image_id and all its pixels as an array of (y, x, v)."""
    return pixels.groupBy("image_id").agg(F.collect_list(F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")).alias("pixels"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """image_id, y, x and v of each gathered image."""
    for batch in batches:
        every = batch.column("pixels")
        flat, ends = every.flatten(), np.concatenate(([0], np.cumsum(every.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        y, x, v = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        for k, image_id in enumerate(batch.column("image_id").to_pylist()):
            own = slice(ends[k], ends[k + 1])
            yield image_id, y[own], x[own], v[own]


def _apart(made: Iterator[tuple[str, tuple[np.ndarray, ...]]], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for image_id, columns in made:
        one = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([image_id], pa.string()), *one], ["image_id", *names])


def _pixelwise(pixels: DataFrame, step: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], kind: str, name: str = "v") -> DataFrame:
    """image_id, y, x and what step(y, x, v) gives for each pixel of an image; images travel as one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _apart(((i, (y, x, step(y, x, v))) for i, y, x, v in _read(batches)), ("ys", "xs", "vs"))

    made = _gathered(pixels).mapInArrow(run, f"image_id string, ys array<int>, xs array<int>, vs array<{kind}>")
    return made.select("image_id", F.inline(F.arrays_zip("ys", "xs", "vs"))).toDF("image_id", "y", "x", name)


def _each(pixels: DataFrame, step: Callable[[np.ndarray], np.ndarray], kind: str = "int") -> DataFrame:
    """step over each image as an array: one shuffle by image, whatever the step looks at."""
    form = {"int": np.int32, "double": np.float64}[kind]

    def run(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        y, x = y - y.min(), x - x.min()
        a = np.zeros((y.max() + 1, x.max() + 1), v.dtype)
        a[y, x] = v
        return step(a)[y, x].astype(form)

    return _pixelwise(pixels, run, kind)


def normalise(pixels: DataFrame, method: str = "minmax", low: int = 0, high: int = 255) -> DataFrame:
    """Values stretched to [low, high] by the image's extremes, or in deviations from its mean; other methods fail."""
    if method == "minmax":
        return _each(pixels, lambda a: rasters.stretched(a, low, high))
    if method == "zscore":
        return _each(pixels, rasters.deviations, "double")
    raise ValueError(f"unknown normalisation {method}")


def equalise(pixels: DataFrame, tiles: int = 8, clip: float = 2.0) -> DataFrame:
    """Local contrast by clipped histograms of tiles."""
    return _each(pixels, lambda a: rasters.equalised(a, tiles, clip))


def blur(pixels: DataFrame, weights: tuple[float, ...] = GAUSS5) -> DataFrame:
    """Separable blur: along rows, then along columns, mirrored at the frame without the frame itself."""
    return _each(pixels, lambda a: rasters.blurred(a, weights), "double")


def rounded(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", F.floor(F.col("v") + 0.5).cast("int"))


def threshold(pixels: DataFrame, at: Column | int, most: int = 255) -> DataFrame:
    return pixels.withColumn("v", F.when(F.col("v") > at, most).otherwise(0))


def otsu_levels(pixels: DataFrame) -> DataFrame:
    """By image: the level that maximises the variance between classes; the smallest of equals."""
    hist = pixels.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("image_id").orderBy("v")
    every = Window.partitionBy("image_id")
    h = hist.select("image_id", "v", F.sum("n").over(up).cast("double").alias("n0"), F.sum(F.col("n") * F.col("v")).over(up).cast("double").alias("s0"), F.sum("n").over(every).cast("double").alias("n"), F.sum(F.col("n") * F.col("v")).over(every).cast("double").alias("s"))
    between = F.round(F.pow(F.col("s0") * F.col("n") - F.col("s") * F.col("n0"), F.lit(2)) / F.nullif(F.col("n0") * (F.col("n") - F.col("n0")), F.lit(0.0)), 3)
    return h.groupBy("image_id").agg(F.min(F.struct((-F.coalesce(between, F.lit(0.0))).alias("b"), "v")).alias("best")).select("image_id", F.col("best.v").alias("level"))


def threshold_otsu(pixels: DataFrame, most: int = 255) -> DataFrame:
    return threshold(pixels.join(otsu_levels(pixels), "image_id"), F.col("level"), most).drop("level")


def threshold_adaptive(pixels: DataFrame, size: int = 11, offset: float = 2.0, most: int = 255) -> DataFrame:
    """Pixels above their weighted mean in a square of this size, as a whole number, less the offset."""
    return _each(pixels, lambda a: np.where(rasters.above_local_mean(a, rasters.gaussian(size), offset), most, 0))


def invert(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", 255 - F.col("v"))


def close(pixels: DataFrame, size: int = 3) -> DataFrame:
    """Dilation, then erosion, with a square of this size."""
    return _each(pixels, lambda a: rasters.closed(a, size))


def dpi_scale(dpi: Column, reference: float = 300.0, mode: str = "conservative", most: float = 3.0, enabled: bool = True) -> Column:
    """The factor by which kernels grow with the resolution; 1 if disabled or unknown."""
    raw = dpi / reference
    if not enabled:
        return F.lit(1.0)
    one, top = F.lit(1.0), F.lit(most)
    by = {"conservative": F.greatest(one, F.least(top, 1 + (raw - 1) / 2)), "standard": F.greatest(one, F.least(top, raw))}
    return F.when(dpi > 0, by.get(mode, F.greatest(one, raw))).otherwise(1.0)


def odd_kernel(size: Column) -> Column:
    """The size as a whole odd number of at least one."""
    whole = F.greatest(F.lit(1), size.cast("int"))
    return F.when(whole % 2 == 0, whole + 1).otherwise(whole)


def preprocess(pixels: DataFrame, options: Options | None = None, dpi: float | None = None) -> DataFrame:
    """Contrast, blur, threshold, inversion and closing in turn, by the options (and a resolution), in one pass an image."""
    o = options or Options()
    return _each(pixels, lambda a: rasters.binarised(a, dpi, o.preprocessing, o.dpi).astype(int))


def regions(pixels: DataFrame, eight: bool = True) -> DataFrame:
    """image_id, y, x, root for set pixels (v > 0): the component's first pixel as (y, x) in 32 + 32 bits."""
    def run(y: np.ndarray, x: np.ndarray, _: np.ndarray) -> np.ndarray:
        y0, x0 = y.min(), x.min()
        y, x = y - y0, x - x0
        on = np.zeros((y.max() + 1, x.max() + 1), bool)
        on[y, x] = True
        number = rasters.labels(on, eight)
        at = rasters._first(number)
        root = (at // on.shape[1] + y0).astype(np.int64) * (1 << 32) + at % on.shape[1] + x0
        return root[number[y, x] - 1]

    return _pixelwise(pixels.where(F.col("v") > 0), run, "bigint", "root")


def joined(edges: DataFrame) -> DataFrame:
    """image_id, node, root: the least node that edges (image_id, a, b) lead to, for each node of an edge.

    Each round, a node takes the least root beside it and then that root's own; what is found so far is kept, so rounds
    do not repeat each other, and there are about as many as the logarithm of the longest way.
    """
    both = kept(edges.select("image_id", "a", "b").unionByName(edges.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = kept(both.groupBy("image_id", F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")))
    while True:
        of = roots.select("image_id", F.col("node").alias("b"), F.col("root").alias("other"))
        near = both.join(of, ["image_id", "b"]).groupBy("image_id", F.col("a").alias("node")).agg(F.min("other").alias("other"))
        taken = roots.join(near, ["image_id", "node"]).select("image_id", "node", "root", F.least("root", "other").alias("new"))
        jump = taken.groupBy("image_id", F.col("node").alias("new")).agg(F.min("new").alias("further"))
        moved = kept(taken.join(jump, ["image_id", "new"], "left").select("image_id", "node", "root", F.least("new", F.coalesce("further", "new")).alias("new")))
        if moved.where("new <> root").isEmpty():
            return roots
        roots = moved.select("image_id", "node", F.col("new").alias("root"))


def tiled_regions(pixels: DataFrame, tile: int = 1024) -> DataFrame:
    """regions() over eight neighbours of images that no task could hold: labelled by square tiles, then joined across their borders.

    A task holds one tile. Only pixels at borders of tiles meet those beyond, and only labels that do take part in the
    rounds of joined().
    """
    on = pixels.where(F.col("v") > 0).select("image_id", "y", "x", "v").withColumn("__t", F.struct("image_id", F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")))
    named = on.select(F.to_json("__t").alias("image_id"), "y", "x", "v")
    own = kept(regions(named).withColumn("__t", F.from_json("image_id", "image_id string, ty bigint, tx bigint")).select("__t.image_id", "y", "x", "root"))
    rim = lambda c: (F.col(c) % tile == 0) | (F.col(c) % tile == tile - 1)
    edge = own.where(rim("y") | rim("x"))
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    beyond = edge.select("image_id", F.col("root").alias("b"), "y", "x", steps.alias("s")).select("image_id", "b", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    met = edge.join(beyond, ["image_id", "y", "x"]).select("image_id", F.col("root").alias("a"), "b").where("a <> b").distinct()
    roots = joined(met).select("image_id", F.col("node").alias("root"), F.col("root").alias("__least"))
    return own.join(roots, ["image_id", "root"], "left").select("image_id", "y", "x", F.coalesce("__least", "root").alias("root"))


OUTLINES = "image_id string, contour_id bigint, parent_contour_id bigint, contour array<struct<x:int,y:int>>, width int, height int"


_POINT = pa.struct([("x", pa.int32()), ("y", pa.int32())])
_OUTLINES = pa.schema([("image_id", pa.string()), ("contour_id", pa.int64()), ("parent_contour_id", pa.int64()), ("contour", pa.list_(_POINT)), ("width", pa.int32()), ("height", pa.int32())])


def _outlined(image_id: str, a: np.ndarray) -> pd.DataFrame:
    found = rasters.outlines(a > 0)
    return pd.DataFrame({
        "image_id": image_id, "contour_id": np.arange(len(found)), "parent_contour_id": pd.array([p for p, _ in found], "Int64"),
        "contour": pd.Series([[{"x": int(x), "y": int(y)} for x, y in c] for _, c in found], dtype=object), "width": a.shape[1], "height": a.shape[0]})


def outlines(pixels: DataFrame) -> DataFrame:
    """Contours of a binary image with their nesting: image_id, contour_id, parent_contour_id, contour (corners), width, height.

    Outer contours run along components of eight neighbours, inner ones around each of their holes; both lie on set
    pixels. Ids are in order of the first pixel of the component or hole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image_id, y, x, v in _read(batches):
            a = np.zeros((y.max() + 1, x.max() + 1), np.uint8)
            a[y, x] = v > 0
            yield pa.RecordBatch.from_pandas(_outlined(image_id, a), _OUTLINES, preserve_index=False)

    return _gathered(pixels).mapInArrow(run, OUTLINES)


def textures(pixels: DataFrame, polygons: DataFrame) -> DataFrame:
    """polygons (image_id, contour_id, contour) with stippling_density, texture_variance and edge_density of their pixels in the image."""
    def run(rows: pd.DataFrame, shapes: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(shapes):
            return pd.DataFrame(columns=["image_id", "contour_id", *TEXTURE])
        a = np.zeros((rows["y"].max() + 1, rows["x"].max() + 1), int)
        a[rows["y"], rows["x"]] = rows["v"]
        made = [rasters.texture(a, list(zip(x, y, strict=True))) for x, y in zip(shapes["xs"], shapes["ys"], strict=True)]
        return pd.concat((shapes[["image_id", "contour_id"]].reset_index(drop=True), pd.DataFrame(made, columns=list(TEXTURE))), axis=1)

    apart = polygons.select("image_id", "contour_id", F.transform("contour", lambda v: v["x"]).alias("xs"), F.transform("contour", lambda v: v["y"]).alias("ys"))
    left = pixels.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v").groupBy("image_id")
    return left.cogroup(apart.groupBy("image_id")).applyInPandas(run, "image_id string, contour_id bigint, " + ", ".join(f"{c} double" for c in TEXTURE))


def _tree(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> tuple[pa.Array | np.ndarray, ...]:
    """root, hole, area, least and greatest x and y, and parent's root of the regions of an image in a frame of one pixel."""
    y0, x0 = int(y.min()), int(x.min())
    on = np.zeros((y.max() - y0 + 3, x.max() - x0 + 3), bool)
    on[y - y0 + 1, x - x0 + 1] = v > 0
    wide, made = on.shape[1], []
    both = rasters.labels(on, True), rasters.labels(~on, False)
    code = lambda flat: (flat // wide + y0).astype(np.int64) * (1 << 32) + flat % wide + x0
    first = [rasters._first(own) for own in both]
    frame = both[1][0, 0]
    for k, (own, other) in enumerate((both, both[::-1])):
        r, c = np.nonzero(own)
        n, label = len(first[k]), own[r, c] - 1
        ends = [np.full(n, wide * len(on)), np.full(n, -1), np.full(n, wide * len(on)), np.full(n, -1)]
        for out, f, at in zip(ends, (np.minimum, np.maximum) * 2, (c, c, r, r), strict=True):
            f.at(out, label, at)
        stays = np.arange(n) != frame - 1 if k else np.ones(n, bool)
        around = other.ravel()[first[k][stays] - 1]
        outer = around == frame if k == 0 else np.zeros(len(around), bool)
        up = pa.array(code(first[1 - k][around - 1]), mask=outer)
        less = lambda values, low: (values[stays] + low - 1).astype(np.int32)  # noqa: B023, E731
        made.append((code(first[k][stays]), np.full(stays.sum(), bool(k)), np.bincount(label, minlength=n)[stays], less(ends[0], x0), less(ends[1], x0), less(ends[2], y0), less(ends[3], y0), up))
    return tuple(pa.concat_arrays([pa.array(p), pa.array(q)]) for p, q in zip(*made, strict=True))


def region_tree(pixels: DataFrame) -> DataFrame:
    """Nested regions of a binary image: image_id, root, hole, area, bounding box, parent_root.

    Foreground regions join over eight neighbours, background over four; the frame's background has no row. What lies
    to the left of a region's first pixel is the region around it. Places without a row are background.
    """
    kinds = {"root": "bigint", "hole": "boolean", "area": "bigint", "min_x": "int", "max_x": "int", "min_y": "int", "max_y": "int", "parent_root": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _apart(((i, _tree(y, x, v)) for i, y, x, v in _read(batches)), tuple(kinds))

    made = _gathered(pixels).mapInArrow(run, "image_id string, " + ", ".join(f"{c} array<{t}>" for c, t in kinds.items()))
    return made.select("image_id", F.inline(F.arrays_zip(*kinds)))


def stippling(pixels: DataFrame, mask_pixels: Column | None = None, most: int = 50) -> DataFrame:
    """By image: small components (up to ``most`` pixels) for each thousand pixels of the mask (here: all rows)."""
    small = regions(pixels).groupBy("image_id", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).groupBy("image_id").agg(F.count(F.lit(1)).alias("k"))
    size = pixels.groupBy("image_id").agg(F.count(F.lit(1)).alias("m"))
    return size.join(small, "image_id", "left").select("image_id", (F.coalesce("k", F.lit(0)) / F.col("m") * 1000).alias("stippling_density"))


def texture_variance(pixels: DataFrame) -> DataFrame:
    """By image: population variance of the blurred values; 0 if it is five pixels or less either way."""
    spread = rounded(blur(pixels)).groupBy("image_id").agg(F.var_pop("v").alias("s"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    return spread.select("image_id", F.when((F.col("w") <= 5) | (F.col("h") <= 5), 0.0).otherwise(F.col("s")).alias("texture_variance"))


def edges(pixels: DataFrame, low: float = 50, high: float = 150) -> DataFrame:
    """Pixels on edges as 255, others 0: greatest across the edge and over high, or over low and joined to such."""
    return _each(pixels, lambda a: np.where(rasters.canny(a, low, high), 255, 0))


def edge_density(pixels: DataFrame) -> DataFrame:
    """By image: share of edge pixels."""
    return edges(pixels).groupBy("image_id").agg((F.count_if(F.col("v") > 0) / F.count(F.lit(1))).alias("edge_density"))
