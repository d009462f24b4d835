"""Vector codes: each part of a vector by its nearest codebook entry, found by annular norm pruning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .vectors import extent, usable, whole

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows whose candidate entries are held at once.
AT_ONCE = 4096
#: Keys that the rows of one label are dealt to when its sum is joined back.
SALTS = 32


class Annuli:
    """A codebook with its entries in order of norm."""

    def __init__(self, book: np.ndarray) -> None:
        norms = np.sqrt((book * book).sum(axis=1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.book = norms[self.order], book[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row, ties to the lower index.

        An entry whose norm differs from the row's by more than the best distance so far is farther than that. The
        entry next in norm gives a first distance, binary search the ring of norms that it allows, both edges included,
        and all entries of the ring are held against the row in whole numbers.
        """
        own = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        first = np.minimum(np.searchsorted(self.norms, own), len(self.norms) - 1)
        best = np.sqrt(((x - self.book[first]) ** 2).sum(axis=1).astype(np.float64))
        slack = 1e-9 * (1 + own + best)  # square roots are rounded; a ring too wide loses nothing
        low = np.searchsorted(self.norms, own - best - slack, "left")
        n = np.searchsorted(self.norms, own + best + slack, "right") - low
        starts = np.cumsum(n) - n
        row = np.repeat(np.arange(len(x)), n)
        entry = np.arange(len(row)) - np.repeat(starts - low, n)
        distance = ((x[row] - self.book[entry]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(distance, starts) if len(x) else distance
        index = np.where(distance == least[row], self.order[entry], len(self.order))
        return (np.minimum.reduceat(index, starts) if len(x) else index), least


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of batches with their parts (row, part, position), indexes and squared distances (row, part)."""
    rings = [Annuli(b) for b in books]
    parts, _, step = books.shape
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            piece = batch.slice(at, AT_ONCE)
            x = whole(piece.column("__v"), parts * step).reshape(piece.num_rows, parts, step)
            found = [ring.nearest(x[:, p]) for p, ring in enumerate(rings)]
            yield piece, x, np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def refined(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: each entry the floor of the mean of its parts, as it was where it has none.

    Tasks send a sum for each entry and position that they have met, at most as many as the codebooks have numbers;
    as many, summed, reach the driver.
    """
    parts, entries, step = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts * entries, step + 1), np.int64)
        for _, x, index, _ in _assigned(batches, books):
            cell = (index + np.arange(parts) * entries).ravel()
            sums[:, 0] += np.bincount(cell, minlength=len(sums))
            for k in range(step):
                np.add.at(sums[:, k + 1], cell, x[:, :, k].ravel())
        at = np.repeat(sums[:, :1] > 0, step + 1, axis=1)
        yield pa.RecordBatch.from_pydict({"at": np.flatnonzero(at.ravel()), "n": sums[at]})

    sums = np.zeros(parts * entries * (step + 1), np.int64)
    found = kept.mapInArrow(summed, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums[found["at"].to_numpy()] = found["n"].to_numpy()
    sums = sums.reshape(parts, entries, step + 1)
    return np.where(sums[:, :, :1] > 0, sums[:, :, 1:] // np.maximum(sums[:, :, :1], 1), books)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """One row a vector: id, code, error and label_error; and the codebooks (part, entry, position).

    A component x counts as floor(256 x); vectors that are null or hold null or non-finite components are left out.
    The codebooks begin as the parts of the ``entries`` vectors with the smallest ids (a null id comes last, ties go
    by vector), in that order, and only these and the codebooks' sums reach the driver. A vector that is shorter than
    the longest, or than the next multiple of ``parts``, counts as ending in zeros. Components beyond 2 ** 26 after
    scaling count as that. Repeated rows are coded alike and all count in means and sums; rows with a null label are
    one group; without vectors there is no row and no entry; other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    own = vectors.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"), F.col(vector_col).alias("__v")).where(usable(F.col("__v")))
    _, longest = extent(own, "__v")
    step = -(-longest // parts)
    begin = own.select("__id", "__v").orderBy(F.col("__id").asc_nulls_last(), "__v").limit(entries).toArrow()
    books = whole(begin["__v"].combine_chunks(), parts * step).reshape(begin.num_rows, parts, step).transpose(1, 0, 2)
    if not begin.num_rows:
        return own.select(F.col("__id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error")), books
    for _ in range(rounds):
        books = refined(own.select("__v"), books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, index, distance in _assigned(batches, books):
            digits, n = index.astype(np.uint8).tobytes().hex(), 2 * parts
            code = [digits[k : k + n] for k in range(0, len(digits), n)]
            yield pa.RecordBatch.from_arrays([piece.column("__id"), piece.column("__label"), pa.array(code, pa.string()), pa.array(distance.sum(axis=1))], ["__id", "__label", "code", "error"])

    kinds = dict(own.dtypes)
    made = durable(own.mapInArrow(coded, f"__id {kinds['__id']}, __label {kinds['__label']}, code string, error bigint"))
    salt = F.pmod(F.xxhash64("__id", "code"), F.lit(SALTS)).cast("int")
    sums = made.groupBy("__label").agg(F.sum("error").alias("label_error")).select(F.col("__label").alias("__l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__s"))
    joined = made.withColumn("__salt", salt).join(sums, F.col("__label").eqNullSafe(F.col("__l")) & (F.col("__salt") == F.col("__s")))
    return joined.select(F.col("__id").alias(id_col), "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers of the codebooks, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
