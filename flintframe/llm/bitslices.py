"""Exact top-k search by inner product over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .vectors import extent, usable, whole

#: Rows of a block of the index, queries of a chunk, and lanes that the chunks of a block are dealt to.
BLOCK_ROWS, CHUNK_QUERIES, LANES = 16_384, 128, 8
_INDEX = "block int, n int, ids binary, known binary, lows binary, bits binary, slices binary"
_CHUNKS = "chunk int, ids binary, values binary"
_BEST = "query bigint, query_id bigint, vec_id bigint, score bigint"


class Block:
    """A block of rows as bitmaps: slice b of attribute d has a bit for each row, set where bit b of (value - low) is set.

    Rows are in order of id, those without one last; ``known`` is their number of ids.
    """

    def __init__(self, ids: np.ndarray, known: int, lows: np.ndarray, bits: np.ndarray, slices: np.ndarray) -> None:
        self.ids, self.known, self.lows, self.bits = ids, known, lows, bits
        self.attribute = np.repeat(np.arange(len(bits)), bits)
        self.place = np.arange(len(self.attribute)) - np.repeat(np.cumsum(bits) - bits, bits)
        self.pairs = np.stack((slices, ~slices), axis=1).reshape(2 * len(slices), slices.shape[1])  # each beside its complement
        self.all = _packed(np.ones((1, len(ids)), bool))[0]

    @classmethod
    def of(cls, ids: np.ndarray, known: int, x: np.ndarray) -> Block:
        lows = x.min(axis=0)
        above = x - lows
        bits = np.array([int(m).bit_length() for m in above.max(axis=0)], np.int64)
        each = [_packed((above[:, d] >> np.arange(b)[:, None]) & 1) for d, b in enumerate(bits) if b]
        return cls(ids, known, lows, bits, np.concatenate(each) if each else np.zeros((0, -(-len(ids) // 64)), np.uint64))

    def scores(self, query: np.ndarray) -> tuple[int, list[np.ndarray]]:
        """What all scores are above, and the slices of what they have more, from the least significant.

        A positive weight adds its attribute's slices, a negative one their complements, once for each bit of the
        weight and as much higher; slices of equal worth are added three at a time into a sum and a carry.
        """
        highs = self.lows + (1 << self.bits) - 1
        base = int(np.where(query >= 0, query * self.lows, query * highs).sum())
        weight = np.abs(query)[self.attribute]
        rows = 2 * np.arange(len(weight)) + (query < 0)[self.attribute]
        top = max((int(w).bit_length() + int(p) for w, p in zip(weight, self.place, strict=True) if w), default=0)
        out: list[np.ndarray] = []
        carried = np.zeros((0, self.pairs.shape[1]), np.uint64)
        while len(out) < top or len(carried):
            shift = len(out) - self.place
            stack = np.concatenate((self.pairs[rows[(shift >= 0) & (weight >> np.maximum(shift, 0) & 1 > 0)]], carried))
            carries = []
            while len(stack) > 1:
                m = max(1, len(stack) // 3)
                a, b = stack[:m], stack[m : 2 * m]
                half, carry = a ^ b, a & b
                if len(stack) > 2:
                    c = stack[2 * m : 3 * m]
                    carry |= half & c
                    half ^= c
                carries.append(carry)
                stack = np.concatenate((half, stack[3 * m :])) if len(stack) > 3 * m else half
            out.append(stack[0] if len(stack) else np.zeros(self.pairs.shape[1], np.uint64))
            carried = np.concatenate(carries) if carries else carried[:0]
        return base, out

    def best(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best of the block, without rows of the query's own id; ties to the first rows."""
        base, slices = self.scores(query)
        sure, edge = np.zeros_like(self.all), self.all.copy()
        own = (np.searchsorted(self.ids[: self.known], query_id, side) for side in ("left", "right"))
        out = np.arange(*own)
        np.bitwise_and.at(edge, out // 64, ~(np.uint64(1) << (out % 64).astype(np.uint64)))
        for s in reversed(slices):
            more = edge & s
            found = int(np.bitwise_count(sure | more).sum())
            if found >= k:
                edge = more
            else:
                sure, edge = sure | more, edge & ~s
        rows = np.concatenate((_rows(sure), _rows(edge)[: max(0, k - int(np.bitwise_count(sure).sum()))]))
        score = np.full(len(rows), base, np.int64)
        for t, s in enumerate(slices):
            score += (s[rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64) << t
        return rows, score


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as words of 64."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def _rows(bitmap: np.ndarray) -> np.ndarray:
    """Numbers of the set bits, ascending."""
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(bits)
    return words[word] * 64 + bit


def _read(batches: Iterator[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, whether there is one, and whole vectors of all rows of a task."""
    ids, known, x = [np.empty(0, np.int64)], [np.empty(0, bool)], [np.empty((0, width), np.int64)]
    for batch in batches:
        own = batch.column("__id")
        ids.append(own.fill_null(0).to_numpy(zero_copy_only=False))
        known.append(own.is_valid().to_numpy(zero_copy_only=False))
        x.append(whole(batch.column("__v"), width))
    return np.concatenate(ids), np.concatenate(known), np.concatenate(x)


def index(own: DataFrame, rows: int, width: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The bit-sliced index: a row for each block of about ``block_rows`` rows, dealt evenly whatever their ids."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, x = _read(batches, width)
        if len(ids):
            order = np.lexsort((ids, ~known))
            b = Block.of(ids[order], int(known.sum()), x[order])
            has = known[order]
            made = {"block": [TaskContext.get().partitionId()], "n": [len(ids)], "ids": [b.ids.tobytes()], "known": [np.packbits(has).tobytes()], "lows": [b.lows.tobytes()], "bits": [b.bits.tobytes()], "slices": [np.ascontiguousarray(b.pairs[::2]).tobytes()]}
            yield pa.RecordBatch.from_pydict(made, schema=pa.schema([("block", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "known", "lows", "bits", "slices"))]))

    return own.select("__id", "__v").repartition(max(1, -(-rows // block_rows))).mapInArrow(built, _INDEX)


def search(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest inner products of each query with vectors of other ids: query_id, rank (from 1), vec_id, score.

    A component x counts as floor(256 x), held within 2 ** 26. Ties go to the smaller id, a null id is the greatest.
    Vectors and queries that are null or hold null or non-finite components take no part; a query without an id is
    left out, and queries alike in id and vector are one. Shorter vectors count as ending in zeros. Repeated rows
    are candidates each. No candidates or no queries: no rows. Other columns are not read.

    Each query chunk meets each block of the index; a block sends on its k best rows for a query, and no scores.
    """
    own = vectors.select(F.col(id_col).cast("bigint").alias("__id"), F.col(vector_col).alias("__v")).where(usable(F.col("__v")))
    asked = queries.select(F.col(id_col).cast("bigint").alias("__id"), F.col(vector_col).alias("__v")).where(F.col("__id").isNotNull() & usable(F.col("__v"))).dropDuplicates(["__id", "__v"])
    (rows, longest), (questions, longest_query) = extent(own, "__v"), extent(asked, "__v")
    width, blocks = max(longest, longest_query), max(1, -(-rows // block_rows))
    chunks = max(1, -(-questions // chunk_queries))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, _, x = _read(batches, width)
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([ids.tobytes()]), pa.array([x.tobytes()])], ["chunk", "ids", "values"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("block", "chunk", "qids", "values")}
                if row["block"] != last:
                    held, last = _block(batch, r), row["block"]
                ids = np.frombuffer(row["qids"], np.int64)
                out = [held[0].best(q, int(i), k) for i, q in zip(ids, np.frombuffer(row["values"], np.int64).reshape(len(ids), width), strict=True)]
                n = [len(found) for found, _ in out]
                at = np.concatenate([found for found, _ in out])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat((row["chunk"] << 32) + np.arange(len(ids)), n)), pa.array(np.repeat(ids, n)), pa.array(held[0].ids[at], mask=~held[1][at]), pa.array(np.concatenate([s for _, s in out]))],
                    ["query", "query_id", "vec_id", "score"],
                )

    lane = lambda c: (F.col(c) % LANES).alias("lane")
    built = durable(index(own, rows, width, block_rows)).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(min(LANES, chunks) - 1))))
    sent = durable(asked.repartition(chunks).mapInArrow(packed, _CHUNKS)).select("chunk", F.col("ids").alias("qids"), "values", lane("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    tiles = blocks * min(LANES, chunks)
    pairs = sent.repartition(tiles, "block", "lane").join(built.repartition(tiles, "block", "lane").hint("shuffle_hash"), ["block", "lane"])
    best = pairs.mapInArrow(met, _BEST)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(batch: pa.RecordBatch, r: int) -> tuple[Block, np.ndarray]:
    """A block of the index and which of its rows have an id."""
    n = batch.column("n")[r].as_py()
    get = lambda c, kind: np.frombuffer(batch.column(c)[r].as_py(), kind)
    has = np.unpackbits(get("known", np.uint8), count=n).astype(bool)
    return Block(get("ids", np.int64), int(has.sum()), get("lows", np.int64), get("bits", np.int64), get("slices", np.uint64).reshape(-1, -(-n // 64))), has
