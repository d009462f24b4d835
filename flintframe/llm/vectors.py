"""Vectors of whole numbers from embedding columns, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component x counts as floor(SCALE * x), held within plus or minus MOST so that sums of products stay whole numbers of 64 bits.
SCALE, MOST = 256, 1 << 26


def usable(embedding: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def extent(vectors: DataFrame, embedding: str) -> tuple[int, int]:
    """Rows and components of the longest vector."""
    rows, longest = vectors.agg(F.count(F.lit(1)), F.max(F.size(embedding))).first()
    return rows, longest or 0


def whole(vectors: pa.Array, width: int) -> np.ndarray:
    """A row of ``width`` whole numbers for each vector; shorter vectors end in zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width), np.int64)
    flat = np.clip(np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out
