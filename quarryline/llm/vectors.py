"""Vectors in Arrow batches, and bounded samples of them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """True if vector is neither null nor empty and holds neither nulls nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def stack(column: pa.Array, width: int) -> np.ndarray:
    """One row of `width` doubles for each list of numbers; shorter lists are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


#: What the pivots may take as doubles; they are sent to every task.
PIVOT_BYTES = 64 << 20


def pivots_for(n: int, most: int, width: int = 1) -> int:
    """About 2 * sqrt(n) reference points, so that groups grow with the square root of the rows; at most what PIVOT_BYTES hold."""
    return max(1, min(most, n, PIVOT_BYTES // (8 * max(1, width)), math.ceil(2 * math.sqrt(n))))


def sample_vectors(rows: DataFrame, vector: str, n: int, width: int) -> np.ndarray:
    """The n vectors that come first by a hash; n is bounded by the caller."""
    found = rows.select(vector).orderBy(F.xxhash64(vector), vector).limit(n).collect()
    out = np.zeros((len(found), width))
    for i, r in enumerate(found):
        out[i, : len(r[0])] = r[0]
    return out
