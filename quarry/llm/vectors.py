"""Vectors as columns: rows that take part, and their components as integers in numpy blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True if the vector is there and every component of it is a finite number."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def longest(rows: DataFrame, vector: str) -> int:
    """The greatest number of components; shorter vectors count as filled up with zeros."""
    return rows.agg(F.max(F.size(vector))).head()[0] or 0


def integers(vectors: pa.Array, dims: int, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) of each component x as double, one row a vector, cut to -most..most; int64."""
    size = np.asarray(vectors.value_lengths())
    values = np.floor(np.asarray(vectors.flatten(), np.float64) * scale)
    values = np.clip(values, -most, most).astype(np.int64)
    if (size == dims).all():
        return values.reshape(len(size), dims)
    out = np.zeros((len(size), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = values
    return out


def blocks(batches: Iterator[pa.RecordBatch], first: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``first`` rows, then twice as many each time, ``most`` at last."""
    n = first
    for batch in batches:
        i = 0
        while i < batch.num_rows:
            yield batch.slice(i, n)
            i, n = i + n, min(2 * n, most)
