"""What the embedding operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector that is not null, not empty, not all zero and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def numeric(df: DataFrame, column: str = "embedding") -> Column:
    """The vectors as floats or doubles, whichever holds them exactly."""
    kind = df.schema[column].dataType.simpleString()
    return F.col(column) if kind in ("array<float>", "array<double>") else F.col(column).cast("array<double>")


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to q; where squares would leave the range of doubles they are taken of scaled differences."""
    with np.errstate(over="ignore"):
        difference = x - q
        out = np.sqrt((difference**2).sum(axis=1))
        largest = np.abs(difference).max(axis=1, initial=0.0)
        odd = np.flatnonzero(np.isfinite(largest) & (largest > 0) & ((largest > 1e150) | (largest < 1e-140)))
        if len(odd):
            scaled = difference[odd] / largest[odd, None]
            out[odd] = largest[odd] * np.sqrt((scaled**2).sum(axis=1))
    return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """(rows, dimension) doubles of a list column whose lists all have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
