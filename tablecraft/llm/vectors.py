"""Vectors of numbers as columns and as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole components are held at plus or minus this, so that sums of their products stay exact in 53 bits.
LARGEST = 1 << 23


def usable(vector: Column) -> Column:
    """Whether a vector is there and has no null or non-finite component."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def whole_numbers(vector: Column, size: int) -> Column:
    """Components x as floor(256 * x); shorter vectors are padded with zeros to ``size``."""
    held = lambda x: F.least(F.greatest(x.cast("double") * 256, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))
    return F.concat(F.transform(vector, lambda x: F.floor(held(x)).cast("int")), F.array_repeat(F.lit(0), F.lit(size) - F.size(vector)))


def matrix(column: pa.ChunkedArray | pa.Array, size: int, kind=np.float64) -> np.ndarray:
    """Vectors of at most ``size`` components, one a row; shorter ones are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), size), kind)
    lengths = np.asarray(column.value_lengths().fill_null(0))
    out[np.arange(size)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out
