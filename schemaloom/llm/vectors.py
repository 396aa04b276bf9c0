"""Vectors of whole numbers: every component x becomes floor(256 * x)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are held within this, so that sums of products and of squares are exact: x within 65,536.
LARGEST = 1 << 24


def taking_part(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def whole(vector: Column) -> Column:
    """The vector's components as floor(256 * x), array<int>."""
    cell = lambda x: F.floor(F.greatest(F.least(x.cast("double") * 256, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")
    return F.transform(vector, cell)


def cells(rows: DataFrame, *others: str) -> DataFrame:
    """(vec_id, others..., cells) of the rows of (vec_id, embedding, others...) that take part."""
    return rows.filter(taking_part(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), *others, whole(F.col("embedding")).alias("cells"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of array<int> as an int64 matrix; what a row is short of width is zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    found = np.zeros((len(column), width), np.int64)
    found[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return found
