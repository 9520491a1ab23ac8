"""Vectors of a table: which take part in comparisons, and their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: Column) -> Column:
    """Not null, all components present and finite, and not zero."""
    finite = F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def sound_vectors(rows: DataFrame, vec_id: str, embedding: str, *more: Column) -> DataFrame:
    """``vec_id, vec, dim`` (and more columns) of the vectors that take part."""
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"),
                       F.col(embedding).cast("array<double>").alias("vec"), *more).filter(
        sound(F.col("vec"))).withColumn("dim", F.size("vec"))
