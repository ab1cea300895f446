"""Vector columns: which rows take part, and their numbers as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Not null, not empty, and neither null nor non-finite components."""
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False)
    )


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id: bigint, vector: array<double>) of the rows whose vectors are finite; other columns go."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(finite(F.col("vector")))


def matrix(column: pa.Array) -> np.ndarray:
    """One row for each vector; all have the same length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)
