"""Cutting a table into key ranges of about equal rows, so that a global order takes one shuffle and no single task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, n: int) -> np.ndarray:
    """At most n - 1 ascending bounds of a bigint key, from a scan of that column alone; equal keys never fall apart."""
    if n < 2:
        return np.zeros(0, np.int64)
    found = df.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 20 * n).alias("p")).first()["p"]
    return np.unique(np.array(found or [], np.int64))


def range_of(bounds: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Number of each key's range; a null key is in range 0, before all others."""
    values = keys.fill_null(0).to_numpy(zero_copy_only=False)
    return np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(bounds, values, "right")).astype(np.int32)
