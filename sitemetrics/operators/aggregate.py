"""Exact, order-independent sums and small aggregate helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Doubles are summed as decimals so that results do not depend on row order.
EXACT = "decimal(30,8)"


def exact(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return F.col(name).cast(EXACT) if kind in ("double", "float") else F.col(name)


def total(x: Column) -> Column:
    """NULL-preserving sum: a group without any value stays NULL."""
    return F.sum(x)


def total_or_zero(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def as_double(*names: str) -> dict[str, Column]:
    return {n: F.col(n).cast("double") for n in names}
