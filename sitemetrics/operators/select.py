"""User selections and day ranges as filters; ranges also name the months, so that a store partitioned by month is pruned."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selected(df: DataFrame, column: str, picks: list) -> DataFrame:
    """Rows whose column is among the picks; no picks means no filter."""
    return df.where(F.col(column).isin(list(picks))) if picks else df


def _month(day: dt.date) -> int:
    return day.year * 100 + day.month


def within(df: DataFrame, start: dt.date, end: dt.date, day: str = "date") -> Column:
    """Closed range, bounds in either order; ``year_month`` is narrowed too where ``df`` has it."""
    lo, hi = sorted((start, end))
    inside = F.col(day).between(F.lit(lo), F.lit(hi))
    return F.col("year_month").between(_month(lo), _month(hi)) & inside if "year_month" in df.columns else inside


def within_any(df: DataFrame, ranges: list[tuple[dt.date, dt.date]], day: str = "date") -> Column:
    """Any of the closed ranges. The months are a condition of their own: only as a conjunct do they prune partitions."""
    out, months = F.lit(False), F.lit(False)
    for start, end in ranges:
        lo, hi = sorted((start, end))
        out = out | F.col(day).between(F.lit(lo), F.lit(hi))
        if "year_month" in df.columns:
            months = months | F.col("year_month").between(_month(lo), _month(hi))
    return months & out if "year_month" in df.columns else out


def starting_until(df: DataFrame, end: dt.date) -> Column:
    """Rows of the months up to that of ``end``: spans that begin later can't touch a range that ends there."""
    return F.col("year_month") <= _month(end) if "year_month" in df.columns else F.lit(True)


def on_days(df: DataFrame, days: list[dt.date], day: str = "date") -> Column:
    if not days:
        return F.lit(False)
    some = F.col(day).isin(days)
    return F.col("year_month").isin(sorted({_month(d) for d in days})) & some if "year_month" in df.columns else some
