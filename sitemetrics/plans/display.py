"""Last projection before display: texts chosen by column family, headers renamed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import formats as FM


def formatter(name: str) -> Column:
    """Text of one numeric column by what its name says it holds."""
    if "pct_change" in name or name.endswith("variance_pct"):
        return FM.pct_text(name)
    if "penetration" in name:
        return FM.pct_text(F.col(name) / 100.0, signed=False)
    if "per_visitor" in name:
        return FM.spend_text(name)
    if "traffic" in name or "pax" in name and "per_pax" not in name:
        return FM.pax_text(name)
    return FM.money_text(name)


def format_table(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Numeric columns named in ``headers`` become texts under their display header; the rest passes through."""
    numeric = {n for n, t in df.dtypes if t in ("double", "float", "int", "bigint") or t.startswith("decimal")}
    return df.select(*[
        (formatter(c) if c in numeric else F.col(c)).alias(headers[c]) if c in headers else F.col(c) for c in df.columns
    ])
