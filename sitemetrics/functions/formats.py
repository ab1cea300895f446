"""Display formats: lakh/crore digit grouping, money, counts, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholder texts and the currency mark.
EM_DASH = "—"
HYPHEN = "-"
RUPEE = "₹"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def group_digits(n) -> Column:
    """Integer text with the last three digits as one group and pairs before: 4935256 -> 49,35,256."""
    return F.regexp_replace(_c(n).cast("string"), r"(?<=\d)(?=(\d\d)*\d{3}$)", ",")


def _whole(x) -> Column:
    """Nearest integer, ties to even."""
    return F.bround(_c(x).cast("double"), 0).cast("decimal(38,0)")


def fixed_decimals(x, digits: int) -> Column:
    """Plain text with a fixed number of decimals, rounded on the exact binary value, ties to even."""
    return F.translate(F.format_number(_c(x).cast("double"), digits), ",", "")


def pax_text(x) -> Column:
    v = _c(x).cast("double")
    return F.when(_finite(v), group_digits(_whole(v))).otherwise(EM_DASH)


def money_text(x, mark: str = RUPEE) -> Column:
    v = _c(x).cast("double")
    return F.when(_finite(v), F.concat(F.lit(mark), group_digits(_whole(v)))).otherwise(EM_DASH)


def pct_text(x, signed: bool = True) -> Column:
    """Fraction as a percentage with two decimals: 0.087 -> +8.70%."""
    v = _c(x).cast("double") * 100.0
    body = F.concat(fixed_decimals(v, 2), F.lit("%"))
    shown = F.concat(F.when(v >= 0, "+").otherwise(""), body) if signed else body
    return F.when(_finite(v), shown).otherwise(EM_DASH)


def spend_text(x) -> Column:
    """Two decimals, dropped for whole numbers."""
    v = _c(x).cast("double")
    return F.when(_finite(v), F.regexp_replace(fixed_decimals(v, 2), r"\.00$", "")).otherwise(HYPHEN)


def pct_from_text(s) -> Column:
    """Number back from a formatted percentage; placeholders give NULL."""
    t = F.trim(_c(s).cast("string"))
    return F.when(
        ~t.isin("", EM_DASH, HYPHEN, "nan", "None"), F.regexp_replace(t, "[%+]", "").try_cast("double")
    )
