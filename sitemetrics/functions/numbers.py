"""Text to number, written as JVM-side expressions that never raise under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitemetrics.functions.core import column as _c
from sitemetrics.functions.core import let

# Texts meaning "no value", currency marks and magnitude suffixes.
NO_VALUE = ["", "-", "–", "—", "na", "n/a", "nil", "none"]
CURRENCY = r"(?i)(₹|rs\.?|inr)\s*"
SUFFIXES = [
    (r"(?i)\bcr(ores?)?\b\.?$", 1e7),
    (r"(?i)\bl(akhs?|acs?)?\b\.?$", 1e5),
    (r"(?i)\bk\b$", 1e3),
    (r"(?i)\bmn?\b$", 1e6),
]
# Unit notes in titles and headers.
UNIT_NOTES = [
    (r"in\s+crores?|rs\.?\s*crores?|₹\s*crores?|\bcr\b", 1e7),
    (r"in\s+lakhs?|in\s+lacs?|rs\.?\s*lakhs?|rs\.?\s*lacs?|₹\s*lakhs?", 1e5),
    (r"in\s*'?000s?|in\s+thousands?|₹\s*'000|rs\.?\s*'000", 1e3),
    (r"in\s+millions?|\bmn\b", 1e6),
]
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


PUNCTUATION = "[, %\u00a0]"


def _strict(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(PLAIN_NUMBER), t.try_cast("double")))


def messy_number(x) -> Column:
    """'Rs. 5,000' / '(2,500)' / '1.2 L' / '3 Cr' / '12%' -> double, anything else NULL."""
    def parse(raw: Column) -> Column:
        bracketed = raw.rlike(r"(?s)^\(.*\)$")
        body = F.trim(F.regexp_replace(F.when(bracketed, F.btrim(raw, F.lit("()"))).otherwise(raw), CURRENCY, ""))
        number = let(body, scaled)
        return F.when(~F.lower(raw).isin(NO_VALUE), F.when(bracketed, -number).otherwise(number))

    def scaled(body: Column) -> Column:
        out = _strict(F.regexp_replace(body, PUNCTUATION, ""))
        for pattern, size in reversed(SUFFIXES):
            cut = _strict(F.regexp_replace(F.regexp_replace(body, pattern, ""), PUNCTUATION, ""))
            out = F.when(body.rlike(pattern), cut * size).otherwise(out)
        return out

    return let(F.trim(_c(x).cast("string")), parse)


def report_number(x) -> Column:
    """Number from a report cell broken by reflow blanks; otherwise its first numeric token."""
    return let(
        F.regexp_replace(_c(x).cast("string"), r"[\s,]+", ""),
        lambda t: F.when(~t.isin("", "-"), F.coalesce(_strict(t), _strict(F.regexp_extract(t, r"-?\d+(\.\d+)?", 0)))),
    )


def count_number(x) -> Column:
    """Traffic and target cells: drop commas and no-break spaces; blanks and dashes are NULL."""
    return let(F.trim(F.regexp_replace(_c(x).cast("string"), "[\u00a0,]", "")), lambda t: F.when(~t.isin("", "-", "—"), _strict(t)))


def float_or_null(x) -> Column:
    """Double or NULL; NaN counts as missing."""
    v = _c(x).try_cast("double")
    return F.when(~F.isnan(v), v)


def unit_multiplier(text) -> Column:
    """Scale announced by a title or header text, 1.0 when none is."""
    t = F.lower(_c(text))
    out = F.lit(1.0)
    for pattern, size in reversed(UNIT_NOTES):
        out = F.when(t.rlike(pattern), F.lit(size)).otherwise(out)
    return out
