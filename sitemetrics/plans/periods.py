"""Period algebra: a comparison kind, an anchor day and a mode become two closed date ranges."""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import dates as D
from sitemetrics.operators.ordered import as_of_dates

KINDS = ["Day-wise", "Week-wise", "Month-wise", "Year-wise"]
MODES = ["Full Period", "To-Date"]


@dataclass(frozen=True)
class PeriodPair:
    """Two closed date ranges with labels."""

    current_start: dt.date
    current_end: dt.date
    compare_start: dt.date
    compare_end: dt.date
    current_label: str = ""
    compare_label: str = ""

    def side(self, which: str, day: str = "date") -> Column:
        lo, hi = sorted((getattr(self, f"{which}_start"), getattr(self, f"{which}_end")))
        return F.col(day).between(F.lit(lo), F.lit(hi))

    def either(self, day: str = "date") -> Column:
        return self.side("current", day) | self.side("compare", day)

    def ranges(self) -> list[tuple[dt.date, dt.date]]:
        return [(self.current_start, self.current_end), (self.compare_start, self.compare_end)]


def safe_month_shift(day: dt.date, months: int) -> dt.date:
    """Same day of another month, clamped to its length."""
    y, m0 = divmod(day.year * 12 + day.month - 1 + months, 12)
    return dt.date(y, m0 + 1, min(day.day, calendar.monthrange(y, m0 + 1)[1]))


def month_bounds(year: int, month: int) -> tuple[dt.date, dt.date]:
    return dt.date(year, month, 1), dt.date(year, month, calendar.monthrange(year, month)[1])


def year_bounds(year: int) -> tuple[dt.date, dt.date]:
    return dt.date(year, 1, 1), dt.date(year, 12, 31)


def week_range(day: dt.date) -> tuple[dt.date, dt.date]:
    monday = day - dt.timedelta(day.weekday())
    return monday, monday + dt.timedelta(6)


def previous_week_range(day: dt.date) -> tuple[dt.date, dt.date]:
    return week_range(day - dt.timedelta(7))


def _unit(kind: str, day: dt.date) -> tuple[dt.date, dt.date]:
    """The calendar unit of ``kind`` that holds ``day``."""
    if kind == "Day-wise":
        return day, day
    if kind == "Week-wise":
        return week_range(day)
    if kind == "Month-wise":
        return month_bounds(day.year, day.month)
    if kind == "Year-wise":
        return year_bounds(day.year)
    raise ValueError(f"unknown comparison kind {kind!r}")


def _long_label(kind: str, mode: str, lo: dt.date, hi: dt.date) -> str:
    # Label formats.
    if kind == "Day-wise":
        return f"{lo:%d %b %Y}"
    if mode == "To-Date":
        return {
            "Week-wise": f"Week of {lo:%d %b} (Mon–{hi:%a %d})",
            "Month-wise": f"{lo:%b %Y} (1–{hi.day})",
            "Year-wise": f"{lo.year} (Jan 1–{hi:%b %d})",
        }[kind]
    return {
        "Week-wise": f"Week of {lo:%d %b %Y} (full week)",
        "Month-wise": f"{lo:%b %Y} (full month)",
        "Year-wise": f"{lo.year} (full year)",
    }[kind]


def resolve_ranges(
    kind: str,
    anchor: dt.date,
    *,
    compare_to: dt.date | None = None,
    mode: str = "Full Period",
    available: list[dt.date] | None = None,
    align: str = "offset",
) -> PeriodPair:
    """Ranges for one anchor. ``compare_to`` is any day of the wanted compare unit; the default is the
    unit just before. Day-wise falls back to the nearest earlier available day. ``align="calendar"``
    ends a year-to-date compare range on the same month and day instead of the same day count.
    """
    lo, hi = _unit(kind, anchor)
    other = compare_to
    if other is None:
        other = lo - dt.timedelta(1)
        if kind == "Day-wise" and available and other not in available:
            other = max((d for d in available if d < anchor), default=other)
    c_lo, c_hi = _unit(kind, other)
    if mode == "To-Date" and kind != "Day-wise":
        hi = min(anchor, hi)
        same_length = min(c_lo + (hi - lo), c_hi)
        months_apart = (c_lo.year - lo.year) * 12 + c_lo.month - lo.month
        c_hi = safe_month_shift(hi, months_apart) if align == "calendar" and kind == "Year-wise" else same_length
    return PeriodPair(lo, hi, c_lo, c_hi, _long_label(kind, mode, lo, hi), _long_label(kind, mode, c_lo, c_hi))


def short_label(lo: dt.date, hi: dt.date, kind: str | None = None) -> str:
    """Table-header label; the kind is guessed from the span when not given."""
    if kind is None:
        span = (hi - lo).days
        kind = KINDS[0] if span == 0 else KINDS[1] if span <= 6 else KINDS[2] if span <= 31 else KINDS[3]
    # Label formats.
    texts = {
        "Week-wise": f"Week of {week_range(lo)[0]:%d %b %Y}",
        "Month-wise": f"{lo:%b %Y}",
        "Year-wise": f"{lo.year}",
    }
    single = f"{lo:%d %b %Y}"
    return texts.get(kind, single if lo == hi else f"{single} – {hi:%d %b %Y}")


def _unit_columns(kind: str, d: Column) -> tuple[Column, Column]:
    return {
        "Day-wise": (d, d),
        "Week-wise": (D.week_start(d), D.week_end(d)),
        "Month-wise": (D.month_start(d), D.month_end(d)),
        "Year-wise": (D.year_start(d), D.year_end(d)),
    }[kind]


def _label_column(kind: str, mode: str, lo: Column, hi: Column) -> Column:
    f = F.date_format
    if kind == "Day-wise":
        return f(lo, "dd MMM yyyy")
    if mode == "To-Date":
        return {
            "Week-wise": F.concat(F.lit("Week of "), f(lo, "dd MMM"), F.lit(" (Mon–"), f(hi, "EEE dd"), F.lit(")")),
            "Month-wise": F.concat(f(lo, "MMM yyyy"), F.lit(" (1–"), F.dayofmonth(hi).cast("string"), F.lit(")")),
            "Year-wise": F.concat(f(lo, "yyyy"), F.lit(" (Jan 1–"), f(hi, "MMM dd"), F.lit(")")),
        }[kind]
    return {
        "Week-wise": F.concat(F.lit("Week of "), f(lo, "dd MMM yyyy"), F.lit(" (full week)")),
        "Month-wise": F.concat(f(lo, "MMM yyyy"), F.lit(" (full month)")),
        "Year-wise": F.concat(f(lo, "yyyy"), F.lit(" (full year)")),
    }[kind]


def resolve_all(
    anchors: DataFrame, kind: str, mode: str = "Full Period", available: DataFrame | None = None
) -> DataFrame:
    """Ranges and labels for a whole table of ``anchor`` dates; Day-wise uses ``available`` for its fallback."""
    a = F.col("anchor")
    work = anchors
    if kind == "Day-wise" and available is not None:
        day_before = anchors.select("anchor").distinct().withColumn("__before", F.date_sub("anchor", 1))
        near = as_of_dates(day_before, available, "__before", "__near").select("anchor", "__near")
        work = anchors.join(near, "anchor", "left")
        other = F.coalesce("__near", F.date_sub(a, 1))
    else:
        other = F.date_sub(_unit_columns(kind, a)[0], 1)
    lo, hi = _unit_columns(kind, a)
    c_lo, c_hi = _unit_columns(kind, other)
    if mode == "To-Date" and kind != "Day-wise":
        c_hi = F.least(F.date_add(c_lo, F.datediff(a, lo)), c_hi)
        hi = a
    ranged = work.select(
        *anchors.columns, lo.alias("current_start"), hi.alias("current_end"), c_lo.alias("compare_start"), c_hi.alias("compare_end")
    )
    return ranged.withColumns({
        f"{s}_label": _label_column(kind, mode, F.col(f"{s}_start"), F.col(f"{s}_end")) for s in ("current", "compare")
    })


def short_label_column(lo: Column, hi: Column, kind: Column) -> Column:
    """Column form of :func:`short_label` for a known kind."""
    f = F.date_format
    single = f(lo, "dd MMM yyyy")
    return (
        F.when(kind == "Week-wise", F.concat(F.lit("Week of "), f(D.week_start(lo), "dd MMM yyyy")))
        .when(kind == "Month-wise", f(lo, "MMM yyyy"))
        .when(kind == "Year-wise", f(lo, "yyyy"))
        .when(lo == hi, single)
        .otherwise(F.concat(single, F.lit(" – "), f(hi, "dd MMM yyyy")))
    )


def kind_of_span(lo: Column, hi: Column) -> Column:
    span = F.datediff(hi, lo)
    return F.when(span == 0, KINDS[0]).when(span <= 6, KINDS[1]).when(span <= 31, KINDS[2]).otherwise(KINDS[3])


def comparison_dates(anchors: DataFrame, available: DataFrame) -> DataFrame:
    """Best available day for: the day before, one month before, one year before each anchor."""
    wanted = anchors.select("anchor").distinct().select(
        "anchor",
        F.explode(F.create_map(
            F.lit("yesterday"), F.date_sub("anchor", 1),
            F.lit("last_month"), F.add_months("anchor", -1),
            F.lit("last_year"), F.add_months("anchor", -12),
        )).alias("name", "wanted"),
    )
    found = as_of_dates(wanted, available, "wanted", "found")
    return found.groupBy("anchor").agg(
        *[F.max(F.when(F.col("name") == n, F.col("found"))).alias(n) for n in ("yesterday", "last_month", "last_year")]
    )


def shifted(pair: PeriodPair, days: int) -> PeriodPair:
    """Both ranges widened by ``days`` at either end."""
    step = dt.timedelta(days)
    return replace(
        pair,
        current_start=pair.current_start - step, current_end=pair.current_end + step,
        compare_start=pair.compare_start - step, compare_end=pair.compare_end + step,
    )
