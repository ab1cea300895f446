"""Text to date, month labels and calendar arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitemetrics.functions.core import column as _c
from sitemetrics.functions.core import let

# Month abbreviations, serial-day range and epoch, plausible years.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
SERIAL_RANGE = (36526.0, 55153.0)
SERIAL_EPOCH = "1899-12-30"
YEARS = (2000, 2050)

YMD = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
XXY = r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4}|\d{2})$"
D_MON_Y = r"^(\d{1,2})(?:st|nd|rd|th)?[\s.\-/]*([A-Za-z]{3,9})[\s.\-,/']+(\d{4}|\d{2})$"
MON_D_Y = r"^([A-Za-z]{3,9})[\s.\-]+(\d{1,2})(?:st|nd|rd|th)?[\s.\-,]+(\d{4})$"
# The date shapes looked for inside free text.
IN_TEXT = (
    r"\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}"
    r"|\d{4}[./\-]\d{1,2}[./\-]\d{1,2}"
    r"|\d{1,2}(?:st|nd|rd|th)?[\s.\-]+[A-Za-z]{3,9}[\s.\-,]+\d{2,4}"
    r"|[A-Za-z]{3,9}[\s.\-]+\d{1,2}(?:st|nd|rd|th)?[\s.\-,]+\d{4}"
)


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """DATE from three texts, NULL unless it exists in the calendar."""
    century = F.when(F.length(y) == 2, "20").otherwise("")
    return F.concat_ws("-", F.concat(century, y), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def month_number(name) -> Column:
    """1..12 from a month name or abbreviation, else NULL."""
    start = F.lower(F.substring(_c(name), 1, 3))
    return let(
        F.when(F.length(start) == 3, F.instr(F.lit(MONTHS), start)), lambda at: F.when(at % 3 == 1, ((at + 2) / 3).cast("int"))
    )


def text_date(x, years: tuple[int, int] = YEARS) -> Column:
    """ISO first, then day-first, then month-first, then month names; serial day numbers too."""
    part = F.regexp_extract

    def named(s: Column, p: str, mon: int, d: int, y: int) -> Column:
        return _ymd(part(s, p, y), month_number(part(s, p, mon)).cast("string"), part(s, p, d))

    def parse(s: Column) -> Column:
        numeric = F.coalesce(
            _ymd(part(s, XXY, 3), part(s, XXY, 2), part(s, XXY, 1)), _ymd(part(s, XXY, 3), part(s, XXY, 1), part(s, XXY, 2))
        )
        return (
            F.when(s.rlike(r"^\d+(\.\d+)?$"), let(s.try_cast("double"), lambda n: F.when(
                n.between(*SERIAL_RANGE), F.date_add(F.lit(SERIAL_EPOCH).cast("date"), n.cast("int")))))
            .when(s.rlike(YMD), _ymd(part(s, YMD, 1), part(s, YMD, 2), part(s, YMD, 3)))
            .when(s.rlike(XXY), numeric)
            .when(s.rlike(D_MON_Y), named(s, D_MON_Y, 2, 1, 3))
            .when(s.rlike(MON_D_Y), named(s, MON_D_Y, 1, 2, 3))
        )

    text = F.trim(_c(x).cast("string"))
    short = let(text, lambda t: F.when(F.length(t).between(5, 40), F.regexp_replace(t, r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$", "")))
    return let(let(short, parse), lambda d: F.when(F.year(d).between(*years), d))


def target_date(x) -> Column:
    """Target-sheet dates: d-m-Y, d/m/Y or ISO; no year limits."""
    return text_date(x, years=(1, 9999))


def any_date(x) -> Column:
    """Stored dates pass through, text is parsed."""
    return F.coalesce(_c(x).try_cast("date"), text_date(_c(x).cast("string"), years=(1, 9999)))


def date_in_text(x, years: tuple[int, int] = YEARS) -> Column:
    """First readable date inside a title or file name."""
    hits = F.regexp_extract_all(_c(x), F.lit(f"({IN_TEXT})"), F.lit(1))
    dates = F.filter(F.transform(hits, lambda h: text_date(h, years)), lambda d: d.isNotNull())
    return F.try_element_at(dates, F.lit(1))


def month_label(x) -> Column:
    """First day of the month named by "Apr'24" / "May-26" / "May 2026"; fiscal-year labels give NULL."""
    shape = r"^([A-Za-z]{3,9}) (\d{4}|\d{2})$"
    return let(F.trim(F.regexp_replace(_c(x).cast("string"), r"[-'’\s]+", " ")), lambda s: F.when(
        s.rlike(shape) & ~s.rlike(r"(?i)^fy"),
        _ymd(F.regexp_extract(s, shape, 2), month_number(F.regexp_extract(s, shape, 1)).cast("string"), F.lit("01")),
    ))


def month_in_name(x) -> Column:
    """Month label at the end of a sheet or file name, e.g. 'North Traffic June-26'."""
    tail = F.regexp_extract(F.trim(_c(x)), r"([A-Za-z]{3,9}[-'’\s_]+\d{2,4})$", 1)
    return month_label(F.regexp_replace(tail, "_", " "))


def is_day_number(x) -> Column:
    v = _c(x).try_cast("double")
    return F.coalesce((v == F.floor(v)) & v.between(1, 31), F.lit(False))


def fix_swapped_day(d, ref_month) -> Column:
    """Swap day and month back when only the swapped date falls into the reference month."""
    day, ref = _c(d), F.trunc(_c(ref_month), "MM")
    swapped = F.concat_ws(
        "-", F.year(day), F.lpad(F.dayofmonth(day), 2, "0"), F.lpad(F.month(day), 2, "0")
    ).try_cast("date")
    may_swap = (F.trunc(day, "MM") != ref) & (F.dayofmonth(day) <= 12)
    return let(swapped, lambda s: F.when(may_swap & (F.trunc(s, "MM") == ref), s).otherwise(day))


def month_shift(d, n: int) -> Column:
    """Same day n months away, clamped to the end of a shorter month."""
    return F.add_months(_c(d), n)


def week_start(d) -> Column:
    """Monday of the ISO week."""
    return F.date_trunc("week", _c(d)).cast("date")


def week_end(d) -> Column:
    return F.date_add(week_start(d), 6)


def month_start(d) -> Column:
    return F.trunc(_c(d), "MM")


def month_end(d) -> Column:
    return F.last_day(_c(d))


def year_start(d) -> Column:
    return F.trunc(_c(d), "YEAR")


def year_end(d) -> Column:
    return F.date_sub(F.add_months(year_start(d), 12), 1)


def span_label(lo, hi) -> Column:
    """'04 Jul 2026', '01–07 Jul 2026', '28 Jun – 04 Jul 2026' or the cross-year form."""
    a, b = _c(lo), _c(hi)
    fmt = F.date_format
    return (
        F.when(a == b, fmt(a, "dd MMM yyyy"))
        .when(F.trunc(a, "MM") == F.trunc(b, "MM"), F.concat(fmt(a, "dd"), F.lit("–"), fmt(b, "dd MMM yyyy")))
        .when(F.year(a) == F.year(b), F.concat(fmt(a, "dd MMM"), F.lit(" – "), fmt(b, "dd MMM yyyy")))
        .otherwise(F.concat(fmt(a, "dd MMM yyyy"), F.lit(" – "), fmt(b, "dd MMM yyyy")))
    )
