"""Label cleaning and vocabulary matching as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitemetrics.functions.core import column as _c
from sitemetrics.functions.core import let

# Markers of summary rows.
TOTAL_MARKERS = [
    "total", "grand total", "sub total", "subtotal", "overall", "sum",
    "net total", "gross total", "all locations", "all outlets", "combined",
]


def norm_label(x) -> Column:
    """Lower-case label with separators as single blanks and odd punctuation dropped."""
    s = F.regexp_replace(F.coalesce(_c(x).cast("string"), F.lit("")), r"[\n_\-]", " ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_&%().' ]+", " ")
    s = F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.trim(F.regexp_replace(s, r"\.+$", ""))


def is_blank(x) -> Column:
    return F.coalesce(F.lower(F.trim(_c(x).cast("string"))), F.lit("")).isin("", "nan", "none")


def clean_cell(x) -> Column:
    """Trimmed text without zero-width and no-break characters; blank becomes NULL."""
    s = F.regexp_replace(_c(x).cast("string"), "[\u200b\u200c\u200d\ufeff]", "")
    return let(F.trim(F.regexp_replace(s, "[\\s\u00a0]+", " ")), lambda t: F.when(~is_blank(t), t))


def title_case(x, acronyms: list[str] = ()) -> Column:
    """Capital after every non-letter, other letters lower; listed acronyms stay upper-case."""
    s = F.trim(_c(x))
    runs = F.regexp_extract_all(s, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    titled = F.array_join(F.transform(runs, lambda p: F.initcap(p)), "")
    return F.when(F.lower(s).isin([a.lower() for a in acronyms]), F.upper(s)).otherwise(titled) if acronyms else titled


def lookup(x, table: dict[str, str]) -> Column:
    """Value of a small fixed mapping, NULL for other keys."""
    if not table:
        return F.lit(None).cast("string")
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), _c(x))


def vocabulary_match(x, vocab: dict[str, str], min_len: int = 3) -> Column:
    """Canonical name by exact vocabulary hit, else by the first entry (of ``min_len``+) contained."""
    return let(norm_label(x), lambda t: label_match(t, vocab, min_len))


def label_match(label: Column, vocab: dict[str, str], min_len: int = 3) -> Column:
    """:func:`vocabulary_match` of a text that is normalised already."""
    out = F.lit(None).cast("string")
    for word, name in reversed(list(vocab.items())):
        if len(word) >= min_len:
            out = F.when(label.contains(word), F.lit(name)).otherwise(out)
    return F.when(label != "", F.coalesce(lookup(label, vocab), out))


def keyword_class(x, keywords: list[tuple[str, str]], default: str | None = None) -> Column:
    """Class of the first keyword contained in the label."""
    def match(t: Column) -> Column:
        out = F.lit(default).cast("string")
        for word, name in reversed(keywords):
            out = F.when(t.contains(word), F.lit(name)).otherwise(out)
        return out

    return let(norm_label(x), match)


def is_total_label(x) -> Column:
    """Equals, starts with or ends with a summary marker."""
    marks = "|".join(TOTAL_MARKERS)
    return norm_label(x).rlike(f"^({marks})$|^({marks}) | ({marks})$")


def site_label(outlet, location) -> Column:
    return F.concat(_c(outlet), F.lit(" ("), _c(location), F.lit(")"))
