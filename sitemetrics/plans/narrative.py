"""Rule-based management text as a table (section_no, section, line_no, text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions.dates import span_label
from sitemetrics.functions.formats import fixed_decimals, money_text, pax_text, pct_text
from sitemetrics.functions.labels import site_label
from sitemetrics.operators.reuse import materialise
from sitemetrics.plans import compare as C
from sitemetrics.plans.allocate import target_variance
from sitemetrics.plans.periods import PeriodPair
from sitemetrics.plans.reports import with_class_total

# Section titles.
SECTIONS = {
    1: "Executive Summary", 2: "Selected Comparison", 3: "Day-over-Day (DoD)", 4: "Month-over-Month (MoM)",
    5: "Year-over-Year (YoY)", 6: "Top & Bottom Performers", 7: "Revenue Driver Analysis", 8: "Footfall Insight",
    9: "Segment Summary", 10: "AOP Achievement",
}
REFERENCE = {"yesterday": 3, "last_month": 4, "last_year": 5}


def _line(df: DataFrame, section: Column | int, line: Column | int, *parts) -> DataFrame:
    text = F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    no = F.lit(section) if isinstance(section, int) else section
    title = F.lit(None).cast("string")
    for k, v in SECTIONS.items():
        title = F.when(no == k, v).otherwise(title)
    order = F.lit(line) if isinstance(line, int) else line
    return df.select(no.alias("section_no"), title.alias("section"), order.alias("line_no"), text.alias("text")).where("text is not null")


def _size(pct: str) -> Column:
    return pct_text(F.abs(F.coalesce(F.col(pct), F.lit(0.0))), signed=False)


def _direction(pct: str) -> Column:
    return F.when(F.coalesce(F.col(pct), F.lit(0.0)) >= 0, "up").otherwise("down")


def comparison_lines(named: DataFrame) -> DataFrame:
    """Executive, commentary and footfall lines from named comparisons with spans; ``selected`` leads."""
    n = named.withColumns({"cur": span_label("current_lo", "current_hi"), "cmp": span_label("compare_lo", "compare_hi")})
    both = n.where("current_lo is not null and compare_lo is not null")
    sel = both.where("comparison = 'selected'")
    first = _line(
        n.where("comparison = 'selected' and current_lo is not null"), 1, 1,
        "Total revenue for ", F.col("cur"), " was ", money_text("current_revenue"), " from ", pax_text("current_pax"),
        " PAX (Revenue/PAX: ", money_text("current_rev_per_pax"), ").",
    )
    second = _line(
        sel, 1, 2, "That's ", _direction("revenue_pct_change"), " ", _size("revenue_pct_change"), " versus ", F.col("cmp"),
        " (", money_text("compare_revenue"), "), a change of ", money_text("revenue_change"), ". ", F.col("revenue_trend"),
    )
    number = F.when(F.col("comparison") == "selected", 2)
    for name, k in REFERENCE.items():
        number = number.when(F.col("comparison") == name, k)
    comments = _line(
        both, number, 1, "Revenue for ", F.col("cur"), " is ", _direction("revenue_pct_change"), " ", _size("revenue_pct_change"),
        " vs ", F.col("cmp"), " (", money_text("compare_revenue"), " → ", money_text("current_revenue"), "). PAX changed by ",
        pct_text("pax_pct_change"), ".",
    )
    pax, rev = F.col("pax_pct_change"), F.col("revenue_pct_change")
    foot = sel.where("pax_pct_change is not null")
    f1 = _line(
        foot, 8, 1, "PAX ", F.when(pax >= 0, "increased").otherwise("decreased"), " by ", _size("pax_pct_change"), " vs ", F.col("cmp"),
        " (", pax_text("compare_pax"), " → ", pax_text("current_pax"), ").",
    )
    # Sentence texts.
    f2 = _line(foot, 8, 2, F.when(
        (pax < 0) & (rev > 0), "Revenue grew despite a footfall decline — driven by higher spend per visitor (Revenue/PAX increased).",
    ).when(
        (pax > 0) & (rev < 0), "Revenue fell despite higher footfall — spend per visitor (Revenue/PAX) declined enough to offset the volume gain.",
    ))
    return reduce(DataFrame.unionByName, [first, second, comments, f1, f2])


def ranking_lines(outlets: DataFrame, n: int) -> DataFrame:
    """Top and bottom outlets from an outlet-grain comparison."""
    live = outlets.where("current_revenue > 0")
    out = []
    for offset, order in ((0, F.desc("current_revenue")), (100, F.asc("current_revenue"))):
        picked = live.orderBy(order, *C.GRAIN).limit(n)
        rank = picked.select(
            "*", F.row_number().over(_small_order(order)).alias("__r")
        )
        pct = F.when(F.col("revenue_pct_change").isNotNull(), F.concat(F.lit(" ("), pct_text("revenue_pct_change"), F.lit(")"))).otherwise("")
        name = "Top" if offset == 0 else "Bottom"
        out.append(_line(rank, 6, F.col("__r") + offset, name, " ", F.col("__r").cast("string"), ": ", site_label("outlet", "location"), ": ",
                         money_text("current_revenue"), pct))
    return out[0].unionByName(out[1])


def _small_order(first: Column):
    """Window over at most n already limited rows."""
    from pyspark.sql import Window

    return Window.orderBy(first, *C.GRAIN)


def driver_lines(drivers: DataFrame) -> DataFrame:
    """Class counts and the two largest movers by volume and by spend."""
    counts = drivers.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("driver") == d).alias(k) for k, d in (("v", "Volume-driven"), ("s", "Spend-driven"), ("m", "Mixed"), ("f", "Flat"))],
    ).where("n > 0")
    part = lambda c, t: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {t}")))
    first = _line(
        counts, 7, 1, "Across ", F.col("n").cast("string"), " outlet/location combinations: ",
        F.concat_ws(", ", part("v", "volume-driven"), part("s", "spend-driven"), part("m", "mixed"), part("f", "flat")), ".",
    )
    movers = C.top_movers(drivers, 2).where("driver in ('Volume-driven', 'Spend-driven')")
    named = movers.groupBy("driver").agg(F.array_sort(F.collect_list(F.struct("rank", site_label("outlet", "location").alias("t")))).alias("a"))
    which = F.when(F.col("driver") == "Volume-driven", 2).otherwise(3)
    second = _line(named, 7, which, "Notable ", F.lower("driver"), " movers: ", F.array_join(F.transform("a", lambda x: x["t"]), ", "), ".")
    return first.unionByName(second)


def segment_lines(seg: DataFrame) -> DataFrame:
    """Segment totals, largest first, and the extremes; ``seg`` is a segment-grain comparison."""
    live = seg.where("current_revenue <> 0 or current_pax <> 0")
    ranked = live.withColumn("__r", F.row_number().over(_segment_order()))
    rows = _line(ranked, 9, F.col("__r"), F.col("segment"), ": ", money_text("current_revenue"), " (", pax_text("current_pax"), " PAX)")
    ext = C.extremes_of(seg)
    last = _line(
        ext, 9, 1000, "Fastest growing segment: ", F.col("top_growing"), " (", pct_text("top_growing_pct"), "). Fastest declining: ",
        F.col("top_declining"), " (", pct_text("top_declining_pct"), ").",
    )
    return rows.unionByName(last)


def _segment_order():
    """Window over one row per segment, a handful of rows."""
    from pyspark.sql import Window

    return Window.orderBy(F.desc("current_revenue"), "segment")


def target_lines(actuals: DataFrame) -> DataFrame:
    """Achievement against target; ``actuals``: revenue, aop."""
    v = target_variance(actuals, [])
    v = v.where("aop_target is not null and aop_target <> 0")
    status = F.when(F.col("variance") >= 0, "✅ on/above target").otherwise("⚠️ below target")
    a = _line(
        v, 10, 1, "Actual revenue of ", money_text("actual_revenue"), " against an AOP target of ", money_text("aop_target"), " — ",
        fixed_decimals("achievement_pct", 1), "% achievement, ", status, ".",
    )
    b = _line(v, 10, 2, "Variance: ", money_text("variance"), " (", pct_text("variance_pct"), ").")
    return a.unionByName(b)


def management_summary(
    facts: DataFrame, selected: PeriodPair, reference: dict[str, PeriodPair] | None = None, n: int = 3, actuals: DataFrame | None = None
) -> DataFrame:
    """All sections. Reference comparisons are left out when every one of their days belongs to the selected
    compare range, sections without data produce no rows.
    """
    pairs = {"selected": selected, **(reference or {})}
    # One scan of the facts; every section works on this outlet-grain table.
    base = materialise(C.pair_sums(facts, pairs, C.GRAIN, spans=True))
    named = C.named_from_sums(base, list(pairs), spans=True)
    lo, hi = F.lit(selected.compare_start), F.lit(selected.compare_end)
    inside = F.col("compare_lo").between(lo, hi) & F.col("compare_hi").between(lo, hi)
    shown = named.where((F.col("comparison") == "selected") | ~F.coalesce(inside, F.lit(False)))
    outlets = C.comparison_from_sums(base, 0, C.GRAIN)
    parts = [
        comparison_lines(shown), ranking_lines(outlets, n), driver_lines(C.classify_drivers(outlets)),
        segment_lines(C.comparison_from_sums(base, 0, ["segment"])),
    ]
    if actuals is not None:
        parts.append(target_lines(actuals))
    return reduce(DataFrame.unionByName, parts)


def class_insight(breakdown: DataFrame, current_label: str, compare_label: str, skip: tuple[str, ...] = ("Ancillary",)) -> DataFrame:
    """One sentence per class: direction, main driver and contribution to revenue."""
    b = with_class_total(breakdown).where(~F.col("category").isin(list(skip)))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rev, pax, rpp = z("revenue_pct_change"), z("pax_pct_change"), z("rev_per_pax_pct_change")
    # Sentence texts.
    driver = F.when(
        F.abs(pax) >= F.abs(rpp), F.when(pax >= 0, "higher passenger volume").otherwise("lower passenger volume")
    ).otherwise(F.when(rpp >= 0, "improved spend per passenger (SPP)").otherwise("lower spend per passenger (SPP)"))
    share = F.coalesce(F.when(F.col("__total") > 0, F.col("current_revenue") / F.col("__total") * 100.0), F.lit(0.0))
    one = lambda x: F.concat(fixed_decimals(x, 1), F.lit("%"))
    return b.select("category", F.concat(
        F.col("category"), F.lit(" revenue "), F.when(rev >= 0, "increased").otherwise("decreased"), F.lit(" by "), one(F.abs(rev) * 100.0),
        F.lit(f" vs {compare_label}, driven by "), driver, F.lit(". It contributed "), one(share), F.lit(f" of total revenue in {current_label}."),
    ).alias("text"))


def stronger_class(breakdown: DataFrame, first: str, second: str, current_label: str) -> DataFrame:
    """Closing sentence naming the class with more revenue (``first`` on a tie)."""
    best = breakdown.where(F.col("category").isin(first, second)).agg(
        F.max(F.when(F.col("category") == first, F.col("current_revenue"))).alias("a"),
        F.max(F.when(F.col("category") == second, F.col("current_revenue"))).alias("b"),
    ).where("a is not null and b is not null")
    name = F.when(F.col("b") > F.col("a"), second).otherwise(first)
    return best.select(F.concat(F.lit("Overall, "), name, F.lit(f" is the stronger-performing category in {current_label}.")).alias("text"))
