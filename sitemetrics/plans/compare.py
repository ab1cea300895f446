"""Two-period and multi-period comparison. Both sides come out of one scan and one shuffle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import metrics as M
from sitemetrics.operators.aggregate import exact
from sitemetrics.operators.ordered import top_per_group
from sitemetrics.operators.select import within_any
from sitemetrics.plans.periods import PeriodPair, month_bounds, previous_week_range, safe_month_shift, week_range, year_bounds

GRAIN = ["segment", "outlet", "location"]
MEASURES = ["revenue", "pax"]


def side_sums(facts: DataFrame, pair: PeriodPair, keys: list[str], measures: list[str] = MEASURES) -> DataFrame:
    """``current_x`` / ``compare_x`` per key, exact, zero where a side has no rows."""
    picked = facts.where(within_any(facts, pair.ranges()))
    sums = [
        F.coalesce(F.sum(F.when(pair.side(s), exact(facts, m))), F.lit(0)).alias(f"{s}_{m}")
        for s in ("current", "compare")
        for m in measures
    ]
    return picked.groupBy(*keys).agg(*sums)


def add_changes(sums: DataFrame, measures: list[str] = MEASURES) -> DataFrame:
    """Change, fractional change and trend label next to each pair of sums."""
    num = sums.withColumns({f"{s}_{m}": F.col(f"{s}_{m}").cast("double") for s in ("current", "compare") for m in measures})
    out = num
    for m in measures:
        name = "PAX" if m == "pax" else m.title()
        cur, cmp_ = F.col(f"current_{m}"), F.col(f"compare_{m}")
        out = out.withColumns({f"{m}_change": cur - cmp_, f"{m}_pct_change": M.pct_change(cur, cmp_)})
        out = out.withColumn(f"{m}_trend", M.trend_label(f"{m}_pct_change", name))
    return out


def compare_periods(facts: DataFrame, pair: PeriodPair, keys: list[str] = GRAIN) -> DataFrame:
    return add_changes(side_sums(facts, pair, keys))


def by_current_revenue(comparison: DataFrame, keys: list[str] = GRAIN) -> DataFrame:
    """Presentation order: current revenue, largest first, keys as tie-breakers."""
    return comparison.orderBy(F.desc("current_revenue"), *keys)


def compare_grain_sets(facts: DataFrame, pair: PeriodPair) -> DataFrame:
    """Outlet, segment, location and location x segment comparisons from one aggregate.

    The fact table is reduced to outlet grain first; the grouping sets only expand that result.
    """
    fine = side_sums(facts, pair, GRAIN)
    cols = [f"{s}_{m}" for s in ("current", "compare") for m in MEASURES]
    seg, out, loc = F.col("segment"), F.col("outlet"), F.col("location")
    sets = fine.groupingSets([[seg, out, loc], [seg], [loc], [loc, seg]], seg, out, loc).agg(
        F.grouping_id(seg, out, loc).alias("__g"), *[F.sum(c).alias(c) for c in cols]
    )
    grain = (
        F.when(F.col("__g") == 0, "outlet").when(F.col("__g") == 3, "segment")
        .when(F.col("__g") == 6, "location").otherwise("location_segment")
    )
    return add_changes(sets.withColumn("grain", grain).drop("__g"))


def active_only(comparison: DataFrame) -> DataFrame:
    """Rows with non-zero revenue on either side."""
    return comparison.where("coalesce(current_revenue, 0) <> 0 or coalesce(compare_revenue, 0) <> 0")


def any_nonzero(df: DataFrame, cols: list[str]) -> DataFrame:
    keep = F.lit(False)
    for c in cols:
        keep = keep | (F.coalesce(F.col(c), F.lit(0)) != 0)
    return df.where(keep)


def pair_sums(facts: DataFrame, pairs: dict[str, PeriodPair], keys: list[str], spans: bool = False) -> DataFrame:
    """Sums and row counts per key for both sides of every pair, from one scan: ``{measure}_{side}_{pair number}``.

    ``spans`` adds the first and last day that each side really has.
    """
    aggs: list[Column] = []
    touched = within_any(facts, [r for p in pairs.values() for r in p.ranges()])
    for i, p in enumerate(pairs.values()):
        for s in ("current", "compare"):
            aggs.append(F.count_if(p.side(s)).alias(f"n_{s}_{i}"))
            if spans:
                day = F.when(p.side(s), F.col("date"))
                aggs += [F.min(day).alias(f"lo_{s}_{i}"), F.max(day).alias(f"hi_{s}_{i}")]
            for m in _measures(facts):
                aggs.append(F.sum(F.when(p.side(s), exact(facts, m))).alias(f"{m}_{s}_{i}"))
    return facts.where(touched).groupBy(*keys).agg(*aggs)


def _measures(facts: DataFrame) -> list[str]:
    return [*MEASURES, *(["aop"] if "aop" in facts.columns else [])]


def named_comparison(facts: DataFrame, pairs: dict[str, PeriodPair], spans: bool = False) -> DataFrame:
    """One row of scalar totals per named pair (day, week, month, year over year) in a single aggregate."""
    return named_from_sums(pair_sums(facts, pairs, [], spans), list(pairs), _measures(facts), spans)


def named_from_sums(sums: DataFrame, names: list[str], measures: list[str] = MEASURES, spans: bool = False) -> DataFrame:
    """Named comparisons from :func:`pair_sums` at any grain.

    A side without rows gives NULL changes rather than a change from zero.
    """
    sides = ("current", "compare")
    fold = {"lo": F.min, "hi": F.max}
    cols = [f"{x}_{s}_{i}" for i in range(len(names)) for s in sides for x in ("n", *(("lo", "hi") if spans else ()), *measures)]
    one = sums.agg(*[fold.get(c.split("_")[0], F.sum)(c).alias(c) for c in cols])
    amount = lambda m, s, i: F.col(f"{m}_{s}_{i}") if m == "aop" else F.coalesce(F.col(f"{m}_{s}_{i}"), F.lit(0))
    row = lambda i, n: F.struct(
        F.lit(n).alias("comparison"),
        *[F.col(f"n_{s}_{i}").alias(f"n_{s}") for s in sides],
        *[F.col(f"{e}_{s}_{i}").alias(f"{s}_{e}") for s in sides for e in ("lo", "hi") if spans],
        *[amount(m, s, i).cast("double").alias(f"{s}_{m}") for s in sides for m in measures],
    )
    long = one.select(F.explode(F.array(*[row(i, n) for i, n in enumerate(names)])).alias("r")).select("r.*")
    both = (F.col("n_current") > 0) & (F.col("n_compare") > 0)
    out = long
    for m, label in (("revenue", "Revenue"), ("pax", "PAX")):
        cur, cmp_ = F.col(f"current_{m}"), F.col(f"compare_{m}")
        out = out.withColumns({f"{m}_change": cur - cmp_, f"{m}_pct_change": F.when(both, M.pct_change(cur, cmp_))})
        out = out.withColumn(f"{m}_trend", M.trend_label(f"{m}_pct_change", label))
    return out.withColumns({
        f"{s}_rev_per_pax": M.rev_per_pax(f"{s}_revenue", f"{s}_pax") for s in sides
    }).drop("n_current", "n_compare")


def comparison_from_sums(sums: DataFrame, number: int, keys: list[str]) -> DataFrame:
    """The comparison of one pair from :func:`pair_sums`, rolled up to ``keys``."""
    n = F.col(f"n_current_{number}") + F.col(f"n_compare_{number}")
    rolled = sums.where(n > 0).groupBy(*keys).agg(*[
        F.coalesce(F.sum(f"{m}_{s}_{number}"), F.lit(0)).alias(f"{s}_{m}") for s in ("current", "compare") for m in MEASURES
    ])
    return add_changes(rolled)


def period_totals(facts: DataFrame) -> DataFrame:
    """Scalar totals of whatever rows come in; target stays NULL when no row has one."""
    aop = F.sum(exact(facts, "aop")) if "aop" in facts.columns else F.lit(None)
    return facts.agg(
        F.coalesce(F.sum(exact(facts, "revenue")), F.lit(0)).cast("double").alias("revenue"),
        F.coalesce(F.sum(exact(facts, "pax")), F.lit(0)).cast("double").alias("pax"),
        aop.cast("double").alias("aop"),
    ).withColumn("rev_per_pax", M.rev_per_pax("revenue", "pax"))


def rev_per_pax_table(facts: DataFrame, keys: list[str] = GRAIN) -> DataFrame:
    return (
        facts.groupBy(*keys)
        .agg(*[F.coalesce(F.sum(exact(facts, m)), F.lit(0)).cast("double").alias(m) for m in MEASURES])
        .withColumn("rev_per_pax", M.rev_per_pax("revenue", "pax"))
    )


def volume_vs_spend(facts: DataFrame, pair: PeriodPair) -> DataFrame:
    """Whether each outlet's revenue moved by customers or by spend per customer."""
    return classify_drivers(compare_periods(facts, pair))


def classify_drivers(comparison: DataFrame) -> DataFrame:
    c = comparison.withColumns({
        f"{s}_rpp": M.rev_per_pax(f"{s}_revenue", f"{s}_pax") for s in ("current", "compare")
    })
    return c.withColumn("rev_per_pax_pct_change", M.pct_change("current_rpp", "compare_rpp")).select(
        *GRAIN, "pax_pct_change", "revenue_pct_change", "rev_per_pax_pct_change",
        M.driver_class("pax_pct_change", "rev_per_pax_pct_change").alias("driver"),
    )


def defined_changes(drivers: DataFrame) -> DataFrame:
    """Drop rows whose revenue and customer changes are both undefined."""
    return drivers.where("revenue_pct_change is not null or pax_pct_change is not null")


def driver_counts(drivers: DataFrame) -> DataFrame:
    return drivers.groupBy("driver").agg(F.count(F.lit(1)).alias("outlets"))


def top_movers(drivers: DataFrame, n: int = 2) -> DataFrame:
    """Largest absolute revenue change within each driver class."""
    size = F.abs("revenue_pct_change")
    return top_per_group(drivers, ["driver"], n, size.desc_nulls_last(), *[F.asc(k) for k in GRAIN])


def ranked_outlets(facts: DataFrame, pair: PeriodPair, n: int = 10, worst: bool = False) -> DataFrame:
    """Top-n or bottom-n outlets by positive current revenue."""
    live = compare_periods(facts, pair).where("current_revenue > 0")
    first = F.asc("current_revenue") if worst else F.desc("current_revenue")
    return live.orderBy(first, *GRAIN).limit(n).select(*GRAIN, "current_revenue", "compare_revenue", "revenue_pct_change")


def segment_extremes(facts: DataFrame, pair: PeriodPair) -> DataFrame:
    """Fastest growing and fastest declining segment in one row."""
    return extremes_of(compare_periods(facts, pair, ["segment"]))


def extremes_of(segments: DataFrame) -> DataFrame:
    seg = segments.where("revenue_pct_change is not null")
    best = F.max(F.struct("revenue_pct_change", "segment"))
    worst = F.min(F.struct("revenue_pct_change", "segment"))
    return seg.agg(best.alias("b"), worst.alias("w")).select(
        F.col("b.segment").alias("top_growing"), F.col("b.revenue_pct_change").alias("top_growing_pct"),
        F.col("w.segment").alias("top_declining"), F.col("w.revenue_pct_change").alias("top_declining_pct"),
    )


def change_list(comparison: DataFrame, keys: list[str] = GRAIN) -> DataFrame:
    """Non-zero changes from the largest loss to the largest gain."""
    return comparison.where("revenue_change <> 0").orderBy("revenue_change", *keys)


def snapshot_ranges(anchor: dt.date) -> dict[str, tuple[dt.date, dt.date]]:
    """This and last week, month, year around an anchor day."""
    back = safe_month_shift(anchor, -1)
    return {
        "week": week_range(anchor), "last_week": previous_week_range(anchor),
        "month": month_bounds(anchor.year, anchor.month), "last_month": month_bounds(back.year, back.month),
        "year": year_bounds(anchor.year), "last_year": year_bounds(anchor.year - 1),
    }


def multi_period_snapshot(facts: DataFrame, ranges: dict[str, tuple[dt.date, dt.date]], keys: list[str] = GRAIN) -> DataFrame:
    """Revenue per key for every named range, with week, month and year changes, from one conditional aggregate."""
    inside = {n: F.col("date").between(F.lit(lo), F.lit(hi)) for n, (lo, hi) in ranges.items()}
    touched = within_any(facts, list(ranges.values()))
    rev = exact(facts, "revenue")
    sums = [F.coalesce(F.sum(F.when(c, rev)), F.lit(0)).cast("double").alias(f"{n}_revenue") for n, c in inside.items()]
    wide = facts.where(touched).groupBy(*keys).agg(*sums)
    return any_nonzero(wide, [f"{n}_revenue" for n in ranges]).withColumns({
        f"{u}_pct_change": M.pct_change(f"{u}_revenue", f"last_{u}_revenue")
        for u in ("week", "month", "year") if u in ranges and f"last_{u}" in ranges
    })
