"""Report assembly: categories, classes, pools, hierarchical groups, tree and summary feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemetrics.functions import metrics as M
from sitemetrics.operators import dims
from sitemetrics.operators.aggregate import exact
from sitemetrics.operators.select import within_any
from sitemetrics.plans import allocate as A
from sitemetrics.plans import compare as C
from sitemetrics.plans.periods import PeriodPair

SIDES = ("current", "compare")
SUMS = [f"{s}_{m}" for s in SIDES for m in C.MEASURES]


def share_of_parent(df: DataFrame, parent: list[str], value: str) -> DataFrame:
    """value / sum(value) within the parent; totals are aggregated and joined back."""
    sums = df.groupBy(*parent).agg(F.sum(exact(df, value)).cast("double").alias("__total"))
    joined = df.join(sums, parent)
    return joined.withColumn("share", F.try_divide(F.col(value).cast("double"), F.col("__total"))).drop("__total")


def tag_categories(df: DataFrame, categories: dict[str, str | None], out: str = "category") -> DataFrame:
    """One copy of a row per category whose SQL rule it meets (no rule = every row). Use after aggregating."""
    tags = F.array_compact(F.array(*[
        F.lit(name) if rule is None else F.when(F.expr(rule), F.lit(name)) for name, rule in categories.items()
    ]))
    return df.withColumn(out, F.explode(tags))


def category_panel(
    facts: DataFrame, pair: PeriodPair, categories: dict[str, str | None], site_targets: DataFrame
) -> DataFrame:
    """Per category: both periods, changes and target. Targets are split over outlets before filtering."""
    fine = C.side_sums(facts, pair, C.GRAIN)
    current = facts.where(pair.side("current"))
    target = A.target_by_share(current, site_targets, keys=tuple(C.GRAIN)).select(
        *C.GRAIN, F.col("aop_target").cast("decimal(28,4)").alias("aop_target")
    )
    tagged = tag_categories(fine.join(target, C.GRAIN, "left"), categories)
    per = tagged.groupBy("category").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.sum("aop_target").cast("double").alias("aop_target")
    )
    return C.add_changes(per).withColumns({
        "target_variance": F.col("current_revenue") - F.col("aop_target"),
        "target_variance_pct": M.pct_change("current_revenue", "aop_target"),
    })


def category_locations(facts: DataFrame, categories: dict[str, str | None]) -> DataFrame:
    """Revenue and customers by location within each category."""
    fine = facts.groupBy(*C.GRAIN).agg(*[F.sum(exact(facts, m)).alias(m) for m in C.MEASURES])
    return tag_categories(fine, categories).groupBy("category", "location").agg(
        *[F.sum(m).cast("double").alias(m) for m in C.MEASURES]
    ).orderBy("category", "revenue", "location")


def category_outlets(facts: DataFrame, categories: dict[str, str | None], outlet_traffic: DataFrame) -> DataFrame:
    """Outlet penetration and spend per visitor in each category, over the outlet's own pool."""
    fine = facts.groupBy(*C.GRAIN).agg(*[F.sum(exact(facts, m)).cast("double").alias(m) for m in C.MEASURES])
    t = outlet_traffic.select("outlet", "location", "traffic")
    return A.with_ratios(tag_categories(fine, categories).join(t, ["outlet", "location"], "left"))


def class_breakdown(facts: DataFrame, pair: PeriodPair, outlet_class: Column, site_traffic: dict[str, DataFrame]) -> DataFrame:
    """Domestic / International style split. Each location's visitors are the shared denominator of every class there.

    ``site_traffic``: side -> (location, traffic).
    """
    fine = C.side_sums(facts, pair, ["location", "outlet"])
    seen = facts.where(within_any(facts, pair.ranges())).groupBy("location", "outlet").agg(
        *[F.bool_or(pair.side(s)).alias(f"has_{s}") for s in SIDES]
    )
    tagged = fine.join(seen, ["location", "outlet"]).withColumn("category", outlet_class)
    per_site = tagged.groupBy("location", "category").agg(
        *[F.sum(c).alias(c) for c in SUMS], *[F.bool_or(f"has_{s}").alias(f"has_{s}") for s in SIDES]
    )
    for s in SIDES:
        t = site_traffic[s].groupBy("location").agg(F.sum(exact(site_traffic[s], "traffic")).alias(f"__{s}"))
        per_site = per_site.join(t, "location", "left")
    used = lambda s: F.when(F.col(f"has_{s}") & (F.col(f"__{s}") > 0), F.col(f"__{s}"))
    per = per_site.groupBy("category").agg(
        *[F.sum(c).alias(c) for c in SUMS], *[F.sum(used(s)).cast("double").alias(f"{s}_traffic") for s in SIDES]
    )
    out = C.add_changes(per).drop("revenue_trend", "pax_trend")
    out = out.withColumns({
        **{f"{s}_penetration_pct": M.penetration_pct(f"{s}_pax", f"{s}_traffic") for s in SIDES},
        **{f"{s}_rev_per_visitor": M.rev_per_visitor(f"{s}_revenue", f"{s}_traffic") for s in SIDES},
        **{f"{s}_rev_per_pax": M.rev_per_pax(f"{s}_revenue", f"{s}_pax") for s in SIDES},
    })
    return out.withColumns({
        "traffic_pct_change": M.pct_change("current_traffic", "compare_traffic"),
        "penetration_pct_change": M.pct_change("current_penetration_pct", "compare_penetration_pct"),
        "rev_per_pax_change": F.col("current_rev_per_pax") - F.col("compare_rev_per_pax"),
        "rev_per_pax_pct_change": M.pct_change("current_rev_per_pax", "compare_rev_per_pax"),
    })


def with_class_total(breakdown: DataFrame) -> DataFrame:
    """Adds the revenue of all classes. The window runs over one already aggregated row per class."""
    total = F.sum(exact(breakdown, "current_revenue")).over(Window.partitionBy()).cast("double")
    return breakdown.withColumn("__total", total)


def class_shares(breakdown: DataFrame) -> DataFrame:
    """Class revenue as percent of all classes."""
    return with_class_total(breakdown).select("category", "current_revenue", (M.safe_div("current_revenue", "__total") * 100.0).alias("share_pct"))


def pool_breakdown(facts: DataFrame, totals: DataFrame, outlet_pool: DataFrame, pool_member: DataFrame, single_terminal_sites: list[str] = ()) -> DataFrame:
    """Revenue, customers and visitors per (location, pool); site-wide and unmapped outlets stay visible."""
    per_outlet = facts.groupBy("location", "outlet").agg(*[F.sum(exact(facts, m)).alias(m) for m in C.MEASURES])
    labelled = dims.add_pool(per_outlet, outlet_pool, single_terminal_sites)
    sums = labelled.groupBy("location", F.col("pool_label").alias("pool")).agg(*[F.sum(m).cast("double").alias(m) for m in C.MEASURES])
    t = A.pool_traffic(totals, pool_member).select("location", "pool", "traffic")
    return A.with_ratios(sums.join(t, ["location", "pool"], "left"))


def terminal_traffic(totals: DataFrame) -> DataFrame:
    """Visitors per (location, terminal); rows without a terminal are the main terminal."""
    label = F.when(F.col("terminal") == "", dims.MAIN_TERMINAL).otherwise(F.col("terminal"))
    return totals.groupBy("location", label.alias("terminal")).agg(F.sum(exact(totals, "traffic")).cast("double").alias("traffic"))


def type_mix(current: DataFrame, compare: DataFrame, terminal_type: DataFrame) -> DataFrame:
    """Visitors by type per location on both sides (absent = 0), the change and the current share.

    ``terminal_type``: terminal, type.
    """
    tagged = current.select("location", "terminal", exact(current, "traffic").alias("c"), F.lit(0).alias("p")).unionByName(
        compare.select("location", "terminal", F.lit(0).alias("c"), exact(compare, "traffic").alias("p"))
    )
    per = tagged.join(terminal_type, "terminal").groupBy("location", "type").agg(
        F.sum("c").cast("double").alias("current_traffic"), F.sum("p").cast("double").alias("compare_traffic")
    )
    shares = share_of_parent(per, ["location"], "current_traffic")
    return shares.withColumn("traffic_pct_change", M.pct_change("current_traffic", "compare_traffic"))


def report_nodes(leaves: DataFrame, group_member: DataFrame, subtotal_member: DataFrame) -> DataFrame:
    """(outlet, location, level, label, ord) for the outlet itself, its group, its subtotals and the grand total.

    ``group_member``: outlet, optionally location, group, ord. ``subtotal_member``: group, subtotal, ord.
    Outlets without a group go to "Other", after everything else.
    """
    last = 1_000_000
    keys = ["outlet", "location"]
    on = [c for c in keys if c in group_member.columns]
    grouped = leaves.select(*keys).distinct().join(group_member.select(*on, "group", "ord"), on, "left").select(
        *keys, F.coalesce("group", F.lit(dims.OTHER_GROUP)).alias("group"), F.coalesce("ord", F.lit(last)).alias("ord")
    )
    own = grouped.select(*keys, F.lit("outlet").alias("level"), F.col("outlet").alias("label"), "ord")
    group = grouped.select(*keys, F.lit("group").alias("level"), F.col("group").alias("label"), "ord")
    subtotal = grouped.drop("ord").join(subtotal_member, "group").select(
        *keys, F.lit("subtotal").alias("level"), F.col("subtotal").alias("label"), "ord"
    ).distinct()
    total = grouped.select(*keys, F.lit("total").alias("level"), F.lit("Total").alias("label"), F.lit(last + 1).alias("ord"))
    return own.unionByName(group).unionByName(subtotal).unionByName(total)


def group_report(
    facts: DataFrame, pair: PeriodPair, totals: dict[str, DataFrame], outlet_pool: DataFrame, pool_member: DataFrame,
    group_member: DataFrame, subtotal_member: DataFrame, targets: DataFrame,
) -> DataFrame:
    """Management report: outlet, group, subtotal and total rows per location.

    A node's visitors are those of the distinct labels that stand for the terminals of its outlets' pools at its
    location (fallbacks and site shares as in :func:`allocate.pool_labels`), so pools that overlap are not counted twice. The total adds leaves only. ``targets``: location, outlet, aop_target.
    """
    keys = ["location", "outlet"]
    leaves = C.any_nonzero(C.side_sums(facts, pair, keys), ["current_revenue", "compare_revenue"])
    per_target = targets.groupBy(*keys).agg(F.sum(exact(targets, "aop_target")).alias("aop_target"))
    nodes = report_nodes(leaves, group_member, subtotal_member)
    member = leaves.join(per_target, keys, "left").join(nodes, keys)
    node = ["location", "level", "label"]
    sums = member.groupBy(*node).agg(
        F.min("ord").alias("ord"), *[F.sum(c).alias(c) for c in SUMS], F.sum("aop_target").cast("double").alias("aop_target")
    )
    pools = member.select(*node, "outlet").join(outlet_pool.where("pool is not null"), [c for c in keys if c in outlet_pool.columns]).select("location", F.col("level").alias("__level"), F.col("label").alias("__node"), "pool").distinct()
    out = C.add_changes(sums).drop("revenue_trend", "pax_trend", "revenue_change", "pax_change")
    for s in SIDES:
        chosen = pools.join(A.pool_labels(totals[s], pool_member), ["location", "pool"])
        per = A.label_sums(chosen, ["location", "__level", "__node"]).toDF(*node, f"{s}_traffic")
        out = out.join(per, node, "left")
    out = out.withColumns({
        **{f"{s}_penetration_pct": M.penetration_pct(f"{s}_pax", f"{s}_traffic") for s in SIDES},
        **{f"{s}_rev_per_visitor": M.rev_per_visitor(f"{s}_revenue", f"{s}_traffic") for s in SIDES},
    })
    return out.withColumns({
        "traffic_pct_change": M.pct_change("current_traffic", "compare_traffic"),
        "penetration_pct_change": M.pct_change("current_penetration_pct", "compare_penetration_pct"),
        "rev_per_visitor_pct_change": M.pct_change("current_rev_per_visitor", "compare_rev_per_visitor"),
        "target_pct_change": M.pct_change("current_revenue", "aop_target"),
    })


def in_report_order(report: DataFrame) -> DataFrame:
    """Dimension order; a subtotal follows the rows it shares a position with."""
    depth = F.when(F.col("level") == "outlet", 0).when(F.col("level") == "group", 1).when(F.col("level") == "subtotal", 2).otherwise(3)
    return report.orderBy("location", "ord", depth, "label")


def segment_tree(facts: DataFrame, pair: PeriodPair) -> DataFrame:
    """Location and location x segment comparison with a direction class, for a tree view."""
    sets = C.compare_grain_sets(facts, pair).where("grain in ('location', 'location_segment')")
    return sets.select(
        "grain", "location", "segment", *SUMS, "revenue_pct_change", "pax_pct_change",
        M.trend_class("revenue_pct_change").alias("direction"),
    )


def executive_summary(facts: DataFrame, pair: PeriodPair) -> DataFrame:
    """Headline figures with the fastest growing and declining segment as (metric, value, text) rows."""
    kpi = C.named_comparison(facts, {"selected": pair})
    ext = C.segment_extremes(facts, pair)
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    row = lambda name, value, text: F.struct(F.lit(name).alias("metric"), value.alias("value"), text.alias("text"))
    a = kpi.select(F.explode(F.array(
        row("revenue", F.col("current_revenue"), F.col("revenue_trend")),
        row("revenue_pct_change", F.col("revenue_pct_change"), none_s),
        row("pax", F.col("current_pax"), F.col("pax_trend")),
        row("pax_pct_change", F.col("pax_pct_change"), none_s),
        row("rev_per_pax", F.col("current_rev_per_pax"), none_s),
    )).alias("r")).select("r.*")
    b = ext.select(F.explode(F.array(
        row("top_growing", F.col("top_growing_pct"), F.col("top_growing")),
        row("top_declining", F.col("top_declining_pct"), F.col("top_declining")),
    )).alias("r")).select("r.*")
    return a.unionByName(b)
