"""Attach site-wide figures to outlets: visitor pools by membership, targets by share or by days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import metrics as M
from sitemetrics.operators.aggregate import exact
from sitemetrics.plans.compare import GRAIN, MEASURES


def _sums(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.groupBy(*keys).agg(*[F.coalesce(F.sum(exact(facts, m)), F.lit(0)).cast("double").alias(m) for m in MEASURES])


def with_ratios(df: DataFrame) -> DataFrame:
    """Penetration and spend per visitor from revenue, pax, traffic columns."""
    return df.withColumns({
        "penetration_pct": M.penetration_pct("pax", "traffic"), "rev_per_visitor": M.rev_per_visitor("revenue", "traffic"),
    })


def traffic_by_location(facts: DataFrame, totals: DataFrame) -> DataFrame:
    """Revenue and customers per location with its visitor total; NULL where no traffic is known."""
    per_site = totals.groupBy("location").agg(
        F.sum(exact(totals, "traffic")).cast("double").alias("traffic"),
        F.bool_or("is_estimated").alias("traffic_is_estimated"),
        F.sum("missing_days").cast("int").alias("traffic_missing_days"),
    )
    return _sums(facts, ["location"]).join(per_site, "location", "left")


def pool_labels(totals: DataFrame, pool_member: DataFrame) -> DataFrame:
    """The stored label that stands for each member of a pool at each location: its own (level 0), its fallback (1) or the site's (2).

    ``pool_member``: pool, terminal and optionally ``location``, ``fallback`` (label to use where the terminal
    has no rows) and ``site_share`` (part of the whole-site "" label, used when nothing else is known).
    """
    have = set(pool_member.columns)
    col = lambda n, t: F.col(n) if n in have else F.lit(None).cast(t)
    site = ["location"] if "location" in have else []
    member = pool_member.select(*site, "pool", "terminal", col("fallback", "string").alias("fallback"),
                                col("site_share", "double").alias("site_share"))
    label = lambda name, level: F.struct(name.alias("label"), F.lit(level).alias("level"))
    labels = member.select(
        *site, "pool", F.col("terminal").alias("member"), "site_share",
        F.explode(F.array(label(F.col("terminal"), 0), label(F.col("fallback"), 1),
                          label(F.when(F.col("site_share").isNotNull(), F.lit("")), 2))).alias("x"),
    ).select(*site, "pool", "member", "site_share", "x.*").where("label is not null")
    known = totals.where("traffic is not null").withColumnRenamed("terminal", "label")
    hit = known.join(labels, [*site, "label"])
    pick = F.min_by(F.struct("label", "level", "traffic", "is_estimated", "missing_days", "site_share"), "level")
    return hit.groupBy("location", "pool", "member").agg(pick.alias("p")).select("location", "pool", "member", "p.*")


def label_sums(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Traffic of the chosen labels per key, each label once; the site's share counts only where no other label is known."""
    one = chosen.groupBy(*keys, "member").agg(F.min_by(F.struct("label", "level", "traffic", "site_share"), F.struct("level", "label")).alias("p")).select(*keys, "p.*")
    once = one.groupBy(*keys, "level", "label").agg(F.max("traffic").alias("traffic"), F.sum("site_share").alias("site_share"))
    return once.groupBy(*keys).agg(
        F.sum(F.when(F.col("level") < 2, exact(once, "traffic"))).cast("double").alias("__d"),
        F.sum(F.when(F.col("level") == 2, (F.col("traffic") * F.col("site_share")).cast("decimal(30,8)"))).cast("double").alias("__w"),
    ).select(*keys, F.coalesce("__d", "__w").alias("traffic"))


def pool_traffic(totals: DataFrame, pool_member: DataFrame) -> DataFrame:
    """Visitors per (location, pool) = sum over the pool's terminals, each stored label counted once; see :func:`pool_labels`."""
    once = pool_labels(totals, pool_member).groupBy("location", "pool", "level", "label").agg(
        F.max("traffic").alias("traffic"), F.bool_or("is_estimated").alias("is_estimated"),
        F.max("missing_days").alias("missing_days"), F.sum("site_share").alias("site_share"),
    )
    direct, whole = F.col("level") < 2, F.col("level") == 2
    amount = exact(once, "traffic")
    agg = once.groupBy("location", "pool").agg(
        F.sum(F.when(direct, amount)).cast("double").alias("d"),
        F.sum(F.when(whole, (F.col("traffic") * F.col("site_share")).cast("decimal(30,8)"))).cast("double").alias("w"),
        F.bool_or(F.when(direct, F.col("is_estimated"))).alias("de"),
        F.max(F.when(direct, F.col("missing_days"))).alias("dm"), F.max(F.when(whole, F.col("missing_days"))).alias("wm"),
    )
    return agg.select(
        "location", "pool", F.coalesce("d", "w").alias("traffic"),
        F.coalesce("de", F.lit(True)).alias("traffic_is_estimated"),
        F.coalesce("dm", "wm").alias("traffic_missing_days"),
    )


def traffic_by_outlet(facts: DataFrame, totals: DataFrame, outlet_pool: DataFrame, pool_member: DataFrame) -> DataFrame:
    """Outlet revenue with the visitors of the outlet's own pool; NULL for outlets without one."""
    per_pool = pool_traffic(totals, pool_member)
    on = [c for c in ("outlet", "location") if c in outlet_pool.columns]
    return _sums(facts, ["outlet", "location"]).join(outlet_pool, on, "left").join(per_pool, ["location", "pool"], "left").select(
        "outlet", "location", "pool", "revenue", "pax", "traffic",
        F.coalesce("traffic_is_estimated", F.lit(False)).alias("traffic_is_estimated"),
        F.coalesce("traffic_missing_days", F.lit(0)).alias("traffic_missing_days"),
    )


def target_by_month(facts: DataFrame, monthly: DataFrame) -> DataFrame:
    """One row per (location, outlet, year, month): revenue and the target share of the days present."""
    keys = ["location", "outlet", "year", "month"]
    actual = facts.groupBy("location", "outlet", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum(exact(facts, "revenue")).cast("double").alias("revenue"), F.count_distinct("date").alias("days_present")
    )
    per_key = monthly.groupBy(*keys).agg(F.sum(exact(monthly, "aop")).cast("double").alias("aop"))
    month_days = F.dayofmonth(F.last_day(F.make_date("year", "month", F.lit(1))))
    return actual.join(per_key, keys, "left").select(
        *keys, "revenue", "days_present", (F.col("aop") * F.col("days_present") / month_days).alias("aop_target")
    )


def target_by_share(
    facts: DataFrame, site_targets: DataFrame, target: str = "aop_target", keys: tuple[str, ...] = ("location", "outlet")
) -> DataFrame:
    """Split each location's target over its outlets by revenue, equally where location revenue is not positive.

    Location totals are aggregated and joined back, so a dominant location is not pulled into one task.
    """
    per_outlet = facts.groupBy(*keys).agg(F.coalesce(F.sum(exact(facts, "revenue")), F.lit(0)).alias("r"))
    site = per_outlet.groupBy("location").agg(F.sum("r").cast("double").alias("site_revenue"), F.count(F.lit(1)).alias("n"))
    share = F.when(F.col("site_revenue") > 0, F.col("r").cast("double") / F.col("site_revenue")).otherwise(1.0 / F.col("n"))
    return (
        per_outlet.join(site, "location").join(site_targets.select("location", F.col(target).alias("__t")), "location", "left")
        .select(*keys, F.col("r").cast("double").alias("revenue"), (F.col("__t") * share).alias("aop_target"))
    )


def target_for_outlets(facts: DataFrame, site_targets: DataFrame, monthly: DataFrame) -> DataFrame:
    """Share of the site target where the site has daily targets, else the outlet's prorated months.

    ``site_targets``: location, aop_target, has_daily.
    """
    by_share = target_by_share(facts, site_targets.where("has_daily"))
    by_month = target_by_month(facts, monthly).groupBy("location", "outlet").agg(
        F.sum(F.col("aop_target").cast("decimal(30,8)")).cast("double").alias("monthly_target")
    )
    return by_share.join(by_month, ["location", "outlet"], "left").select(
        "location", "outlet", "revenue", F.coalesce("aop_target", "monthly_target").alias("aop_target"),
        F.when(F.col("aop_target").isNotNull(), "daily_share").when(F.col("monthly_target").isNotNull(), "monthly").alias("source"),
    )


def target_variance(df: DataFrame, keys: list[str], revenue: str = "revenue", target: str = "aop") -> DataFrame:
    """Actual against target at any grain; a group without any target stays NULL."""
    agg = df.groupBy(*keys).agg(
        F.coalesce(F.sum(exact(df, revenue)), F.lit(0)).cast("double").alias("actual_revenue"),
        F.sum(exact(df, target)).cast("double").alias("aop_target"),
    )
    return agg.withColumns({
        "variance": F.col("actual_revenue") - F.col("aop_target"),
        "variance_pct": M.pct_change("actual_revenue", "aop_target"),
        "achievement_pct": M.safe_div("actual_revenue", "aop_target") * 100.0,
    })


def location_metrics(facts: DataFrame) -> DataFrame:
    """Location penetration and spend per visitor from rows carrying their day's site traffic.

    Traffic is taken once per (date, location) before it is summed.
    """
    rev = exact(facts, "revenue")
    per_day = facts.groupBy("date", "location").agg(
        F.sum(rev).alias("r"), F.sum(exact(facts, "pax")).alias("p"), F.max(exact(facts, "traffic")).alias("t")
    )
    return with_ratios(per_day.groupBy("location").agg(
        F.coalesce(F.sum("r"), F.lit(0)).cast("double").alias("revenue"),
        F.coalesce(F.sum("p"), F.lit(0)).cast("double").alias("pax"), F.sum("t").cast("double").alias("traffic"),
    ))


def outlet_metrics(facts: DataFrame) -> DataFrame:
    """Outlet revenue and customers next to the location's penetration and spend per visitor."""
    site = location_metrics(facts).select("location", "traffic", "penetration_pct", "rev_per_visitor")
    return _sums(facts, GRAIN).join(site, "location", "left")


def has_traffic(facts: DataFrame) -> DataFrame:
    return facts.agg(F.coalesce(F.bool_or(F.coalesce(F.col("traffic"), F.lit(0)) > 0), F.lit(False)).alias("has_traffic"))


METRICS = ["traffic", "revenue", "pax", "penetration_pct", "rev_per_visitor"]


def metric_variance(current: DataFrame, compare: DataFrame, keys: list[str] = ("location",)) -> DataFrame:
    """Full outer join of two metric tables with the change of each metric; absent sides stay NULL."""
    keys = list(keys)
    side = lambda df, s: df.select(*keys, *[F.col(m).alias(f"{m}_{s}") for m in METRICS])
    both = side(current, "current").join(side(compare, "compare"), keys, "full_outer")
    name = {"penetration_pct": "penetration"}
    return both.withColumns({
        f"{name.get(m, m)}_pct_change": M.pct_change(f"{m}_current", f"{m}_compare") for m in METRICS
    })


def comparison_with_metrics(comparison: DataFrame, current: DataFrame, compare: DataFrame, keys: list[str]) -> DataFrame:
    """Comparison rows enriched with visitors and ratios of both sides, using one joined metrics table.

    ``current`` / ``compare``: keys + traffic. Ratios use the row's own revenue and customers.
    """
    side = lambda df, s: df.select(*keys, F.col("traffic").alias(f"{s}_traffic"))
    traffic = side(current, "current").join(side(compare, "compare"), keys, "full_outer")
    out = comparison.join(traffic, keys, "left")
    out = out.withColumns({
        **{f"{s}_penetration_pct": M.penetration_pct(f"{s}_pax", f"{s}_traffic") for s in ("current", "compare")},
        **{f"{s}_rev_per_visitor": M.rev_per_visitor(f"{s}_revenue", f"{s}_traffic") for s in ("current", "compare")},
    })
    return out.withColumns({
        "traffic_change": F.col("current_traffic") - F.col("compare_traffic"),
        "penetration_change": F.col("current_penetration_pct") - F.col("compare_penetration_pct"),
        "rev_per_visitor_change": F.col("current_rev_per_visitor") - F.col("compare_rev_per_visitor"),
    })


def add_targets(comparison: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Target and variance columns at the comparison's grain."""
    per_key = targets.groupBy(*keys).agg(F.sum(exact(targets, "aop_target")).cast("double").alias("aop_target"))
    return comparison.join(per_key, keys, "left").withColumns({
        "target_variance": F.col("current_revenue") - F.col("aop_target"),
        "target_variance_pct": M.pct_change("current_revenue", "aop_target"),
    })


def first_segment(facts: DataFrame) -> DataFrame:
    """One segment per (outlet, location): the earliest seen, ties by name."""
    return facts.groupBy("outlet", "location").agg(F.min(F.struct("date", "segment")).alias("m")).select(
        "outlet", "location", F.col("m.segment").alias("segment")
    )


def target_tiers(facts: DataFrame, monthly: DataFrame, site_targets: DataFrame) -> DataFrame:
    """Overall target from the best source: per-row targets, outlet months, then site targets."""
    row_target = F.sum(exact(facts, "aop")) if "aop" in facts.columns else F.lit(None)
    actual = facts.agg(F.sum(exact(facts, "revenue")).cast("double").alias("actual_revenue"), row_target.cast("double").alias("t1"))
    t2 = target_by_month(facts, monthly).agg(F.sum(F.col("aop_target").cast("decimal(30,8)")).cast("double").alias("t2"))
    t3 = site_targets.agg(F.sum(F.col("aop_target").cast("decimal(30,8)")).cast("double").alias("t3"))
    none = F.lit(None).cast("double")
    stacked = (
        actual.withColumns({"t2": none, "t3": none})
        .unionByName(t2.withColumns({"actual_revenue": none, "t1": none, "t3": none}))
        .unionByName(t3.withColumns({"actual_revenue": none, "t1": none, "t2": none}))
    )
    one = stacked.agg(*[F.max(c).alias(c) for c in ("actual_revenue", "t1", "t2", "t3")])
    return one.select(
        "actual_revenue", F.coalesce("t1", "t2", "t3").alias("aop_target"),
        F.when(F.col("t1").isNotNull(), "row").when(F.col("t2").isNotNull(), "outlet_month")
        .when(F.col("t3").isNotNull(), "site").alias("source"),
    ).withColumn("achievement_pct", M.safe_div("actual_revenue", "aop_target") * 100.0)


def row_details(facts: DataFrame, monthly: DataFrame, totals: DataFrame) -> DataFrame:
    """Stored rows with their outlet-month target and site visitors; the month is part of the key."""
    site = totals.groupBy("location").agg(F.sum(exact(totals, "traffic")).cast("double").alias("site_traffic"))
    keyed = facts.withColumns({"year": F.year("date"), "month": F.month("date")})
    per_key = monthly.groupBy("location", "outlet", "year", "month").agg(F.sum(exact(monthly, "aop")).cast("double").alias("month_target"))
    return keyed.join(per_key, ["location", "outlet", "year", "month"], "left").join(site, "location", "left")
