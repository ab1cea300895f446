"""Reconciliation and allocation over the derived traffic and target tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sitemetrics.plans import allocate as A
from sitemetrics.plans import compare as C
from sitemetrics.plans import reconcile as R
from sitemetrics.workload import facts as X
from sitemetrics.workload.comparison import CMP, CUR, HALVES, sums_sql
from sitemetrics.workload.facts import div_sql, pct_sql, with_ctes
from sitemetrics.workload.registry import query

LO, HI = dt.date(1995, 1, 1), dt.date(2001, 8, 1)
ALL = (LO, HI)
CUR_R, CMP_R = (HALVES.current_start, HALVES.current_end), (HALVES.compare_start, HALVES.compare_end)


def _range(r) -> tuple[str, str]:
    return f"DATE '{r[0]}'", f"DATE '{r[1]}'"


_SPANS = " + ".join(
    f"CAST(COALESCE(SUM(CASE WHEN v IS NULL AND span = {k} THEN mt END), 0) AS DOUBLE) / {k}" for k in (28, 29, 30, 31)
)


def traffic_total_sql(r, p: str = "") -> dict[str, str]:
    """Day-by-day reconciliation, as named expressions ending in ``{p}tt``."""
    lo, hi = _range(r)
    return {
        f"{p}scan": f"SELECT * FROM traffic WHERE (granularity = 'daily' AND date BETWEEN {lo} AND {hi}) "
                    f"OR (granularity = 'monthly' AND date <= {hi} AND period_end >= {lo})",
        f"{p}cal": f"SELECT location, terminal, CAST(x AS DATE) AS day FROM (SELECT DISTINCT location, terminal FROM {p}scan), "
                   f"generate_series({lo}::TIMESTAMP, {hi}::TIMESTAMP, INTERVAL 1 DAY) g(x)",
        f"{p}dly": f"SELECT location, terminal, date AS day, SUM(traffic) AS v FROM {p}scan WHERE granularity = 'daily' GROUP BY 1, 2, 3",
        f"{p}fill": f"SELECT c.location, c.terminal, c.day, d.v, m.date AS ms, m.period_end AS me, m.traffic AS mt FROM {p}cal c "
                    f"LEFT JOIN {p}dly d USING (location, terminal, day) LEFT JOIN {p}scan m ON m.granularity = 'monthly' "
                    f"AND m.location = c.location AND m.terminal = c.terminal AND c.day BETWEEN m.date AND m.period_end",
        f"{p}sp": f"SELECT *, CAST(me - ms AS INT) + 1 AS span FROM {p}fill",
        f"{p}tt": f"SELECT location, terminal, CAST(COALESCE(SUM(v), 0) AS DOUBLE) + ({_SPANS}) AS traffic, "
                  f"BOOL_OR(v IS NULL AND ms IS NOT NULL) AS is_estimated, CAST(COUNT(CASE WHEN v IS NULL AND ms IS NULL THEN 1 END) AS INT) AS missing_days "
                  f"FROM {p}sp GROUP BY 1, 2",
    }


def target_total_sql(r, p: str = "") -> dict[str, str]:
    lo, hi = _range(r)
    n = "year * 12 + month"
    return {
        f"{p}dd": f"SELECT location, date AS day, aop FROM target_daily WHERE date BETWEEN {lo} AND {hi}",
        f"{p}mm": f"SELECT location, year, month, SUM(aop) AS aop, MAKE_DATE(CAST(year AS INT), CAST(month AS INT), 1) AS ms FROM target_monthly "
                  f"WHERE {n} BETWEEN YEAR({lo}) * 12 + MONTH({lo}) AND YEAR({hi}) * 12 + MONTH({hi}) GROUP BY 1, 2, 3",
        f"{p}cc": f"SELECT location, CAST(x AS DATE) AS day FROM (SELECT location FROM {p}dd UNION SELECT location FROM {p}mm), "
                  f"generate_series({lo}::TIMESTAMP, {hi}::TIMESTAMP, INTERVAL 1 DAY) g(x)",
        f"{p}ff": f"SELECT c.location, c.day, d.aop AS v, m.ms, m.aop AS mt FROM {p}cc c LEFT JOIN {p}dd d USING (location, day) "
                  f"LEFT JOIN {p}mm m ON m.location = c.location AND m.ms = CAST(DATE_TRUNC('month', c.day) AS DATE)",
        f"{p}ss": f"SELECT *, DAY(LAST_DAY(ms)) AS span FROM {p}ff",
        f"{p}agt": f"SELECT location, CAST(COALESCE(SUM(v), 0) AS DOUBLE) + ({_SPANS}) AS aop_target, "
                  f"BOOL_OR(v IS NULL AND ms IS NOT NULL) AS is_estimated, CAST(COUNT(CASE WHEN v IS NULL AND ms IS NULL THEN 1 END) AS INT) AS missing_days "
                  f"FROM {p}ss GROUP BY 1",
    }


TT, AT = traffic_total_sql(ALL), target_total_sql(ALL)


def total_traffic(spark, sf, r=ALL):
    return R.traffic_total(X.traffic(spark, sf), *r)


def total_targets(spark, sf, r=ALL):
    return R.target_total(X.target_daily(spark, sf), X.target_monthly(spark, sf), *r)


@query("s12_span_overlap_scan", with_ctes(["traffic"], """
SELECT date, period_end, granularity, location, terminal, CAST(traffic AS DOUBLE) AS traffic FROM traffic
WHERE (granularity = 'daily' AND date BETWEEN DATE '1996-02-10' AND DATE '2000-09-20')
   OR (granularity = 'monthly' AND date <= DATE '2000-09-20' AND period_end >= DATE '1996-02-10')"""))
def overlap_scan(spark, sf):
    return R.overlapping(X.traffic(spark, sf), dt.date(2000, 9, 20), dt.date(1996, 2, 10)).withColumn("traffic", F.col("traffic").cast("double"))


@query("s13_month_set_scan", with_ctes(["target_monthly"], """
SELECT location, outlet, CAST(year AS INT) AS year, CAST(month AS INT) AS month, CAST(aop AS DOUBLE) AS aop FROM target_monthly
WHERE MAKE_DATE(CAST(year AS INT), CAST(month AS INT), 1) BETWEEN DATE '1996-02-01' AND DATE '2001-09-20'"""))
def month_scan(spark, sf):
    return R.targets_touching(X.target_monthly(spark, sf), dt.date(1996, 2, 10), dt.date(2001, 9, 20)).withColumn("aop", F.col("aop").cast("double"))


@query("a10_traffic_reconciled", with_ctes(["traffic"], "SELECT * FROM tt", TT))
def traffic_reconciled(spark, sf):
    return total_traffic(spark, sf)


@query("j06_gap_fill_part_months", with_ctes(["traffic"], "SELECT * FROM tt", traffic_total_sql((dt.date(1996, 3, 14), dt.date(2000, 12, 7)))))
def traffic_part_months(spark, sf):
    return total_traffic(spark, sf, (dt.date(1996, 3, 14), dt.date(2000, 12, 7)))


@query("a11_target_reconciled", with_ctes(["target_daily", "target_monthly"], "SELECT * FROM agt", AT))
def target_reconciled(spark, sf):
    return total_targets(spark, sf)


@query("a12_flag_rollup", with_ctes(["traffic"], """
SELECT location, BOOL_OR(is_estimated) AS is_estimated, CAST(SUM(missing_days) AS BIGINT) AS missing_days,
       MAX(missing_days) AS worst_gap FROM tt GROUP BY location""", TT))
def flags(spark, sf):
    return total_traffic(spark, sf).groupBy("location").agg(
        F.bool_or("is_estimated").alias("is_estimated"), F.sum("missing_days").alias("missing_days"), F.max("missing_days").alias("worst_gap"))


@query("r03_missing_days", with_ctes(["traffic"], f"""
SELECT location, terminal, CAST(x AS DATE) AS date FROM (SELECT DISTINCT location, terminal FROM traffic WHERE granularity = 'daily'),
generate_series(DATE '{LO}'::TIMESTAMP, DATE '{HI}'::TIMESTAMP, INTERVAL 1 DAY) g(x)
EXCEPT SELECT location, terminal, date FROM traffic WHERE granularity = 'daily'"""))
def gaps(spark, sf):
    return R.missing_days(X.traffic(spark, sf).where("granularity = 'daily'"), ["location", "terminal"], LO, HI)


@query("v05_traffic_warnings", with_ctes(["rev", "traffic"], """
SELECT r.location, t.m IS NULL AS no_traffic, COALESCE(t.e, FALSE) AS is_estimated, CAST(COALESCE(t.m, 0) AS BIGINT) AS missing_days
FROM (SELECT DISTINCT location FROM rev) r LEFT JOIN
(SELECT location, BOOL_OR(is_estimated) AS e, SUM(missing_days) AS m FROM tt GROUP BY location) t USING (location)""",
    traffic_total_sql(CUR_R)))
def warnings(spark, sf):
    return R.coverage_gaps(X.rev(spark, sf), total_traffic(spark, sf, CUR_R))


BY_LOC = """
SELECT r.location, revenue, pax, t.traffic, t.e AS traffic_is_estimated, CAST(t.m AS INT) AS traffic_missing_days
FROM (SELECT location, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(pax) AS DOUBLE) AS pax FROM rev GROUP BY location) r
LEFT JOIN (SELECT location, CAST(SUM(CAST(traffic AS DECIMAL(30,8))) AS DOUBLE) AS traffic, BOOL_OR(is_estimated) AS e, SUM(missing_days) AS m
           FROM tt GROUP BY location) t USING (location)"""


@query("j04_traffic_by_location", with_ctes(["rev", "traffic"], BY_LOC, TT))
def by_location(spark, sf):
    return A.traffic_by_location(X.rev(spark, sf), total_traffic(spark, sf))


def pool_sql(p: str = "") -> dict[str, str]:
    return {
        f"{p}pt": f"SELECT location, pool, CAST(SUM(CAST(traffic AS DECIMAL(30,8))) AS DOUBLE) AS traffic, BOOL_OR(is_estimated) AS e, MAX(missing_days) AS m "
                  f"FROM {p}tt JOIN pool_member USING (terminal) GROUP BY 1, 2",
    }


BY_OUTLET = """
SELECT r.outlet, r.location, o.pool, r.revenue, r.pax, p.traffic, COALESCE(p.e, FALSE) AS traffic_is_estimated,
       CAST(COALESCE(p.m, 0) AS INT) AS traffic_missing_days
FROM (SELECT outlet, location, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(pax) AS DOUBLE) AS pax FROM rev GROUP BY 1, 2) r
LEFT JOIN outlet_pool o USING (outlet) LEFT JOIN pt p ON p.location = r.location AND p.pool = o.pool"""
POOLED = ["rev", "traffic", "outlet_pool", "pool_member"]


@query("j05_traffic_by_outlet_pool", with_ctes(POOLED, BY_OUTLET, {**TT, **pool_sql()}))
def by_outlet(spark, sf):
    return A.traffic_by_outlet(X.rev(spark, sf), total_traffic(spark, sf), X.outlet_pool(spark, sf), X.pool_member(spark))


MONTHLY = {"bm": """
SELECT a.location, a.outlet, a.year, a.month, revenue, days_present,
       CAST(t.aop AS DOUBLE) * days_present / DAY(LAST_DAY(MAKE_DATE(a.year, a.month, 1))) AS aop_target
FROM (SELECT location, outlet, CAST(YEAR(date) AS INT) AS year, CAST(MONTH(date) AS INT) AS month, CAST(SUM(revenue) AS DOUBLE) AS revenue,
      COUNT(DISTINCT date) AS days_present FROM rev GROUP BY 1, 2, 3, 4) a
LEFT JOIN target_monthly t ON t.location = a.location AND t.outlet = a.outlet AND t.year = a.year AND t.month = a.month"""}


@query("j07_target_monthly_prorated", with_ctes(["rev", "target_monthly"], "SELECT * FROM bm", MONTHLY))
def monthly_prorated(spark, sf):
    return A.target_by_month(X.rev(spark, sf), X.target_monthly(spark, sf))


@query("a13_days_present", with_ctes(["rev"], """
SELECT location, outlet, CAST(YEAR(date) AS INT) AS year, CAST(MONTH(date) AS INT) AS month, COUNT(DISTINCT date) AS days_present FROM rev GROUP BY 1, 2, 3, 4"""))
def days_present(spark, sf):
    return X.rev(spark, sf).groupBy("location", "outlet", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.count_distinct("date").alias("days_present"))


SHARE = {
    "o": "SELECT location, outlet, SUM(revenue) AS r FROM rev GROUP BY 1, 2",
    "l": "SELECT location, CAST(SUM(r) AS DOUBLE) AS lr, COUNT(*) AS n FROM o GROUP BY 1",
    "sa": "SELECT o.location, o.outlet, CAST(r AS DOUBLE) AS revenue, "
          "t.aop_target * CASE WHEN lr > 0 THEN CAST(r AS DOUBLE) / lr ELSE 1.0::DOUBLE / n END AS aop_target "
          "FROM o JOIN l USING (location) LEFT JOIN agt t USING (location)",
}


@query("j08_target_daily_share", with_ctes(["rev", "target_daily", "target_monthly"], "SELECT * FROM sa", {**AT, **SHARE}))
def daily_share(spark, sf):
    return A.target_by_share(X.rev(spark, sf), total_targets(spark, sf))


@query("w06_share_of_location", with_ctes(["rev"], """
SELECT location, outlet, CAST(r AS DOUBLE) / lr AS share FROM (SELECT location, outlet, SUM(revenue) AS r FROM rev GROUP BY 1, 2)
JOIN (SELECT location, CAST(SUM(revenue) AS DOUBLE) AS lr FROM rev GROUP BY 1) USING (location)"""))
def share_of_location(spark, sf):
    from sitemetrics.plans.reports import share_of_parent

    r = X.rev(spark, sf).groupBy("location", "outlet").agg(F.sum("revenue").alias("revenue"))
    return share_of_parent(r, ["location"], "revenue").select("location", "outlet", "share")


TIER_SITES = """SELECT a.*, COALESCE(d.has_daily, FALSE) AS has_daily FROM agt a
LEFT JOIN (SELECT DISTINCT location, TRUE AS has_daily FROM dd) d USING (location)"""


@query("t10_target_source_per_site", with_ctes(["rev", "target_daily", "target_monthly"], """
SELECT o.location, o.outlet, o.revenue, CASE WHEN st.has_daily THEN o.aop_target ELSE b.mt END AS aop_target,
       CASE WHEN st.has_daily THEN 'daily_share' WHEN b.mt IS NOT NULL THEN 'monthly' END AS source
FROM sa o LEFT JOIN st USING (location) LEFT JOIN
(SELECT location, outlet, CAST(SUM(CAST(aop_target AS DECIMAL(30,8))) AS DOUBLE) AS mt FROM bm GROUP BY 1, 2) b USING (location, outlet)""",
    {**AT, **SHARE, "st": TIER_SITES, **MONTHLY}))
def target_source(spark, sf):
    daily_sites = X.target_daily(spark, sf).select("location", F.lit(True).alias("has_daily")).distinct()
    sites = total_targets(spark, sf).join(daily_sites, "location", "left").withColumn("has_daily", F.coalesce("has_daily", F.lit(False)))
    return A.target_for_outlets(X.rev(spark, sf), sites, X.target_monthly(spark, sf))


VAR = """SELECT {k}, actual_revenue, aop_target, actual_revenue - aop_target AS variance, {p} AS variance_pct,
CASE WHEN aop_target = 0 THEN NULL ELSE actual_revenue / aop_target END * 100 AS achievement_pct FROM v"""


@query("q07_target_variance", with_ctes(["rev", "target_monthly"], VAR.format(
    k="location, month", p=pct_sql("actual_revenue", "aop_target")), {**MONTHLY, "v": """
SELECT location, month, CAST(SUM(CAST(revenue AS DECIMAL(30,8))) AS DOUBLE) AS actual_revenue,
       CAST(SUM(CAST(aop_target AS DECIMAL(30,8))) AS DOUBLE) AS aop_target FROM bm GROUP BY 1, 2"""}))
def variance(spark, sf):
    return A.target_variance(A.target_by_month(X.rev(spark, sf), X.target_monthly(spark, sf)), ["location", "month"], target="aop_target")


@query("a05_target_variance_overall", with_ctes(["rev", "target_monthly"], VAR.format(
    k="1 AS one", p=pct_sql("actual_revenue", "aop_target")).replace("1 AS one, ", ""), {**MONTHLY, "v": """
SELECT CAST(SUM(CAST(revenue AS DECIMAL(30,8))) AS DOUBLE) AS actual_revenue,
       CAST(SUM(CAST(aop_target AS DECIMAL(30,8))) AS DOUBLE) AS aop_target FROM bm"""}))
def variance_overall(spark, sf):
    return A.target_variance(A.target_by_month(X.rev(spark, sf), X.target_monthly(spark, sf)), [], target="aop_target")


@query("a04_null_preserving_sum", with_ctes(["rev", "target_daily"], """
SELECT r.location, CAST(SUM(t.aop) AS DOUBLE) AS aop FROM (SELECT DISTINCT location, date FROM rev) r
LEFT JOIN target_daily t USING (location, date) GROUP BY r.location"""))
def null_sum(spark, sf):
    days = X.rev(spark, sf).select("location", "date").distinct()
    return days.join(X.target_daily(spark, sf), ["location", "date"], "left").groupBy("location").agg(F.sum("aop").cast("double").alias("aop"))


@query("q08_target_tiers", with_ctes(["rev", "target_monthly"], """
SELECT actual_revenue, aop_target, 'outlet_month' AS source, actual_revenue / aop_target * 100 AS achievement_pct FROM
(SELECT (SELECT CAST(SUM(revenue) AS DOUBLE) FROM rev) AS actual_revenue,
        (SELECT CAST(SUM(CAST(aop_target AS DECIMAL(30,8))) AS DOUBLE) FROM bm) AS aop_target)""", MONTHLY))
def tiers(spark, sf):
    return A.target_tiers(X.rev(spark, sf), X.target_monthly(spark, sf), total_targets(spark, sf))


def day_traffic(spark, sf):
    """Facts with their day's whole-site visitors."""
    site = X.traffic_base(spark, sf).groupBy("date", "location").agg(F.sum("traffic").alias("traffic"))
    return X.rev(spark, sf).join(site, ["date", "location"], "left")


LOCM = """SELECT location, revenue, pax, traffic, CASE WHEN traffic = 0 THEN NULL ELSE pax / traffic END * 100 AS penetration_pct,
  CASE WHEN traffic = 0 THEN NULL ELSE revenue / traffic END AS rev_per_visitor FROM (
  SELECT location, CAST(SUM(r) AS DOUBLE) AS revenue, CAST(SUM(p) AS DOUBLE) AS pax, CAST(SUM(t) AS DOUBLE) AS traffic FROM (
    SELECT rev.date, rev.location, SUM(revenue) AS r, SUM(pax) AS p, MAX(s.traffic) AS t FROM rev LEFT JOIN
      (SELECT date, location, SUM(traffic) AS traffic FROM traffic_base GROUP BY 1, 2) s ON s.date = rev.date AND s.location = rev.location
    WHERE {w} GROUP BY 1, 2) GROUP BY location)"""
REV_TB = ["rev", "traffic_base"]


@query("a09_traffic_once_per_day", with_ctes(REV_TB, "SELECT location, traffic FROM lm", {"lm": LOCM.format(w="TRUE")}))
def once_per_day(spark, sf):
    return A.location_metrics(day_traffic(spark, sf)).select("location", "traffic")


@query("q05_penetration_location", with_ctes(REV_TB, "SELECT * FROM lm", {"lm": LOCM.format(w="TRUE")}))
def penetration_location(spark, sf):
    return A.location_metrics(day_traffic(spark, sf))


@query("j11_penetration_outlet", with_ctes(REV_TB, """
SELECT r.segment, r.outlet, r.location, CAST(SUM(r.revenue) AS DOUBLE) AS revenue, CAST(SUM(r.pax) AS DOUBLE) AS pax,
  MAX(lm.traffic) AS traffic, MAX(lm.penetration_pct) AS penetration_pct, MAX(lm.rev_per_visitor) AS rev_per_visitor
FROM rev r LEFT JOIN lm ON lm.location = r.location GROUP BY 1, 2, 3""", {"lm": LOCM.format(w="TRUE")}))
def penetration_outlet(spark, sf):
    return A.outlet_metrics(day_traffic(spark, sf))


_METRICS = ["traffic", "revenue", "pax", "penetration_pct", "rev_per_visitor"]
PVAR = "SELECT location, " + ", ".join(f"c.{m} AS {m}_current, p.{m} AS {m}_compare" for m in _METRICS) + ", " + ", ".join(
    f"{pct_sql(f'c.{m}', f'p.{m}')} AS {m.replace('penetration_pct', 'penetration')}_pct_change" for m in _METRICS
) + " FROM c FULL OUTER JOIN p USING (location)"
PVAR_CTES = {"c": LOCM.format(w=CUR.replace("date B", "rev.date B")), "p": LOCM.format(w=CMP.replace("date B", "rev.date B"))}


@query("q06_penetration_variance", with_ctes(REV_TB, PVAR, PVAR_CTES))
def penetration_variance(spark, sf):
    f = day_traffic(spark, sf)
    return A.metric_variance(A.location_metrics(f.where(HALVES.side("current"))), A.location_metrics(f.where(HALVES.side("compare"))))


@query("p08_has_traffic", with_ctes(REV_TB, "SELECT COALESCE(MAX(traffic), 0) > 0 AS has_traffic FROM traffic_base"))
def has_traffic(spark, sf):
    return A.has_traffic(day_traffic(spark, sf))


TT2 = {**traffic_total_sql(CUR_R, "c"), **pool_sql("c"), **traffic_total_sql(CMP_R, "p"), **pool_sql("p")}
ENRICH = f"""
SELECT s.outlet, s.location, s.current_revenue, s.compare_revenue, s.current_pax, s.compare_pax,
  c.traffic AS current_traffic, p.traffic AS compare_traffic,
  ({div_sql('s.current_pax', 'c.traffic')}) * 100 AS current_penetration_pct, ({div_sql('s.compare_pax', 'p.traffic')}) * 100 AS compare_penetration_pct,
  {div_sql('s.current_revenue', 'c.traffic')} AS current_rev_per_visitor, {div_sql('s.compare_revenue', 'p.traffic')} AS compare_rev_per_visitor,
  c.traffic - p.traffic AS traffic_change,
  ({div_sql('s.current_pax', 'c.traffic')}) * 100 - ({div_sql('s.compare_pax', 'p.traffic')}) * 100 AS penetration_change,
  ({div_sql('s.current_revenue', 'c.traffic')}) - ({div_sql('s.compare_revenue', 'p.traffic')}) AS rev_per_visitor_change
FROM s LEFT JOIN outlet_pool o USING (outlet) LEFT JOIN cpt c ON c.location = s.location AND c.pool = o.pool
LEFT JOIN ppt p ON p.location = s.location AND p.pool = o.pool"""


@query("j12_comparison_with_traffic", with_ctes(POOLED, ENRICH, {**TT2, "s": sums_sql("outlet, location")}))
def with_traffic(spark, sf):
    rev, tr = X.rev(spark, sf), X.traffic(spark, sf)
    op, pm = X.outlet_pool(spark, sf), X.pool_member(spark)
    keys = ["outlet", "location"]
    cmp_ = C.compare_periods(rev, HALVES, keys).select(*keys, *[f"{s}_{m}" for s in ("current", "compare") for m in ("revenue", "pax")])
    side = lambda s, r: A.traffic_by_outlet(rev.where(HALVES.side(s)), R.traffic_total(tr, *r), op, pm)
    return A.comparison_with_metrics(cmp_, side("current", CUR_R), side("compare", CMP_R), keys)


@query("j13_comparison_with_targets", with_ctes(["rev", "target_monthly"], f"""
SELECT s.outlet, s.location, s.current_revenue, t.aop_target, s.current_revenue - t.aop_target AS target_variance,
  {pct_sql('s.current_revenue', 't.aop_target')} AS target_variance_pct FROM s LEFT JOIN
(SELECT outlet, location, CAST(SUM(CAST(aop_target AS DECIMAL(30,8))) AS DOUBLE) AS aop_target FROM bm GROUP BY 1, 2) t USING (outlet, location)""",
    {"s": sums_sql("outlet, location"), **{k: v.replace("FROM rev GROUP", f"FROM rev WHERE {CUR} GROUP") for k, v in MONTHLY.items()}}))
def with_targets(spark, sf):
    rev = X.rev(spark, sf)
    keys = ["outlet", "location"]
    base = C.compare_periods(rev, HALVES, keys).select(*keys, "current_revenue")
    return A.add_targets(base, A.target_by_month(rev.where(HALVES.side("current")), X.target_monthly(spark, sf)), keys)


@query("j14_first_segment", with_ctes(["rev"], """
SELECT outlet, location, (LIST(segment ORDER BY date, segment))[1] AS segment FROM rev GROUP BY outlet, location"""))
def first_segment(spark, sf):
    return A.first_segment(X.rev(spark, sf))


@query("j19_row_details", with_ctes(["rev", "target_monthly", "traffic"], """
SELECT rev.date, rev.segment, rev.outlet, rev.location, CAST(revenue AS DOUBLE) AS revenue, CAST(t.aop AS DOUBLE) AS month_target, l.traffic AS site_traffic
FROM rev LEFT JOIN target_monthly t ON t.location = rev.location AND t.outlet = rev.outlet AND t.year = YEAR(rev.date) AND t.month = MONTH(rev.date)
LEFT JOIN (SELECT location, CAST(SUM(CAST(traffic AS DECIMAL(30,8))) AS DOUBLE) AS traffic FROM tt GROUP BY 1) l ON l.location = rev.location""", TT))
def row_details(spark, sf):
    d = A.row_details(X.rev(spark, sf), X.target_monthly(spark, sf), total_traffic(spark, sf))
    return d.select("date", *C.GRAIN, F.col("revenue").cast("double").alias("revenue"), "month_target", "site_traffic")
