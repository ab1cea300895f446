"""Scans, period comparison and ranking over the derived revenue fact."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sitemetrics.functions import dates as D
from sitemetrics.plans import compare as C
from sitemetrics.plans import periods as P
from sitemetrics.plans import stats as S
from sitemetrics.workload import facts as X
from sitemetrics.workload.facts import div_sql, pct_sql, trend_sql, with_ctes
from sitemetrics.workload.registry import query

# The two halves of the order history, so that a comparison reads every row.
HALVES = P.PeriodPair(dt.date(1998, 4, 16), dt.date(2001, 8, 1), dt.date(1995, 1, 1), dt.date(1998, 4, 15))
ANCHOR = dt.date(1999, 8, 18)

CUR = "date BETWEEN DATE '1998-04-16' AND DATE '2001-08-01'"
CMP = "date BETWEEN DATE '1995-01-01' AND DATE '1998-04-15'"


def sums_sql(keys: str, source: str = "rev") -> str:
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return (
        f"SELECT {k}CAST(COALESCE(SUM(CASE WHEN {CUR} THEN revenue END), 0) AS DOUBLE) AS current_revenue, "
        f"CAST(COALESCE(SUM(CASE WHEN {CMP} THEN revenue END), 0) AS DOUBLE) AS compare_revenue, "
        f"CAST(COALESCE(SUM(CASE WHEN {CUR} THEN pax END), 0) AS DOUBLE) AS current_pax, "
        f"CAST(COALESCE(SUM(CASE WHEN {CMP} THEN pax END), 0) AS DOUBLE) AS compare_pax FROM {source}{g}"
    )


def changes_sql(keys: str, source: str) -> str:
    rp, pp = pct_sql("current_revenue", "compare_revenue"), pct_sql("current_pax", "compare_pax")
    k = f"{keys}, " if keys else ""
    return (
        f"SELECT {k}current_revenue, compare_revenue, current_revenue - compare_revenue AS revenue_change, "
        f"{rp} AS revenue_pct_change, {trend_sql(f'({rp})', 'Revenue')} AS revenue_trend, "
        f"current_pax, compare_pax, current_pax - compare_pax AS pax_change, {pp} AS pax_pct_change, "
        f"{trend_sql(f'({pp})', 'PAX')} AS pax_trend FROM {source}"
    )


K3 = "segment, outlet, location"
COMPARED = {"s": sums_sql(K3), "c": changes_sql(K3, "s")}


@query("q01_two_period_comparison", with_ctes(["rev"], changes_sql(K3, "s"), {"s": sums_sql(K3)}))
def two_period(spark, sf):
    return C.by_current_revenue(C.compare_periods(X.rev(spark, sf), HALVES))


@query("j01_full_outer_form", with_ctes(["rev"], f"""
SELECT COALESCE(a.segment, b.segment) AS segment, COALESCE(a.location, b.location) AS location,
       CAST(COALESCE(a.revenue, 0) AS DOUBLE) AS current_revenue, CAST(COALESCE(b.revenue, 0) AS DOUBLE) AS compare_revenue
FROM (SELECT segment, location, SUM(revenue) AS revenue FROM rev WHERE {CUR} GROUP BY 1, 2) a
FULL OUTER JOIN (SELECT segment, location, SUM(revenue) AS revenue FROM rev WHERE {CMP} GROUP BY 1, 2) b
ON a.segment = b.segment AND a.location = b.location"""))
def one_pass_equals_outer_join(spark, sf):
    s = C.side_sums(X.rev(spark, sf), HALVES, ["segment", "location"], ["revenue"])
    return s.withColumns({c: F.col(c).cast("double") for c in ("current_revenue", "compare_revenue")})


@query("a01_period_sums", with_ctes(["rev"], """
SELECT location, segment, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(pax) AS DOUBLE) AS pax
FROM rev GROUP BY location, segment"""))
def period_sums(spark, sf):
    return C.rev_per_pax_table(X.rev(spark, sf), ["location", "segment"]).drop("rev_per_pax")


@query("a02_grain_sets", with_ctes(["rev"], " UNION ALL ".join(
    f"SELECT grain, segment, outlet, location, current_revenue, compare_revenue, revenue_change, revenue_pct_change, "
    f"revenue_trend, current_pax, compare_pax, pax_change, pax_pct_change, pax_trend FROM {g}" for g in ("g1", "g2", "g3", "g4")
), {
    **{f"s{i}": sums_sql(k) for i, k in enumerate([K3, "segment", "location", "location, segment"], 1)},
    "g1": changes_sql("'outlet' AS grain, segment, outlet, location", "s1"),
    "g2": changes_sql("'segment' AS grain, segment, NULL AS outlet, NULL AS location", "s2"),
    "g3": changes_sql("'location' AS grain, NULL AS segment, NULL AS outlet, location", "s3"),
    "g4": changes_sql("'location_segment' AS grain, segment, NULL AS outlet, location", "s4"),
}))
def grain_sets(spark, sf):
    return C.compare_grain_sets(X.rev(spark, sf), HALVES)


@query("p04_active_only", with_ctes(["rev"], "SELECT segment, outlet, location, current_revenue, compare_revenue FROM s "
       "WHERE current_revenue <> 0 OR compare_revenue <> 0", {"s": sums_sql(K3)}))
def active(spark, sf):
    return C.active_only(C.compare_periods(X.rev(spark, sf), HALVES)).select(
        *C.GRAIN, "current_revenue", "compare_revenue")


def _pairs() -> dict[str, P.PeriodPair]:
    week = P.resolve_ranges("Week-wise", ANCHOR)
    month = P.resolve_ranges("Month-wise", ANCHOR, mode="To-Date")
    year = P.resolve_ranges("Year-wise", ANCHOR)
    day = P.resolve_ranges("Day-wise", ANCHOR)
    empty = P.resolve_ranges("Year-wise", dt.date(1995, 6, 1))
    return {"day": day, "week": week, "month": month, "year": year, "halves": HALVES, "first_year": empty}


def _named_sql() -> str:
    parts = []
    for n, p in _pairs().items():
        cur = f"date BETWEEN DATE '{p.current_start}' AND DATE '{p.current_end}'"
        cmp_ = f"date BETWEEN DATE '{p.compare_start}' AND DATE '{p.compare_end}'"
        parts.append(
            f"SELECT '{n}' AS comparison, COUNT(CASE WHEN {cur} THEN 1 END) AS n1, COUNT(CASE WHEN {cmp_} THEN 1 END) AS n2, "
            + ", ".join(
                f"CAST(COALESCE(SUM(CASE WHEN {w} THEN {m} END), 0) AS DOUBLE) AS {s}_{m}"
                for s, w in (("current", cur), ("compare", cmp_)) for m in ("revenue", "pax")
            )
            + " FROM rev"
        )
    return " UNION ALL ".join(parts)


_RP = f"CASE WHEN n1 > 0 AND n2 > 0 THEN ({pct_sql('current_revenue', 'compare_revenue')}) END"
_PP = f"CASE WHEN n1 > 0 AND n2 > 0 THEN ({pct_sql('current_pax', 'compare_pax')}) END"


@query("q02_named_comparison", with_ctes(["rev"], f"""
SELECT comparison, current_revenue, compare_revenue, current_pax, compare_pax,
  current_revenue - compare_revenue AS revenue_change, rp AS revenue_pct_change, {trend_sql('rp', 'Revenue')} AS revenue_trend,
  current_pax - compare_pax AS pax_change, pp AS pax_pct_change, {trend_sql('pp', 'PAX')} AS pax_trend,
  {div_sql('current_revenue', 'current_pax')} AS current_rev_per_pax, {div_sql('compare_revenue', 'compare_pax')} AS compare_rev_per_pax
FROM (SELECT *, {_RP} AS rp, {_PP} AS pp FROM n)""", {"n": _named_sql()}))
def named(spark, sf):
    return C.named_comparison(X.rev(spark, sf), _pairs())


@query("a03_period_totals", with_ctes(["rev"], """
SELECT CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(pax) AS DOUBLE) AS pax, CAST(NULL AS DOUBLE) AS aop,
       CAST(SUM(revenue) AS DOUBLE) / CAST(SUM(pax) AS DOUBLE) AS rev_per_pax FROM rev"""))
def totals(spark, sf):
    return C.period_totals(X.rev(spark, sf))


@query("q03_rev_per_pax", with_ctes(["rev"], """
SELECT segment, outlet, location, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(pax) AS DOUBLE) AS pax,
       CASE WHEN SUM(pax) = 0 THEN NULL ELSE CAST(SUM(revenue) AS DOUBLE) / CAST(SUM(pax) AS DOUBLE) END AS rev_per_pax
FROM rev GROUP BY 1, 2, 3"""))
def rpp(spark, sf):
    return C.rev_per_pax_table(X.rev(spark, sf)).orderBy(F.desc("revenue"), *C.GRAIN)


DRIVERS = {
    "s": sums_sql(K3),
    "c": "SELECT *, " + div_sql("current_revenue", "current_pax") + " AS cr, " + div_sql("compare_revenue", "compare_pax") + " AS br FROM s",
    "d": f"SELECT segment, outlet, location, {pct_sql('current_pax', 'compare_pax')} AS pax_pct_change, "
         f"{pct_sql('current_revenue', 'compare_revenue')} AS revenue_pct_change, {pct_sql('cr', 'br')} AS rev_per_pax_pct_change FROM c",
    "drivers": """
SELECT *, CASE WHEN v < 0.05::DOUBLE AND w < 0.05::DOUBLE THEN 'Flat' WHEN v >= w * 1.2::DOUBLE THEN 'Volume-driven'
  WHEN w >= v * 1.2::DOUBLE THEN 'Spend-driven' ELSE 'Mixed' END AS driver
FROM (SELECT *, ABS(COALESCE(pax_pct_change, 0)) AS v, ABS(COALESCE(rev_per_pax_pct_change, 0)) AS w FROM d)""",
}
_DCOLS = "segment, outlet, location, pax_pct_change, revenue_pct_change, rev_per_pax_pct_change, driver"


@query("q04_volume_vs_spend", with_ctes(["rev"], f"SELECT {_DCOLS} FROM drivers", DRIVERS))
def drivers(spark, sf):
    return C.volume_vs_spend(X.rev(spark, sf), HALVES)


@query("p09_defined_changes", with_ctes(["rev"], f"""SELECT {_DCOLS} FROM drivers
WHERE revenue_pct_change IS NOT NULL OR pax_pct_change IS NOT NULL""", DRIVERS))
def defined(spark, sf):
    return C.defined_changes(C.volume_vs_spend(X.rev(spark, sf), HALVES))


@query("a14_driver_counts", with_ctes(["rev"], "SELECT driver, COUNT(*) AS outlets FROM drivers GROUP BY driver", DRIVERS))
def counts(spark, sf):
    return C.driver_counts(C.volume_vs_spend(X.rev(spark, sf), HALVES))


@query("o04_top_movers", with_ctes(["rev"], f"""
SELECT {_DCOLS}, CAST(rank AS INT) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY driver ORDER BY ABS(revenue_pct_change) DESC NULLS LAST,
  segment, outlet, location) AS rank FROM drivers) WHERE rank <= 2""", DRIVERS))
def movers(spark, sf):
    return C.top_movers(C.volume_vs_spend(X.rev(spark, sf), HALVES))


def _ranked(direction: str) -> str:
    return with_ctes(["rev"], f"""
SELECT segment, outlet, location, current_revenue, compare_revenue, {pct_sql('current_revenue', 'compare_revenue')} AS revenue_pct_change
FROM s WHERE current_revenue > 0 ORDER BY current_revenue {direction}, segment, outlet, location LIMIT 10""", {"s": sums_sql(K3)})


@query("o01_top_outlets", _ranked("DESC"))
def top(spark, sf):
    return C.ranked_outlets(X.rev(spark, sf), HALVES)


@query("o01_bottom_outlets", _ranked("ASC"))
def bottom(spark, sf):
    return C.ranked_outlets(X.rev(spark, sf), HALVES, worst=True)


@query("o02_segment_extremes", with_ctes(["rev"], """
SELECT (SELECT segment FROM p ORDER BY pct DESC, segment DESC LIMIT 1) AS top_growing, (SELECT MAX(pct) FROM p) AS top_growing_pct,
       (SELECT segment FROM p ORDER BY pct, segment LIMIT 1) AS top_declining, (SELECT MIN(pct) FROM p) AS top_declining_pct""",
    {"s": sums_sql("segment"), "p": f"SELECT segment, {pct_sql('current_revenue', 'compare_revenue')} AS pct FROM s"}))
def extremes(spark, sf):
    return C.segment_extremes(X.rev(spark, sf), HALVES)


@query("o06_change_list", with_ctes(["rev"], """
SELECT segment, outlet, location, current_revenue - compare_revenue AS revenue_change FROM s
WHERE current_revenue - compare_revenue <> 0""", {"s": sums_sql(K3)}))
def changes(spark, sf):
    return C.change_list(C.compare_periods(X.rev(spark, sf), HALVES)).select(*C.GRAIN, "revenue_change")


def _snapshot_sql() -> str:
    r = C.snapshot_ranges(ANCHOR)
    inside = {n: f"date BETWEEN DATE '{lo}' AND DATE '{hi}'" for n, (lo, hi) in r.items()}
    sums = ", ".join(f"CAST(COALESCE(SUM(CASE WHEN {c} THEN revenue END), 0) AS DOUBLE) AS {n}_revenue" for n, c in inside.items())
    pcts = ", ".join(f"{pct_sql(f'{u}_revenue', f'last_{u}_revenue')} AS {u}_pct_change" for u in ("week", "month", "year"))
    keep = " OR ".join(f"{n}_revenue <> 0" for n in r)
    return with_ctes(["rev"], f"SELECT *, {pcts} FROM s WHERE {keep}", {
        "s": f"SELECT segment, outlet, location, {sums} FROM rev WHERE {' OR '.join(inside.values())} GROUP BY 1, 2, 3"})


@query("q09_multi_period_snapshot", _snapshot_sql())
def snapshot(spark, sf):
    return C.multi_period_snapshot(X.rev(spark, sf), C.snapshot_ranges(ANCHOR))


@query("a06_dates_summary", with_ctes(["rev"], """
SELECT date, CAST(SUM(revenue) AS DOUBLE) AS total_revenue, CAST(SUM(pax) AS DOUBLE) AS total_pax,
       COUNT(DISTINCT outlet) AS outlets FROM rev GROUP BY date"""))
def dates_summary(spark, sf):
    return S.dates_summary(X.rev(spark, sf))


@query("a07_store_stats", with_ctes(["rev"], """
SELECT COUNT(*) AS total_rows, MIN(date) AS min_date, MAX(date) AS max_date, COUNT(DISTINCT date) AS distinct_dates FROM rev"""))
def store_stats(spark, sf):
    return S.store_stats(X.rev(spark, sf))


@query("a08_available_periods", with_ctes(["rev"], """
SELECT 'date' AS unit, date AS start FROM rev UNION SELECT 'week', CAST(DATE_TRUNC('week', date) AS DATE) FROM rev
UNION SELECT 'month', CAST(DATE_TRUNC('month', date) AS DATE) FROM rev
UNION SELECT 'year', CAST(DATE_TRUNC('year', date) AS DATE) FROM rev"""))
def available(spark, sf):
    return S.available_periods(X.rev(spark, sf))


@query("a08_available_terminals", with_ctes(["traffic"], "SELECT DISTINCT terminal FROM traffic WHERE terminal <> ''"))
def terminals(spark, sf):
    return S.available_terminals(X.traffic(spark, sf))


@query("a08_target_months", with_ctes(["target_monthly"], "SELECT DISTINCT CAST(year AS INT) AS year, CAST(month AS INT) AS month FROM target_monthly"))
def target_months(spark, sf):
    return S.target_months(X.target_monthly(spark, sf))


@query("a21_daily_totals", with_ctes(["rev"], """
SELECT date, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(pax) AS DOUBLE) AS pax FROM rev GROUP BY date"""))
def daily_totals(spark, sf):
    return S.daily_totals(X.rev(spark, sf), dt.date(1995, 1, 1), dt.date(2001, 8, 1))


@query("a21_days_covered", with_ctes(["rev"], "SELECT location, COUNT(DISTINCT date) AS days FROM rev GROUP BY location"))
def days_covered(spark, sf):
    return S.days_covered(X.rev(spark, sf), ["location"])


@query("a22_chart_feeds", with_ctes(["rev"], """
SELECT 'segment' AS feed, segment AS label, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM rev GROUP BY segment
UNION ALL SELECT 'location', location, CAST(SUM(revenue) AS DOUBLE) FROM rev GROUP BY location"""))
def feeds(spark, sf):
    return S.chart_feeds(X.rev(spark, sf))


@query("r02_location_union", with_ctes(["rev", "traffic"], "SELECT location FROM rev UNION SELECT location FROM traffic"))
def location_union(spark, sf):
    return S.location_union(X.rev(spark, sf), X.traffic(spark, sf))


@query("j09_as_of_dates", with_ctes(["rev"], """
SELECT a.anchor, (SELECT MAX(date) FROM d WHERE date <= a.anchor) AS nearest FROM a""", {
    "d": "SELECT DISTINCT date FROM rev WHERE location = 'ASIA' AND segment = 'BUILDING'",
    "a": "SELECT DISTINCT CAST(o_orderdate AS DATE) - 3 AS anchor FROM orders"}))
def as_of(spark, sf):
    from sitemetrics.operators.ordered import as_of_dates

    anchors = X.table(spark, sf, "orders").select(F.date_sub(F.col("o_orderdate").cast("date"), 3).alias("anchor")).distinct()
    seen = X.rev(spark, sf).where("location = 'ASIA' and segment = 'BUILDING'").select("date")
    return as_of_dates(anchors, seen)


@query("j10_comparison_dates", with_ctes(["rev"], """
SELECT anchor, (SELECT MAX(date) FROM d WHERE date <= anchor - 1) AS yesterday,
  (SELECT MAX(date) FROM d WHERE date <= CAST(anchor - INTERVAL 1 MONTH AS DATE)) AS last_month,
  (SELECT MAX(date) FROM d WHERE date <= CAST(anchor - INTERVAL 12 MONTH AS DATE)) AS last_year FROM a""", {
    "d": "SELECT DISTINCT date FROM rev", "a": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS anchor FROM orders"}))
def three_dates(spark, sf):
    anchors = X.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("anchor"))
    return P.comparison_dates(anchors, X.rev(spark, sf).select("date"))


_RESOLVED = """
SELECT anchor, 'Day-wise' AS kind, 'Full Period' AS mode, anchor AS current_start, anchor AS current_end,
  COALESCE(near, anchor - 1) AS compare_start, COALESCE(near, anchor - 1) AS compare_end,
  strftime(anchor, '%d %b %Y') AS current_label, strftime(COALESCE(near, anchor - 1), '%d %b %Y') AS compare_label FROM an
UNION ALL SELECT anchor, 'Week-wise', 'Full Period', w, w + 6, w - 7, w - 1,
  'Week of ' || strftime(w, '%d %b %Y') || ' (full week)', 'Week of ' || strftime(w - 7, '%d %b %Y') || ' (full week)' FROM an
UNION ALL SELECT anchor, 'Week-wise', 'To-Date', w, anchor, w - 7, anchor - 7,
  'Week of ' || strftime(w, '%d %b') || ' (Mon–' || strftime(anchor, '%a %d') || ')',
  'Week of ' || strftime(w - 7, '%d %b') || ' (Mon–' || strftime(anchor - 7, '%a %d') || ')' FROM an
UNION ALL SELECT anchor, 'Month-wise', 'Full Period', m, LAST_DAY(m), pm, m - 1,
  strftime(m, '%b %Y') || ' (full month)', strftime(pm, '%b %Y') || ' (full month)' FROM an
UNION ALL SELECT anchor, 'Month-wise', 'To-Date', m, anchor, pm, LEAST(pm + CAST(anchor - m AS INT), m - 1),
  strftime(m, '%b %Y') || ' (1–' || CAST(DAY(anchor) AS VARCHAR) || ')',
  strftime(pm, '%b %Y') || ' (1–' || CAST(DAY(LEAST(pm + CAST(anchor - m AS INT), m - 1)) AS VARCHAR) || ')' FROM an
UNION ALL SELECT anchor, 'Year-wise', 'Full Period', y, CAST(y + INTERVAL 1 YEAR AS DATE) - 1, py, y - 1,
  strftime(y, '%Y') || ' (full year)', strftime(py, '%Y') || ' (full year)' FROM an
UNION ALL SELECT anchor, 'Year-wise', 'To-Date', y, anchor, py, LEAST(py + CAST(anchor - y AS INT), y - 1),
  strftime(y, '%Y') || ' (Jan 1–' || strftime(anchor, '%b %d') || ')',
  strftime(py, '%Y') || ' (Jan 1–' || strftime(LEAST(py + CAST(anchor - y AS INT), y - 1), '%b %d') || ')' FROM an"""


@query("k15_resolve_periods", with_ctes(["rev"], _RESOLVED, {
    "d": "SELECT DISTINCT date FROM rev",
    "an": """SELECT anchor, (SELECT MAX(date) FROM d WHERE date < anchor) AS near, CAST(DATE_TRUNC('week', anchor) AS DATE) AS w,
  CAST(DATE_TRUNC('month', anchor) AS DATE) AS m, CAST(DATE_TRUNC('month', anchor) - INTERVAL 1 MONTH AS DATE) AS pm,
  CAST(DATE_TRUNC('year', anchor) AS DATE) AS y, CAST(DATE_TRUNC('year', anchor) - INTERVAL 1 YEAR AS DATE) AS py
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS anchor FROM orders)"""}))
def resolve(spark, sf):
    anchors = X.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("anchor")).distinct()
    days = X.rev(spark, sf).select("date")
    out = None
    for kind in P.KINDS:
        for mode in P.MODES if kind != "Day-wise" else P.MODES[:1]:
            r = P.resolve_all(anchors, kind, mode, days).withColumns({"kind": F.lit(kind), "mode": F.lit(mode)})
            out = r if out is None else out.unionByName(r)
    return out


@query("k12_k14_calendar", """
SELECT DISTINCT d, CAST(d - INTERVAL 1 MONTH AS DATE) AS prev_month_day, CAST(d - INTERVAL 12 MONTH AS DATE) AS prev_year_day,
  CAST(DATE_TRUNC('week', d) AS DATE) AS week_start, CAST(DATE_TRUNC('week', d) AS DATE) + 6 AS week_end,
  CAST(DATE_TRUNC('month', d) AS DATE) AS month_start, LAST_DAY(d) AS month_end,
  CAST(DATE_TRUNC('year', d) AS DATE) AS year_start, CAST(DATE_TRUNC('year', d) + INTERVAL 1 YEAR AS DATE) - 1 AS year_end
FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def calendar_bounds(spark, sf):
    d = X.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return d.select(
        "d", D.month_shift("d", -1).alias("prev_month_day"), D.month_shift("d", -12).alias("prev_year_day"),
        D.week_start("d").alias("week_start"), D.week_end("d").alias("week_end"),
        D.month_start("d").alias("month_start"), D.month_end("d").alias("month_end"),
        D.year_start("d").alias("year_start"), D.year_end("d").alias("year_end"),
    )


@query("k16_short_labels", """
SELECT DISTINCT lo, hi, CASE WHEN hi - lo = 0 THEN strftime(lo, '%d %b %Y')
  WHEN hi - lo <= 6 THEN 'Week of ' || strftime(CAST(DATE_TRUNC('week', lo) AS DATE), '%d %b %Y')
  WHEN hi - lo <= 31 THEN strftime(lo, '%b %Y') ELSE strftime(lo, '%Y') END AS label
FROM (SELECT CAST(o_orderdate AS DATE) AS lo, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 AS INT) AS hi FROM orders)""")
def short_labels(spark, sf):
    o = X.table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("lo"),
        F.expr("date_add(cast(o_orderdate as date), cast(o_orderkey % 50 as int))").alias("hi"),
    ).distinct()
    lo, hi = F.col("lo"), F.col("hi")
    return o.withColumn("label", P.short_label_column(lo, hi, P.kind_of_span(lo, hi)))


@query("k17_span_labels", """
SELECT o_custkey, CASE WHEN lo = hi THEN strftime(lo, '%d %b %Y')
  WHEN DATE_TRUNC('month', lo) = DATE_TRUNC('month', hi) THEN strftime(lo, '%d') || '–' || strftime(hi, '%d %b %Y')
  WHEN YEAR(lo) = YEAR(hi) THEN strftime(lo, '%d %b') || ' – ' || strftime(hi, '%d %b %Y')
  ELSE strftime(lo, '%d %b %Y') || ' – ' || strftime(hi, '%d %b %Y') END AS label
FROM (SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS lo, CAST(MAX(o_orderdate) AS DATE) AS hi FROM orders GROUP BY o_custkey)""")
def span_labels(spark, sf):
    o = X.table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))
    return o.select("o_custkey", D.span_label("lo", "hi").alias("label"))
