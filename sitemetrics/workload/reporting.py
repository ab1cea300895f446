"""Reports, dimension lookups and text over the derived facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitemetrics.functions import formats as FM
from sitemetrics.functions import labels as L
from sitemetrics.functions import metrics as M
from sitemetrics.operators import dims
from sitemetrics.operators.reuse import materialise
from sitemetrics.operators.select import within_any
from sitemetrics.plans import allocate as A
from sitemetrics.plans import compare as C
from sitemetrics.plans import narrative as N
from sitemetrics.plans import periods as P
from sitemetrics.plans import reconcile as R
from sitemetrics.plans import reports as Q
from sitemetrics.workload import facts as X
from sitemetrics.workload.allocation import (
    AT, CMP_R, CUR_R, MONTHLY, POOLED, REV_TB, TT2, day_traffic, pool_sql, total_targets, traffic_total_sql,
)
from sitemetrics.workload.comparison import ANCHOR, CMP, CUR, HALVES, changes_sql, sums_sql
from sitemetrics.workload.facts import div_sql, pct_sql, trend_sql, with_ctes
from sitemetrics.workload.registry import query

CATEGORIES = {
    "All services": None,
    "Machinery": "segment = 'MACHINERY'",
    "Homes": "segment in ('BUILDING', 'HOUSEHOLD', 'FURNITURE')",
}
CAT_SQL = ("SELECT 'All services' AS category, segment FROM (SELECT DISTINCT segment FROM rev) UNION ALL SELECT 'Machinery', 'MACHINERY' "
           "UNION ALL SELECT * FROM (VALUES ('Homes', 'BUILDING'), ('Homes', 'HOUSEHOLD'), ('Homes', 'FURNITURE')) t(a, b)")
SHARE3 = {
    "o3": f"SELECT segment, outlet, location, SUM(revenue) AS r FROM rev WHERE {CUR} GROUP BY 1, 2, 3",
    "l3": "SELECT location, CAST(SUM(r) AS DOUBLE) AS lr, COUNT(*) AS n FROM o3 GROUP BY 1",
    "sa3": "SELECT o3.segment, o3.outlet, o3.location, t.aop_target * CASE WHEN lr > 0 THEN CAST(r AS DOUBLE) / lr ELSE 1.0::DOUBLE / n END AS aop_target "
           "FROM o3 JOIN l3 USING (location) LEFT JOIN agt t USING (location)",
}
_PANEL = changes_sql("category, aop_target, current_revenue - aop_target AS target_variance, "
                     + pct_sql("current_revenue", "aop_target") + " AS target_variance_pct", "p")


@query("q14_category_panel", with_ctes(["rev", "target_daily", "target_monthly"], _PANEL, {
    **AT, **SHARE3, "cat": CAT_SQL, "s": f"""
SELECT segment, outlet, location, COALESCE(SUM(CASE WHEN {CUR} THEN revenue END), 0) AS current_revenue,
  COALESCE(SUM(CASE WHEN {CMP} THEN revenue END), 0) AS compare_revenue, COALESCE(SUM(CASE WHEN {CUR} THEN pax END), 0) AS current_pax,
  COALESCE(SUM(CASE WHEN {CMP} THEN pax END), 0) AS compare_pax FROM rev GROUP BY 1, 2, 3""",
    "p": "SELECT category, " + ", ".join(f"CAST(SUM({c}) AS DOUBLE) AS {c}" for c in Q.SUMS) +
         ", CAST(SUM(CAST(aop_target AS DECIMAL(28,4))) AS DOUBLE) AS aop_target FROM s JOIN cat USING (segment) "
         "LEFT JOIN sa3 USING (segment, outlet, location) GROUP BY 1"}))
def category_panel(spark, sf):
    return Q.category_panel(X.rev(spark, sf), HALVES, CATEGORIES, total_targets(spark, sf))


@query("p06_category_locations", with_ctes(["rev"], """
SELECT category, location, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(pax) AS DOUBLE) AS pax
FROM rev JOIN cat USING (segment) GROUP BY 1, 2""", {"cat": CAT_SQL}))
def category_locations(spark, sf):
    return Q.category_locations(X.rev(spark, sf), CATEGORIES)


@query("q14_category_penetration", with_ctes(POOLED, f"""
SELECT category, r.segment, r.outlet, r.location, revenue, pax, p.traffic, ({div_sql('pax', 'p.traffic')}) * 100 AS penetration_pct,
  {div_sql('revenue', 'p.traffic')} AS rev_per_visitor FROM
(SELECT segment, outlet, location, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(pax) AS DOUBLE) AS pax FROM rev WHERE {CUR} GROUP BY 1, 2, 3) r
JOIN cat USING (segment) LEFT JOIN outlet_pool o USING (outlet) LEFT JOIN pt p ON p.location = r.location AND p.pool = o.pool""",
    {**traffic_total_sql(CUR_R), **pool_sql(), "cat": CAT_SQL}))
def category_penetration(spark, sf):
    f = X.rev(spark, sf).where(HALVES.side("current"))
    t = A.traffic_by_outlet(f, R.traffic_total(X.traffic(spark, sf), *CUR_R), X.outlet_pool(spark, sf), X.pool_member(spark))
    return Q.category_outlets(f, CATEGORIES, t)


# norm_label turns '#' into a blank, so keywords are matched on the normalised text.
CLASSES = [("brand 1", "Domestic"), ("brand 2", "International")]
CLASS_SQL = "CASE WHEN outlet LIKE 'Brand#1%' THEN 'Domestic' WHEN outlet LIKE 'Brand#2%' THEN 'International' ELSE 'Ancillary' END"
BREAKDOWN = {
    **traffic_total_sql(CUR_R, "c"), **traffic_total_sql(CMP_R, "p"),
    "cl": "SELECT location, SUM(CAST(traffic AS DECIMAL(30,8))) AS t FROM ctt GROUP BY 1",
    "pl": "SELECT location, SUM(CAST(traffic AS DECIMAL(30,8))) AS t FROM ptt GROUP BY 1",
    "lc": f"SELECT location, {CLASS_SQL} AS category, SUM(CASE WHEN {CUR} THEN revenue END) AS cr, SUM(CASE WHEN {CMP} THEN revenue END) AS pr, "
          f"SUM(CASE WHEN {CUR} THEN pax END) AS cp, SUM(CASE WHEN {CMP} THEN pax END) AS pp, COUNT(CASE WHEN {CUR} THEN 1 END) AS nc, "
          f"COUNT(CASE WHEN {CMP} THEN 1 END) AS np FROM rev GROUP BY 1, 2",
    "s": "SELECT category, CAST(COALESCE(SUM(cr), 0) AS DOUBLE) AS current_revenue, CAST(COALESCE(SUM(pr), 0) AS DOUBLE) AS compare_revenue, "
         "CAST(COALESCE(SUM(cp), 0) AS DOUBLE) AS current_pax, CAST(COALESCE(SUM(pp), 0) AS DOUBLE) AS compare_pax, "
         "CAST(SUM(CASE WHEN nc > 0 AND cl.t > 0 THEN cl.t END) AS DOUBLE) AS current_traffic, "
         "CAST(SUM(CASE WHEN np > 0 AND pl.t > 0 THEN pl.t END) AS DOUBLE) AS compare_traffic "
         "FROM lc LEFT JOIN cl USING (location) LEFT JOIN pl USING (location) GROUP BY 1",
    "b": "SELECT *, " + ", ".join(
        f"({div_sql(f'{s}_pax', f'{s}_traffic')}) * 100 AS {s}_penetration_pct, {div_sql(f'{s}_revenue', f'{s}_traffic')} AS {s}_rev_per_visitor, "
        f"{div_sql(f'{s}_revenue', f'{s}_pax')} AS {s}_rev_per_pax" for s in ("current", "compare")) + " FROM s",
    "bd": "SELECT *, current_revenue - compare_revenue AS revenue_change, current_pax - compare_pax AS pax_change, "
          "current_rev_per_pax - compare_rev_per_pax AS rev_per_pax_change, "
          + ", ".join(f"{pct_sql(f'current_{a}', f'compare_{a}')} AS {b}_pct_change" for a, b in (
              ("revenue", "revenue"), ("pax", "pax"), ("traffic", "traffic"), ("penetration_pct", "penetration"), ("rev_per_pax", "rev_per_pax"))) + " FROM b",
}


def breakdown(spark, sf, rev=None):
    tr = X.traffic(spark, sf)
    sites = {"current": R.traffic_total(tr, *CUR_R), "compare": R.traffic_total(tr, *CMP_R)}
    return Q.class_breakdown(X.rev(spark, sf) if rev is None else rev, HALVES, L.keyword_class("outlet", CLASSES, "Ancillary"), sites)


@query("q10_class_breakdown", with_ctes(["rev", "traffic"], "SELECT * FROM bd", BREAKDOWN))
def class_breakdown(spark, sf):
    return breakdown(spark, sf)


@query("a17_class_shares", with_ctes(["rev", "traffic"], """
SELECT category, current_revenue, current_revenue / CAST((SELECT SUM(CAST(current_revenue AS DECIMAL(30,8))) FROM bd) AS DOUBLE) * 100 AS share_pct FROM bd""", BREAKDOWN))
def class_shares(spark, sf):
    return Q.class_shares(breakdown(spark, sf))


@query("n04_class_insight", with_ctes(["rev", "traffic"], """
SELECT category, category || ' revenue ' || CASE WHEN COALESCE(revenue_pct_change, 0) >= 0 THEN 'increased' ELSE 'decreased' END || ' by ' ||
  printf('%.1f', ABS(COALESCE(revenue_pct_change, 0)) * 100) || '% vs the first half, driven by ' ||
  CASE WHEN ABS(COALESCE(pax_pct_change, 0)) >= ABS(COALESCE(rev_per_pax_pct_change, 0))
    THEN CASE WHEN COALESCE(pax_pct_change, 0) >= 0 THEN 'higher passenger volume' ELSE 'lower passenger volume' END
    ELSE CASE WHEN COALESCE(rev_per_pax_pct_change, 0) >= 0 THEN 'improved spend per passenger (SPP)' ELSE 'lower spend per passenger (SPP)' END END ||
  '. It contributed ' || printf('%.1f', current_revenue / t * 100) || '% of total revenue in the second half.' AS text
FROM bd, (SELECT CAST(SUM(CAST(current_revenue AS DECIMAL(30,8))) AS DOUBLE) AS t FROM bd) WHERE category <> 'Ancillary'
UNION ALL SELECT 'overall', 'Overall, ' || CASE WHEN (SELECT current_revenue FROM bd WHERE category = 'International') >
  (SELECT current_revenue FROM bd WHERE category = 'Domestic') THEN 'International' ELSE 'Domestic' END ||
  ' is the stronger-performing category in the second half.'""", BREAKDOWN))
def class_insight(spark, sf):
    # The sentences use the breakdown several times, and it uses the facts twice.
    facts = X.rev(spark, sf)
    b = materialise(breakdown(spark, sf, materialise(facts.where(within_any(facts, HALVES.ranges())))))
    best = N.stronger_class(b, "Domestic", "International", "the second half").select(F.lit("overall").alias("category"), "text")
    return N.class_insight(b, "the second half", "the first half").unionByName(best)


@query("l14_outlet_class", f"SELECT DISTINCT p_brand AS outlet, {CLASS_SQL.replace('outlet', 'p_brand')} AS category FROM part")
def outlet_class(spark, sf):
    return X.table(spark, sf, "part").select(F.col("p_brand").alias("outlet")).distinct().withColumn("category", L.keyword_class("outlet", CLASSES, "Ancillary"))


POOL_LABEL = "CASE WHEN o.pool IS NOT NULL THEN o.pool WHEN o.outlet IS NOT NULL THEN 'Airport-wide services' ELSE 'Unmapped' END"
MAPPED = "SELECT * FROM outlet_pool WHERE outlet NOT LIKE 'Brand#2%'"


@query("q11_pool_breakdown", with_ctes(POOLED, f"""
SELECT a.location, a.pool, revenue, pax, p.traffic, ({div_sql('pax', 'p.traffic')}) * 100 AS penetration_pct, {div_sql('revenue', 'p.traffic')} AS rev_per_visitor
FROM (SELECT r.location, {POOL_LABEL} AS pool, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(pax) AS DOUBLE) AS pax
      FROM rev r LEFT JOIN mapped o USING (outlet) WHERE {CUR} GROUP BY 1, 2) a
LEFT JOIN pt p ON p.location = a.location AND p.pool = a.pool""", {"mapped": MAPPED, **traffic_total_sql(CUR_R), **pool_sql()}))
def pool_breakdown(spark, sf):
    mapped = X.outlet_pool(spark, sf).where("outlet not like 'Brand#2%'")
    f = X.rev(spark, sf).where(HALVES.side("current"))
    return Q.pool_breakdown(f, R.traffic_total(X.traffic(spark, sf), *CUR_R), mapped, X.pool_member(spark))


@query("l12_pool_labels", with_ctes(["rev", "outlet_pool"], f"""
SELECT DISTINCT r.outlet, r.location, CASE WHEN o.outlet IS NULL AND r.location = 'AFRICA' THEN 'Main Terminal' ELSE {POOL_LABEL} END AS pool_label
FROM rev r LEFT JOIN mapped o USING (outlet)""", {"mapped": MAPPED}))
def pool_labels(spark, sf):
    mapped = X.outlet_pool(spark, sf).where("outlet not like 'Brand#2%'")
    return dims.add_pool(X.rev(spark, sf).select("outlet", "location").distinct(), mapped, ["AFRICA"])


@query("l13_unmapped_outlets", with_ctes(["rev", "outlet_pool"], """
SELECT DISTINCT outlet, location FROM rev WHERE outlet NOT IN (SELECT outlet FROM mapped)""", {"mapped": MAPPED}))
def unmapped(spark, sf):
    return dims.unmapped_outlets(X.rev(spark, sf), X.outlet_pool(spark, sf).where("outlet not like 'Brand#2%'"))


@query("j15_terminal_traffic", with_ctes(["traffic"], """
SELECT location, CASE WHEN terminal = '5-LOW' THEN 'Main Terminal' ELSE terminal END AS terminal, CAST(CAST(traffic AS DECIMAL(30,8)) AS DOUBLE) AS traffic FROM tt""", traffic_total_sql(CUR_R)))
def terminal_traffic(spark, sf):
    t = X.traffic(spark, sf).withColumn("terminal", F.when(F.col("terminal") == "5-LOW", "").otherwise(F.col("terminal")))
    return Q.terminal_traffic(R.traffic_total(t, *CUR_R))


TYPES = [("1-URGENT", "International"), ("2-HIGH", "International"), ("3-MEDIUM", "Domestic"), ("4-NOT SPECIFIED", "Domestic")]


@query("q12_type_mix", with_ctes(["traffic"], f"""
SELECT location, type, current_traffic, compare_traffic, current_traffic / l AS share, {pct_sql('current_traffic', 'compare_traffic')} AS traffic_pct_change
FROM m JOIN (SELECT location, CAST(SUM(CAST(current_traffic AS DECIMAL(30,8))) AS DOUBLE) AS l FROM m GROUP BY 1) USING (location)""", {
    **traffic_total_sql(CUR_R, "c"), **traffic_total_sql(CMP_R, "p"),
    "m": """SELECT location, type, CAST(SUM(c) AS DOUBLE) AS current_traffic, CAST(SUM(p) AS DOUBLE) AS compare_traffic FROM (
  SELECT location, terminal, CAST(traffic AS DECIMAL(30,8)) AS c, 0 AS p FROM ctt UNION ALL SELECT location, terminal, 0, CAST(traffic AS DECIMAL(30,8)) FROM ptt)
JOIN (VALUES ('1-URGENT', 'International'), ('2-HIGH', 'International'), ('3-MEDIUM', 'Domestic'), ('4-NOT SPECIFIED', 'Domestic')) t(terminal, type)
USING (terminal) GROUP BY 1, 2"""}))
def type_mix(spark, sf):
    tr = X.traffic(spark, sf)
    return Q.type_mix(R.traffic_total(tr, *CUR_R), R.traffic_total(tr, *CMP_R), spark.createDataFrame(TYPES, "terminal string, type string"))


def group_member(spark, sf):
    """Brand number modulo 5 gives the group; the last class has none."""
    k = F.substring("outlet", 7, 10).cast("int") % 5
    return X.outlet_pool(spark, sf).where(k < 4).select("outlet", F.concat(F.lit("G"), k.cast("string")).alias("group"), (k * 10).alias("ord"))


SUBTOTALS = [("G0", "S01", 15), ("G1", "S01", 15), ("G1", "S123", 35), ("G2", "S123", 35), ("G3", "S123", 35)]
GROUP_CTES = {
    **TT2, "s": sums_sql("location, outlet"),
    **{k: v.replace("FROM rev GROUP", f"FROM rev WHERE {CUR} GROUP") for k, v in MONTHLY.items()},
    "lf": "SELECT s.*, t.a AS aop FROM s LEFT JOIN (SELECT location, outlet, SUM(CAST(aop_target AS DECIMAL(30,8))) AS a FROM bm GROUP BY 1, 2) t "
          "USING (location, outlet) WHERE current_revenue <> 0 OR compare_revenue <> 0",
    "ou": "SELECT outlet, CASE WHEN k < 4 THEN 'G' || k ELSE 'Other' END AS g, CASE WHEN k < 4 THEN k * 10 ELSE 1000000 END AS ord "
          "FROM (SELECT DISTINCT outlet, CAST(SUBSTRING(outlet, 7) AS INT) % 5 AS k FROM lf)",
    "st": "SELECT * FROM (VALUES ('G0', 'S01', 15), ('G1', 'S01', 15), ('G1', 'S123', 35), ('G2', 'S123', 35), ('G3', 'S123', 35)) t(g, label, ord)",
    "nd": "SELECT outlet, 'outlet' AS level, outlet AS label, ord FROM ou UNION ALL SELECT outlet, 'group', g, ord FROM ou "
          "UNION ALL SELECT outlet, 'subtotal', label, st.ord FROM ou JOIN st USING (g) UNION ALL SELECT outlet, 'total', 'Total', 1000001 FROM ou",
    "sm": "SELECT location, level, label, CAST(MIN(ord) AS INT) AS ord, " + ", ".join(
        f"CAST(SUM(CAST({c} AS DECIMAL(30,8))) AS DOUBLE) AS {c}" for c in Q.SUMS) +
        ", CAST(SUM(aop) AS DOUBLE) AS aop_target FROM lf JOIN nd USING (outlet) GROUP BY 1, 2, 3",
    "rc": "SELECT DISTINCT lf.location, nd.level, nd.label, m.terminal FROM lf JOIN nd USING (outlet) JOIN outlet_pool o USING (outlet) JOIN pool_member m USING (pool)",
    **{f"{p}n": f"SELECT rc.location, level, label, CAST(SUM(CAST(traffic AS DECIMAL(30,8))) AS DOUBLE) AS t FROM rc JOIN {p}tt USING (location, terminal) GROUP BY 1, 2, 3" for p in "cp"},
    "gr": "SELECT sm.*, cn.t AS current_traffic, pn.t AS compare_traffic, "
          f"({div_sql('current_pax', 'cn.t')}) * 100 AS current_penetration_pct, ({div_sql('compare_pax', 'pn.t')}) * 100 AS compare_penetration_pct, "
          f"{div_sql('current_revenue', 'cn.t')} AS current_rev_per_visitor, {div_sql('compare_revenue', 'pn.t')} AS compare_rev_per_visitor "
          "FROM sm LEFT JOIN cn USING (location, level, label) LEFT JOIN pn USING (location, level, label)",
}


@query("q13_group_report", with_ctes([*POOLED, "target_monthly"], "SELECT *, " + ", ".join(
    f"{pct_sql(a, b)} AS {n}_pct_change" for n, a, b in (
        ("revenue", "current_revenue", "compare_revenue"), ("pax", "current_pax", "compare_pax"), ("traffic", "current_traffic", "compare_traffic"),
        ("penetration", "current_penetration_pct", "compare_penetration_pct"),
        ("rev_per_visitor", "current_rev_per_visitor", "compare_rev_per_visitor"), ("target", "current_revenue", "aop_target"))) + " FROM gr", GROUP_CTES))
def group_report(spark, sf):
    rev, tr = X.rev(spark, sf), X.traffic(spark, sf)
    totals = {"current": R.traffic_total(tr, *CUR_R), "compare": R.traffic_total(tr, *CMP_R)}
    targets = A.target_by_month(rev.where(HALVES.side("current")), X.target_monthly(spark, sf))
    sub = spark.createDataFrame(SUBTOTALS, "group string, subtotal string, ord int")
    return Q.in_report_order(Q.group_report(
        rev, HALVES, totals, X.outlet_pool(spark, sf), X.pool_member(spark), group_member(spark, sf), sub, targets))


@query("q15_segment_tree", with_ctes(["rev"], "SELECT grain, location, segment, current_revenue, compare_revenue, current_pax, compare_pax, rp AS revenue_pct_change, "
       "pp AS pax_pct_change, CASE WHEN rp > 0.05::DOUBLE THEN 'up' WHEN rp < -0.05::DOUBLE THEN 'down' ELSE 'flat' END AS direction FROM ("
       f"SELECT *, {pct_sql('current_revenue', 'compare_revenue')} AS rp, {pct_sql('current_pax', 'compare_pax')} AS pp FROM u)", {
    "u": f"SELECT 'location' AS grain, CAST(NULL AS VARCHAR) AS segment, * FROM ({sums_sql('location')}) UNION ALL BY NAME "
         f"SELECT 'location_segment' AS grain, * FROM ({sums_sql('location, segment')})"}))
def segment_tree(spark, sf):
    return Q.segment_tree(X.rev(spark, sf), HALVES)


@query("q16_executive_summary", with_ctes(["rev"], f"""
SELECT 'revenue' AS metric, current_revenue AS value, {trend_sql('rp', 'Revenue')} AS text FROM t UNION ALL
SELECT 'revenue_pct_change', rp, NULL FROM t UNION ALL SELECT 'pax', current_pax, {trend_sql('pp', 'PAX')} FROM t UNION ALL
SELECT 'pax_pct_change', pp, NULL FROM t UNION ALL SELECT 'rev_per_pax', current_revenue / current_pax, NULL FROM t UNION ALL
(SELECT 'top_growing', pct, segment FROM g ORDER BY pct DESC, segment DESC LIMIT 1) UNION ALL
(SELECT 'top_declining', pct, segment FROM g ORDER BY pct, segment LIMIT 1)""", {
    "s": sums_sql(""), "t": f"SELECT *, {pct_sql('current_revenue', 'compare_revenue')} AS rp, {pct_sql('current_pax', 'compare_pax')} AS pp FROM s",
    "sg": sums_sql("segment"), "g": f"SELECT segment, {pct_sql('current_revenue', 'compare_revenue')} AS pct FROM sg"}))
def executive(spark, sf):
    return Q.executive_summary(X.rev(spark, sf), HALVES)



def _driver_text_sql(t: str, n: str, s: str, r: str) -> str:
    up, dn = lambda x: f"COALESCE({x} > 0.05::DOUBLE, FALSE)", lambda x: f"COALESCE({x} < -0.05::DOUBLE, FALSE)"
    a = lambda x: f"COALESCE(ABS({x}), -1)"
    lead = f"CASE WHEN {a(n)} >= {a(s)} AND {a(n)} >= {a(t)} THEN 'n' WHEN {a(s)} >= {a(t)} THEN 's' ELSE 't' END"
    spend = f"({s} IS NOT NULL AND ({n} IS NULL OR ABS({s}) >= ABS({n})))"
    return f"""CASE WHEN {r} IS NULL OR ({t} IS NULL AND {n} IS NULL AND {s} IS NULL) THEN '—'
WHEN {up(r)} THEN CASE WHEN {dn(t)} AND ({up(s)} OR {up(n)}) THEN 'Revenue increased despite traffic decline due to ' || CASE WHEN {spend} THEN 'higher SPP' ELSE 'higher penetration' END || '.'
  WHEN {up(t)} AND {dn(s)} AND {dn(n)} THEN 'Revenue increased on higher traffic alone, despite lower penetration and SPP.'
  WHEN {lead} = 's' AND {up(s)} THEN 'Revenue increased mainly due to higher spend per visitor (SPP).'
  WHEN {lead} = 'n' AND {up(n)} THEN 'Revenue increased mainly due to higher penetration (more visitors converted to customers).'
  WHEN {lead} = 't' AND {up(t)} THEN 'Revenue increased mainly due to higher airport traffic.' ELSE 'Revenue increased.' END
WHEN {dn(r)} THEN CASE WHEN {up(t)} AND ({dn(s)} OR {dn(n)}) THEN 'Revenue declined despite higher traffic due to ' || CASE WHEN {spend} THEN 'lower SPP' ELSE 'lower penetration' END || '.'
  WHEN {dn(t)} AND {up(s)} AND {up(n)} THEN 'Revenue declined due to lower traffic, despite higher penetration and SPP.'
  WHEN {lead} = 's' AND {dn(s)} THEN 'Revenue declined mainly due to lower spend per visitor (SPP).'
  WHEN {lead} = 'n' AND {dn(n)} THEN 'Revenue declined mainly due to lower penetration (fewer visitors converted to customers).'
  WHEN {lead} = 't' AND {dn(t)} THEN 'Revenue declined mainly due to lower airport traffic.' ELSE 'Revenue declined.' END
ELSE 'Revenue was broadly stable.' END"""


def _pen_text_sql(t: str, x: str, n: str) -> str:
    return f"""CASE WHEN {n} IS NULL OR {t} IS NULL OR {x} IS NULL THEN '—' WHEN {n} > 0.05::DOUBLE THEN 'Penetration rose because PAX growth outpaced traffic growth.'
WHEN {n} < -0.05::DOUBLE AND {x} < 0 AND {t} >= 0 THEN 'Penetration dropped because PAX declined while traffic held or grew.'
WHEN {n} < -0.05::DOUBLE THEN 'Penetration dropped because PAX growth was lower than traffic growth.'
ELSE 'Penetration was broadly stable, with PAX and traffic moving together.' END"""


def monthly_changes(spark, sf):
    """Month against the month before, per location, for every month: many different driver situations."""
    f = day_traffic(spark, sf).withColumn("month", F.trunc("date", "MM"))
    per_day = f.groupBy("location", "month", "date").agg(F.sum("revenue").alias("r"), F.sum("pax").alias("p"), F.max("traffic").alias("t"))
    m = A.with_ratios(per_day.groupBy("location", "month").agg(
        F.sum("r").cast("double").alias("revenue"), F.sum("p").cast("double").alias("pax"), F.sum("t").cast("double").alias("traffic")))
    before = m.withColumn("month", F.add_months("month", 1))
    return A.metric_variance(m, before, ["location", "month"])


MONTH_CHANGES = {
    "md": """SELECT rev.location, CAST(DATE_TRUNC('month', rev.date) AS DATE) AS month, rev.date, SUM(revenue) AS r, SUM(pax) AS p, MAX(s.traffic) AS t FROM rev LEFT JOIN
  (SELECT date, location, SUM(traffic) AS traffic FROM traffic_base GROUP BY 1, 2) s ON s.date = rev.date AND s.location = rev.location GROUP BY 1, 2, 3""",
    "mm": """SELECT *, CASE WHEN traffic = 0 THEN NULL ELSE pax / traffic END * 100 AS penetration_pct, CASE WHEN traffic = 0 THEN NULL ELSE revenue / traffic END AS rev_per_visitor
  FROM (SELECT location, month, CAST(SUM(r) AS DOUBLE) AS revenue, CAST(SUM(p) AS DOUBLE) AS pax, CAST(SUM(t) AS DOUBLE) AS traffic FROM md GROUP BY 1, 2)""",
    "mb": "SELECT * REPLACE (CAST(month + INTERVAL 1 MONTH AS DATE) AS month) FROM mm",
    "mv": "SELECT location, month, " + ", ".join(
        f"{pct_sql(f'c.{m}', f'p.{m}')} AS {m.replace('penetration_pct', 'penetration')}_pct_change"
        for m in ("traffic", "revenue", "pax", "penetration_pct", "rev_per_visitor")) + " FROM mm c FULL OUTER JOIN mb p USING (location, month)",
}


@query("n01_revenue_driver_text", with_ctes(REV_TB, "SELECT location, month, " + _driver_text_sql(
    "traffic_pct_change", "penetration_pct_change", "rev_per_visitor_pct_change", "revenue_pct_change") + " AS text FROM mv", MONTH_CHANGES))
def revenue_driver_text(spark, sf):
    return monthly_changes(spark, sf).select("location", "month", M.revenue_driver_text(
        "traffic_pct_change", "penetration_pct_change", "rev_per_visitor_pct_change", "revenue_pct_change").alias("text"))


@query("n02_penetration_driver_text", with_ctes(REV_TB, "SELECT location, month, " + _pen_text_sql(
    "traffic_pct_change", "pax_pct_change", "penetration_pct_change") + " AS text FROM mv", MONTH_CHANGES))
def penetration_driver_text(spark, sf):
    return monthly_changes(spark, sf).select("location", "month", M.penetration_driver_text(
        "traffic_pct_change", "pax_pct_change", "penetration_pct_change").alias("text"))


def group_sql(v: str) -> str:
    """Lakh/crore grouping of an integer text, without look-ahead."""
    s = f"CAST(ABS({v}) AS VARCHAR)"
    return (
        f"CASE WHEN {v} < 0 THEN '-' ELSE '' END || CASE WHEN LENGTH({s}) <= 3 THEN {s} ELSE "
        f"LTRIM(REVERSE(REGEXP_REPLACE(REVERSE(LEFT({s}, LENGTH({s}) - 3)), '(\\d\\d)', '\\1,', 'g')), ',') || ',' || RIGHT({s}, 3) END"
    )


def whole_sql(x: str) -> str:
    return f"CAST(ROUND_EVEN({x}, 0) AS BIGINT)"


def money_sql(x: str) -> str:
    return f"COALESCE('₹' || {group_sql(whole_sql(x))}, '—')"


def pax_sql(x: str) -> str:
    return f"COALESCE({group_sql(whole_sql(x))}, '—')"


def pct_text_sql(x: str, signed: bool = True) -> str:
    sign = f"CASE WHEN {x} >= 0 THEN '+' ELSE '' END || " if signed else ""
    return f"COALESCE({sign}printf('%.2f', {x} * 100) || '%', '—')"


@query("k23_display_formats", f"""
SELECT o_orderkey, {money_sql('v')} AS money, {pax_sql('o_orderkey')} AS pax, {pct_text_sql('r')} AS pct, {pct_text_sql('r', False)} AS pct_plain,
  REGEXP_REPLACE(printf('%.2f', s), '\\.00$', '') AS spend,
  printf('%.2f', r * 100)::DOUBLE AS pct_back
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice * 100 ELSE o_totalprice * 37 END AS v,
  (o_totalprice - 200000) / 200000 AS r, o_totalprice / 100 AS s FROM orders)""")
def display_formats(spark, sf):
    o = X.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_totalprice") * 100).otherwise(F.col("o_totalprice") * 37).alias("v"),
        ((F.col("o_totalprice") - 200000) / 200000).alias("r"), (F.col("o_totalprice") / 100).alias("s"))
    return o.select(
        "o_orderkey", FM.money_text("v").alias("money"), FM.pax_text("o_orderkey").alias("pax"), FM.pct_text("r").alias("pct"),
        FM.pct_text("r", signed=False).alias("pct_plain"), FM.spend_text("s").alias("spend"), FM.pct_from_text(FM.pct_text("r")).alias("pct_back"))


@query("k26_formatted_comparison", with_ctes(["rev"], f"""
SELECT segment, location, {money_sql('current_revenue')} AS "Current Revenue", {money_sql('compare_revenue')} AS "Compare Revenue",
  {pax_sql('current_pax')} AS "Current PAX", {pct_text_sql('p')} AS "Revenue %" FROM (
  SELECT *, {pct_sql('current_revenue', 'compare_revenue')} AS p FROM s)""", {"s": sums_sql("segment, location")}))
def formatted(spark, sf):
    from sitemetrics.plans.display import format_table

    c = C.compare_periods(X.rev(spark, sf), HALVES, ["segment", "location"])
    return format_table(c.select("segment", "location", "current_revenue", "compare_revenue", "current_pax", "revenue_pct_change"), {
        "current_revenue": "Current Revenue", "compare_revenue": "Compare Revenue", "current_pax": "Current PAX", "revenue_pct_change": "Revenue %"})


def _span_sql(lo: str, hi: str) -> str:
    return (f"CASE WHEN {lo} = {hi} THEN strftime({lo}, '%d %b %Y') WHEN DATE_TRUNC('month', {lo}) = DATE_TRUNC('month', {hi}) "
            f"THEN strftime({lo}, '%d') || '–' || strftime({hi}, '%d %b %Y') WHEN YEAR({lo}) = YEAR({hi}) THEN strftime({lo}, '%d %b') || ' – ' || strftime({hi}, '%d %b %Y') "
            f"ELSE strftime({lo}, '%d %b %Y') || ' – ' || strftime({hi}, '%d %b %Y') END")


REFERENCE = {
    "yesterday": P.resolve_ranges("Day-wise", ANCHOR), "last_month": P.resolve_ranges("Month-wise", ANCHOR),
    "last_year": P.resolve_ranges("Year-wise", ANCHOR),
}


def _narrative_sql() -> str:
    from sitemetrics.workload.comparison import DRIVERS

    pairs = {"selected": HALVES, **REFERENCE}
    rows = []
    for name, p in pairs.items():
        cur = f"date BETWEEN DATE '{p.current_start}' AND DATE '{p.current_end}'"
        cmp_ = f"date BETWEEN DATE '{p.compare_start}' AND DATE '{p.compare_end}'"
        rows.append(f"SELECT '{name}' AS comparison, " + ", ".join(
            f"CAST(COALESCE(SUM(CASE WHEN {w} THEN {m} END), 0) AS DOUBLE) AS {s}_{m}" for s, w in (("current", cur), ("compare", cmp_)) for m in ("revenue", "pax")
        ) + ", " + ", ".join(f"{f}(CASE WHEN {w} THEN date END) AS {s}_{n}" for s, w in (("current", cur), ("compare", cmp_)) for f, n in (("MIN", "lo"), ("MAX", "hi"))) + " FROM rev")
    num = "CASE comparison WHEN 'selected' THEN 2 WHEN 'yesterday' THEN 3 WHEN 'last_month' THEN 4 ELSE 5 END"
    updown = "CASE WHEN COALESCE(rp, 0) >= 0 THEN 'up' ELSE 'down' END"
    size = pct_text_sql("ABS(COALESCE({0}, 0))", False)
    ctes = {
        **DRIVERS, **MONTHLY,
        "nc0": " UNION ALL ".join(rows),
        "nc": f"SELECT *, {pct_sql('current_revenue', 'compare_revenue')} AS rp, {pct_sql('current_pax', 'compare_pax')} AS pp, "
              f"{_span_sql('current_lo', 'current_hi')} AS cur, {_span_sql('compare_lo', 'compare_hi')} AS cmp FROM nc0",
        "shown": "SELECT * FROM nc WHERE comparison = 'selected' OR NOT (compare_lo BETWEEN DATE '1995-01-01' AND DATE '1998-04-15' AND compare_hi BETWEEN DATE '1995-01-01' AND DATE '1998-04-15')",
        "oc": f"SELECT segment, outlet, location, current_revenue, {pct_sql('current_revenue', 'compare_revenue')} AS p FROM s WHERE current_revenue > 0",
        "rk": "SELECT *, ROW_NUMBER() OVER (ORDER BY current_revenue DESC, segment, outlet, location) AS a, ROW_NUMBER() OVER (ORDER BY current_revenue, segment, outlet, location) AS b FROM oc",
        "sg": sums_sql("segment"),
        "sp": f"SELECT *, {pct_sql('current_revenue', 'compare_revenue')} AS p FROM sg",
        "mv2": "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY driver ORDER BY ABS(revenue_pct_change) DESC NULLS LAST, segment, outlet, location) AS rn FROM drivers) WHERE rn <= 2",
        "cnt": "SELECT COUNT(*) AS n, " + ", ".join(f"COUNT(CASE WHEN driver = '{d}' THEN 1 END) AS {k}" for k, d in (("v", "Volume-driven"), ("w", "Spend-driven"), ("m", "Mixed"), ("f", "Flat"))) + " FROM drivers",
        "tv": "SELECT *, actual - target AS variance FROM (SELECT CAST(SUM(CAST(revenue AS DECIMAL(30,8))) AS DOUBLE) AS actual, CAST(SUM(CAST(aop_target AS DECIMAL(30,8))) AS DOUBLE) AS target FROM bm)",
    }
    title = {k: f"'{v}'" for k, v in N.SECTIONS.items()}
    pct_par = f"CASE WHEN p IS NOT NULL THEN ' (' || {pct_text_sql('p')} || ')' ELSE '' END"
    part = lambda c, t: f"CASE WHEN {c} > 0 THEN {c} || ' {t}' END"
    case_title = "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in title.items()) + " END"
    body = f"""
SELECT k AS section_no, {case_title} AS section, CAST(line_no AS INT) AS line_no, text FROM (
SELECT 1 AS k, 1 AS line_no, 'Total revenue for ' || cur || ' was ' || {money_sql('current_revenue')} || ' from ' || {pax_sql('current_pax')} || ' PAX (Revenue/PAX: ' || {money_sql('current_revenue / current_pax')} || ').' AS text FROM shown WHERE comparison = 'selected'
UNION ALL SELECT 1, 2, 'That''s ' || {updown} || ' ' || {size.format('rp')} || ' versus ' || cmp || ' (' || {money_sql('compare_revenue')} || '), a change of ' || {money_sql('(current_revenue - compare_revenue)')} || '. ' || {trend_sql('rp', 'Revenue')} FROM shown WHERE comparison = 'selected'
UNION ALL SELECT {num}, 1, 'Revenue for ' || cur || ' is ' || {updown} || ' ' || {size.format('rp')} || ' vs ' || cmp || ' (' || {money_sql('compare_revenue')} || ' → ' || {money_sql('current_revenue')} || '). PAX changed by ' || {pct_text_sql('pp')} || '.' FROM shown WHERE current_lo IS NOT NULL AND compare_lo IS NOT NULL
UNION ALL SELECT 8, 1, 'PAX ' || CASE WHEN pp >= 0 THEN 'increased' ELSE 'decreased' END || ' by ' || {size.format('pp')} || ' vs ' || cmp || ' (' || {pax_sql('compare_pax')} || ' → ' || {pax_sql('current_pax')} || ').' FROM shown WHERE comparison = 'selected'
UNION ALL SELECT 8, 2, CASE WHEN pp < 0 AND rp > 0 THEN 'Revenue grew despite a footfall decline — driven by higher spend per visitor (Revenue/PAX increased).'
  ELSE 'Revenue fell despite higher footfall — spend per visitor (Revenue/PAX) declined enough to offset the volume gain.' END FROM shown WHERE comparison = 'selected' AND ((pp < 0 AND rp > 0) OR (pp > 0 AND rp < 0))
UNION ALL SELECT 6, a, 'Top ' || a || ': ' || outlet || ' (' || location || '): ' || {money_sql('current_revenue')} || {pct_par} FROM rk WHERE a <= 3
UNION ALL SELECT 6, b + 100, 'Bottom ' || b || ': ' || outlet || ' (' || location || '): ' || {money_sql('current_revenue')} || {pct_par} FROM rk WHERE b <= 3
UNION ALL SELECT 7, 1, 'Across ' || n || ' outlet/location combinations: ' || CONCAT_WS(', ', {part('v', 'volume-driven')}, {part('w', 'spend-driven')}, {part('m', 'mixed')}, {part('f', 'flat')}) || '.' FROM cnt
UNION ALL SELECT 7, CASE WHEN driver = 'Volume-driven' THEN 2 ELSE 3 END, 'Notable ' || LOWER(driver) || ' movers: ' || STRING_AGG(outlet || ' (' || location || ')', ', ' ORDER BY rn) || '.' FROM mv2 WHERE driver IN ('Volume-driven', 'Spend-driven') GROUP BY driver
UNION ALL SELECT 9, ROW_NUMBER() OVER (ORDER BY current_revenue DESC, segment), segment || ': ' || {money_sql('current_revenue')} || ' (' || {pax_sql('current_pax')} || ' PAX)' FROM sg
UNION ALL SELECT 9, 1000, 'Fastest growing segment: ' || g.segment || ' (' || {pct_text_sql('g.p')} || '). Fastest declining: ' || d.segment || ' (' || {pct_text_sql('d.p')} || ').' FROM (SELECT * FROM sp ORDER BY p DESC, segment DESC LIMIT 1) g, (SELECT * FROM sp ORDER BY p, segment LIMIT 1) d
UNION ALL SELECT 10, 1, 'Actual revenue of ' || {money_sql('actual')} || ' against an AOP target of ' || {money_sql('target')} || ' — ' || printf('%.1f', actual / target * 100) || '% achievement, ' || CASE WHEN variance >= 0 THEN '✅ on/above target' ELSE '⚠️ below target' END || '.' FROM tv
UNION ALL SELECT 10, 2, 'Variance: ' || {money_sql('variance')} || ' (' || {pct_text_sql('(variance / target)')} || ').' FROM tv)"""
    return with_ctes(["rev", "target_monthly"], body, ctes)


@query("n03_management_summary", _narrative_sql())
def management_summary(spark, sf):
    rev = X.rev(spark, sf)
    actuals = A.target_by_month(rev, X.target_monthly(spark, sf)).select("revenue", F.col("aop_target").alias("aop"))
    return N.management_summary(rev, HALVES, REFERENCE, 3, actuals)


@query("p10_not_in_selected", with_ctes(["rev"], """
SELECT COUNT(*) > 0 AS different FROM (SELECT DISTINCT date FROM rev WHERE location = 'ASIA' EXCEPT SELECT date FROM rev WHERE location = 'EUROPE')"""))
def not_in_selected(spark, sf):
    rev = X.rev(spark, sf)
    a = rev.where("location = 'ASIA'").select("date").distinct()
    b = rev.where("location = 'EUROPE'").select("date").distinct()
    return a.join(b, "date", "left_anti").agg((F.count(F.lit(1)) > 0).alias("different"))


@query("l10_display_names", """
SELECT DISTINCT p_brand AS outlet, p_type AS location, CASE WHEN p_brand = 'Brand#13' AND p_type = 'ECONOMY' THEN 'Special 13'
  WHEN p_brand LIKE 'Brand#1%' THEN 'House ' || SUBSTRING(p_brand, 7) ELSE p_brand END AS display_name FROM part""")
def display_names(spark, sf):
    part = X.table(spark, sf, "part").select(F.col("p_brand").alias("outlet"), F.col("p_type").alias("location")).distinct()
    general = part.where("outlet like 'Brand#1%'").select("outlet").distinct().select(
        "outlet", F.lit(None).cast("string").alias("location"), F.concat(F.lit("House "), F.substring("outlet", 7, 9)).alias("display"))
    own = spark.createDataFrame([("Brand#13", "ECONOMY", "Special 13")], "outlet string, location string, display string")
    return dims.display_name(part, general.unionByName(own))


@query("l11_outlet_groups", """
SELECT DISTINCT p_brand AS outlet, CASE WHEN CAST(SUBSTRING(p_brand, 7) AS INT) % 5 < 4 THEN 'G' || CAST(SUBSTRING(p_brand, 7) AS INT) % 5 ELSE 'Other' END AS outlet_group FROM part""")
def outlet_groups(spark, sf):
    return dims.outlet_group(X.table(spark, sf, "part").select(F.col("p_brand").alias("outlet")).distinct(), group_member(spark, sf))


_SEGMENTS = [("BUILDING", None, "Core", "Building"), ("FURNITURE", None, "Core", "Furniture"), ("household", "Brand#13", "Plates", "Plates"),
             ("household", None, "Household", "Household")]


@query("l08_canonical_segment", with_ctes(["rev"], """
SELECT segment AS raw, outlet, CASE WHEN segment IN ('BUILDING', 'FURNITURE') THEN 'Core' WHEN segment = 'HOUSEHOLD' AND outlet = 'Brand#13' THEN 'Plates'
  WHEN segment = 'HOUSEHOLD' THEN 'Household' ELSE segment END AS segment,
  CASE WHEN segment = 'BUILDING' THEN 'Building' WHEN segment = 'FURNITURE' THEN 'Furniture' WHEN segment = 'HOUSEHOLD' AND outlet = 'Brand#13' THEN 'Plates'
  WHEN segment = 'HOUSEHOLD' THEN 'Household' ELSE segment END AS business_unit, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM rev GROUP BY 1, 2, 3, 4"""))
def canonical_segment(spark, sf):
    per = X.rev(spark, sf).groupBy("segment", "outlet").agg(F.sum("revenue").cast("double").alias("revenue")).withColumn("raw", F.col("segment"))
    rules = spark.createDataFrame(_SEGMENTS, "raw_segment string, outlet_key string, segment string, business_unit string")
    return dims.canonical_segment(per, rules)


@query("l09_outlet_alias", with_ctes(["rev"], """
SELECT CASE WHEN outlet = 'Brand#13' AND location = 'ASIA' THEN 'Thirteen' ELSE outlet END AS outlet, location, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM rev GROUP BY 1, 2"""))
def outlet_alias(spark, sf):
    per = X.rev(spark, sf).groupBy("outlet", "location").agg(F.sum("revenue").cast("double").alias("revenue"))
    spaced = per.withColumn("outlet", F.concat(F.lit("  "), "outlet", F.lit(" ")))
    return dims.alias_outlet(spaced, spark.createDataFrame([("brand#13", "ASIA", "Thirteen")], "alias string, location string, outlet string"))


@query("a15_combine_outlets", with_ctes(["rev"], """
SELECT location, CASE WHEN outlet IN ('Brand#11', 'Brand#12') THEN 'Brand#13' ELSE outlet END AS outlet, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM rev GROUP BY 1, 2"""))
def combine_outlets(spark, sf):
    rev = X.rev(spark, sf)
    link = spark.createDataFrame([("Brand#11", "Brand#13"), ("Brand#12", "Brand#13")], "outlet string, into string")
    return rev.join(link, "outlet", "left").groupBy("location", F.coalesce("into", "outlet").alias("outlet")).agg(F.sum("revenue").cast("double").alias("revenue"))


@query("a16_fan_out_lines", with_ctes(["target_monthly"], """
SELECT location, n.outlet, CAST(SUM(aop) AS DOUBLE) AS aop FROM target_monthly t JOIN
(VALUES ('Brand#1', 'Alias A'), ('Brand#1', 'Alias B'), ('Brand#2', 'Alias C')) n(line, outlet) ON n.line = t.outlet GROUP BY 1, 2"""))
def fan_out(spark, sf):
    links = spark.createDataFrame([("Brand#1", "Alias A"), ("Brand#1", "Alias B"), ("Brand#2", "Alias C")], "line string, outlet string")
    t = X.target_monthly(spark, sf).withColumnRenamed("outlet", "line")
    return dims.fan_out(t, links, "line").groupBy("location", "outlet").agg(F.sum("aop").cast("double").alias("aop"))


@query("l17_site_labels", with_ctes(["rev"], "SELECT DISTINCT outlet || ' (' || location || ')' AS label FROM rev"))
def site_labels(spark, sf):
    return X.rev(spark, sf).select(L.site_label("outlet", "location").alias("label")).distinct()
