"""Known layouts, checked by writing the derived facts out as cell grids of that layout and reading them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitemetrics.operators.reuse import materialise
from sitemetrics.plans import layouts as LY
from sitemetrics.workload import facts as X
from sitemetrics.workload.facts import with_ctes
from sitemetrics.workload.registry import query

YEARS = (1990, 2050)
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
PLACES = {r.lower(): r for r in REGIONS}
PAIRS = [(r, 1 + 2 * i, 2 + 2 * i) for i, r in enumerate(REGIONS)]
CELL = ["grid_id", "source", "sheet", "row_idx", "col_idx", "value"]


def text(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def lay(rows: DataFrame, columns: list[tuple], source: str, sheet=None) -> DataFrame:
    """Cells from rows with grid_id, row_idx and (column number, text expression) pairs."""
    items = F.array(*[F.struct(F.lit(c).cast("int").alias("col_idx") if isinstance(c, int) else c.cast("int").alias("col_idx"), v.alias("value")) for c, v in columns])
    return rows.select("grid_id", F.lit(source).alias("source"), (sheet if sheet is not None else F.lit("Sheet1")).alias("sheet"),
                       F.col("row_idx").cast("int").alias("row_idx"), F.explode(items).alias("x")).select("grid_id", "source", "sheet", "row_idx", "x.*")


def stack(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*CELL) for p in parts])


def label_row(grids: DataFrame, row: int, labels: list[str], source: str, sheet=None) -> DataFrame:
    return lay(grids.withColumn("row_idx", F.lit(row)), [(i, F.lit(t)) for i, t in enumerate(labels)], source, sheet)


def month_id(prefix: str):
    return F.concat(F.lit(prefix), F.date_format("date", "yyyy-MM"))


def long_sheets(spark, sf) -> DataFrame:
    """One long sheet per month."""
    rev = X.once(spark, sf).rev.withColumn("grid_id", month_id("long "))
    w = W.partitionBy("grid_id").orderBy("date", "segment", "outlet", "location")
    rows = rev.withColumn("row_idx", F.row_number().over(w))
    head = label_row(rows.select("grid_id").distinct(), 0, ["Date", "Location", "Business", "Sub-Business", "PAX", "Revenue"], "long.csv")
    return stack(head, lay(rows, [(0, F.date_format("date", "dd/MM/yyyy")), (1, F.col("location")), (2, F.col("segment")), (3, F.col("outlet")), (4, text("pax")), (5, text("revenue"))], "long.csv"))


REV = "SELECT date, segment, outlet, location, CAST(pax AS DOUBLE) AS pax, CAST(revenue AS DOUBLE) AS revenue{} FROM rev"


@query("g01_long_revenue", with_ctes(["rev"], REV.format(", CAST(NULL AS DOUBLE) AS aop, CAST(NULL AS DOUBLE) AS traffic")))
def long_revenue(spark, sf):
    return LY.long_revenue(materialise(long_sheets(spark, sf)), PLACES, YEARS)


def pivot_sheets(spark, sf, metrics=("PAX.", "Revenue.")) -> DataFrame:
    """One pivot per month with subtotal columns per location and a total row."""
    rev = X.once(spark, sf).rev.withColumn("grid_id", month_id("pivot "))
    keys = rev.select("grid_id", "location", "segment", "outlet").distinct()
    rollups = keys.select("grid_id", "location", F.lit("~").alias("segment"), F.lit("~").alias("outlet")).distinct()
    cols = keys.unionByName(rollups).withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    cols = cols.withColumn("col_idx", F.row_number().over(W.partitionBy("grid_id").orderBy("location", "segment", "outlet", "metric")))
    first = lambda *k: F.row_number().over(W.partitionBy("grid_id", *k).orderBy("col_idx")) == 1
    c = cols.withColumns({"fl": first("location"), "fs": first("location", "segment"), "fo": first("location", "segment", "outlet")})
    sub = F.col("segment") == "~"
    banner = c.select("grid_id", "col_idx", F.explode(F.create_map(
        F.lit(0), F.when(sub, F.concat("location", F.lit(" "), "metric")).when(F.col("fl"), F.col("location")),
        F.lit(1), F.when(~sub & F.col("fs"), F.col("segment")), F.lit(2), F.when(~sub & F.col("fo"), F.col("outlet")), F.lit(3), F.col("metric"),
    )).alias("row_idx", "value")).where("value is not null")
    day_row = F.datediff("date", F.trunc("date", "MM")) + 4
    values = rev.select(
        "grid_id", "location", "segment", "outlet", day_row.alias("row_idx"), F.explode(F.create_map(F.lit("PAX."), text("pax"), F.lit("Revenue."), text("revenue"))).alias("metric", "value"))
    data = values.join(cols, ["grid_id", "location", "segment", "outlet", "metric"]).select("grid_id", "col_idx", "row_idx", "value")
    days = rev.select("grid_id", F.lit(0).alias("col_idx"), day_row.alias("row_idx"), F.date_format("date", "yyyy-MM-dd").alias("value")).distinct()
    total = cols.select("grid_id", "col_idx", F.lit(40).alias("row_idx"), F.lit("1").alias("value"))
    total_label = cols.select("grid_id", F.lit(0).alias("col_idx"), F.lit(40).alias("row_idx"), F.lit("Grand Total").alias("value")).distinct()
    rolled = rollups.join(cols, ["grid_id", "location", "segment", "outlet"]).select("grid_id", "col_idx", F.lit(5).alias("row_idx"), F.lit("999").alias("value"))
    out = reduce(DataFrame.unionByName, [x.select("grid_id", F.col("row_idx").cast("int"), F.col("col_idx").cast("int"), "value") for x in (banner, data, days, total, total_label, rolled)])
    return out.select("grid_id", F.lit("pivot.xlsx").alias("source"), F.lit("Sheet1").alias("sheet"), "row_idx", "col_idx", "value")


@query("g02_wide_pivot", with_ctes(["rev"], REV.format(", CAST(NULL AS DOUBLE) AS aop_daily")))
def wide_pivot(spark, sf):
    return LY.wide_pivot(materialise(pivot_sheets(spark, sf)), PLACES, YEARS)


def _site_columns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Paired pax / revenue texts per region as p0, r0, p1, ..."""
    at = lambda r, m: F.max(F.when(F.col("location") == r, F.col(m))).cast("string")
    return rows.groupBy(*keys).agg(*[at(r, m).alias(f"{m[0]}{i}") for i, r in enumerate(REGIONS) for m in ("pax", "revenue")])


def _pair_cells():
    return [(1 + 2 * i + j, F.col(f"{m}{i}")) for i in range(len(REGIONS)) for j, m in enumerate("pr")]


def stacked_sheets(spark, sf) -> DataFrame:
    """One sheet per year of stacked daily blocks; the category row gives the unit."""
    rev = X.once(spark, sf).rev.withColumn("grid_id", F.date_format("date", "'stacked 'yyyy"))
    lines = _site_columns(rev.withColumn("label", F.concat_ws(" ", "segment", "outlet")), ["grid_id", "date", "segment", "label"]).withColumn("k", F.lit(2))
    blank = [F.lit(None).cast("string").alias(f"{m}{i}") for i in range(len(REGIONS)) for m in "pr"]
    marks = rev.select("grid_id", "date").distinct().select("grid_id", "date", F.lit("").alias("segment"), F.lit(LY.BLOCK_MARKER).alias("label"), *blank, F.lit(0).alias("k")).withColumn("p0", F.date_format("date", "dd-MMM-yyyy"))
    cats = rev.select("grid_id", "date", "segment").distinct().select("grid_id", "date", "segment", F.concat(F.col("segment"), F.lit(" group")).alias("label"), *blank, F.lit(1).alias("k"))
    rows = lines.unionByName(marks).unionByName(cats)
    rows = rows.withColumn("row_idx", F.row_number().over(W.partitionBy("grid_id").orderBy("date", "segment", "k", "label")))
    return lay(rows, [(0, F.col("label")), *_pair_cells()], "stacked.xlsx")


@query("g03_stacked_blocks", with_ctes(["rev"], """
SELECT date, 'Main' AS segment, segment || ' ' || outlet AS outlet, location, segment AS business_unit, CAST(pax AS DOUBLE) AS pax, CAST(revenue AS DOUBLE) AS revenue FROM rev"""))
def stacked(spark, sf):
    cats = {f"{s.lower()} group": s for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}
    return LY.stacked_blocks(materialise(stacked_sheets(spark, sf)), PAIRS, cats, "Main", "AUTOMOBILE", {}, ["total"], YEARS)


def sectioned_sheets(spark, sf) -> DataFrame:
    """One detail table per day: title, sections, outlets, subtotal and total rows."""
    rev = X.once(spark, sf).rev.withColumn("grid_id", F.date_format("date", "'detail 'yyyy-MM-dd"))
    lines = _site_columns(rev, ["grid_id", "date", "segment", "outlet"]).withColumns({"label": F.col("outlet"), "k": F.lit(2)})
    days = rev.select("grid_id", "date").distinct()
    secs = rev.select("grid_id", "date", "segment").distinct()
    blank = [F.lit(None).cast("string").alias(f"{m}{i}") for i in range(len(REGIONS)) for m in "pr"]
    ones = [F.lit("7").alias(f"{m}{i}") for i in range(len(REGIONS)) for m in "pr"]
    part = lambda d, seg, label, k, vals: d.select("grid_id", "date", seg.alias("segment"), F.lit("").alias("outlet"), *vals, label.cast("string").alias("label"), F.lit(k).alias("k"))
    rows = reduce(DataFrame.unionByName, [
        lines, part(days, F.lit(""), F.concat(F.lit("For the Day -> "), F.date_format("date", "dd-MM-yyyy")), 0, blank),
        part(secs, F.col("segment"), F.col("segment"), 1, blank), part(secs, F.col("segment"), F.lit(None), 3, ones), part(days, F.lit("~"), F.lit("Total"), 4, ones)])
    rows = rows.withColumn("row_idx", F.row_number().over(W.partitionBy("grid_id").orderBy("segment", "k", "outlet")))
    return lay(rows, [(0, F.col("label")), *_pair_cells()], "detail.pdf")


@query("g04_sectioned_table", with_ctes(["rev"], REV.format("")))
def sectioned(spark, sf):
    return LY.sectioned_table(materialise(sectioned_sheets(spark, sf)), PAIRS, years=YEARS)


@query("r06_rows_to_sites", with_ctes(["rev"], "SELECT location, COUNT(*) AS rows, CAST(SUM(pax) AS DOUBLE) AS pax FROM rev GROUP BY location"))
def rows_to_sites(spark, sf):
    t = LY.sectioned_table(materialise(sectioned_sheets(spark, sf)), PAIRS, years=YEARS)
    return t.groupBy("location").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("pax").cast("decimal(28,2)")).cast("double").alias("pax"))


@query("a23_parse_totals", with_ctes(["rev"], "SELECT COUNT(*) AS rows, CAST(SUM(revenue) AS DOUBLE) AS total_revenue, CAST(SUM(pax) AS DOUBLE) AS total_pax, MIN(date) AS date FROM rev"))
def parse_totals(spark, sf):
    from sitemetrics.plans.quality import parse_totals

    return parse_totals(LY.long_revenue(materialise(long_sheets(spark, sf)), PLACES, YEARS))


@query("j17_summary_check", with_ctes(["rev"], """
SELECT segment, location, sp AS summary_pax, sr * 100000.0::DOUBLE AS summary_revenue, pp AS parsed_pax, pr AS parsed_revenue FROM (
  SELECT segment, location, CAST(SUM(pax) AS DOUBLE) AS pp, CAST(SUM(revenue) AS DOUBLE) AS pr,
    CAST(SUM(pax) AS DOUBLE) + CASE WHEN location = 'ASIA' THEN 5 ELSE 0 END AS sp, CAST(SUM(revenue) AS DOUBLE) * CASE WHEN segment = 'BUILDING' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END / 100000.0::DOUBLE AS sr
  FROM rev GROUP BY 1, 2) WHERE ABS(pp - sp) > 1 OR ABS(pr - sr * 100000.0::DOUBLE) > GREATEST(50000.0::DOUBLE, sr * 100000.0::DOUBLE * 0.01::DOUBLE)"""))
def summary_check(spark, sf):
    rev = X.once(spark, sf).rev
    parsed = rev.select(*LY.KEY, F.col("pax").cast("double").alias("pax"), F.col("revenue").cast("double").alias("revenue"))
    off = rev.groupBy("segment", "location").agg(F.sum("pax").cast("double").alias("p"), F.sum("revenue").cast("double").alias("r")).select(
        "segment", "location", (F.col("p") + F.when(F.col("location") == "ASIA", 5).otherwise(0)).alias("pax"),
        (F.col("r") * F.when(F.col("segment") == "BUILDING", 1.5).otherwise(1.0) / 100000.0).alias("revenue"))
    return LY.check_against_summary(parsed, off)


def budget_sheets(spark, sf) -> DataFrame:
    """One budget workbook per year with twelve month columns, roll-up lines and units."""
    t = X.target_monthly(spark, X.once(spark, sf)).withColumn("grid_id", F.concat(F.lit("budget "), text("year")))
    lines = t.groupBy("grid_id", "year", "location", "outlet").agg(*[F.max(F.when(F.col("month") == m, F.col("aop"))).cast("string").alias(f"m{m}") for m in range(1, 13)])
    rows = lines.withColumn("row_idx", F.row_number().over(W.partitionBy("grid_id").orderBy("location", "outlet")) + 3)
    heads = t.select("grid_id", "year").distinct().withColumn("row_idx", F.lit(3))
    months = [(3 + m, F.date_format(F.make_date("year", F.lit(m), F.lit(1)), "dd-MM-yyyy")) for m in range(1, 13)]
    head = lay(heads, [(1, F.lit("Geographical Segment")), (2, F.lit("Business Segment")), (3, F.lit("Unit-ID")), *months, (17, F.lit("Total")), (18, F.lit("01-01-2040"))], "budget.xlsx")
    title = lay(heads.withColumn("row_idx", F.lit(0)), [(0, F.lit("Annual Operating Plan"))], "budget.xlsx")
    rollup = lay(heads.withColumn("row_idx", F.lit(500)), [(1, F.lit("All")), (4, F.lit("12345"))], "budget.xlsx")
    body = lay(rows, [(1, F.col("location")), (2, F.when(F.col("location") == "AFRICA", "Unknown").otherwise("Lounge")), (3, F.concat(F.lit("U "), "outlet")),
                      *[(3 + m, F.col(f"m{m}")) for m in range(1, 13)], (18, F.lit("1"))], "budget.xlsx")
    return stack(title, head, body, rollup)


def unit_map(spark, sf) -> DataFrame:
    """Brands 1x map one to one, brand 20 feeds two outlets, brands 21 and 22 are combined, the rest have no mapping."""
    base = X.target_monthly(spark, X.once(spark, sf)).select("location", "outlet").distinct()
    targets = F.when(F.col("outlet") == "Brand#20", F.array(F.lit("Left"), F.lit("Right"))).when(
        F.col("outlet").isin("Brand#21", "Brand#22"), F.array(F.lit("Joint"))).when(F.col("outlet").like("Brand#1%"), F.array("outlet"))
    return base.select("location", F.concat(F.lit("U "), "outlet").alias("unit_id"), F.explode(targets).alias("outlet"))


BUDGET_MAP = """SELECT outlet, 'Left' AS target FROM (SELECT 'Brand#20' AS outlet) UNION ALL SELECT 'Brand#20', 'Right' UNION ALL SELECT 'Brand#21', 'Joint'
UNION ALL SELECT 'Brand#22', 'Joint' UNION ALL SELECT DISTINCT outlet, outlet FROM target_monthly WHERE outlet LIKE 'Brand#1%'"""


def _budgets(spark, sf):
    sf = X.once(spark, sf)
    return LY.monthly_targets(materialise(budget_sheets(spark, sf)), PLACES, {"lounge": "Lounges"}, unit_map(spark, sf), "Main", YEARS)


@query("g05_monthly_targets", with_ctes(["target_monthly"], """
SELECT location, 'Main' AS segment, 'Lounges' AS business_unit, m.target AS outlet, CAST(year AS INT) AS year, CAST(month AS INT) AS month, CAST(SUM(aop) AS DOUBLE) AS aop
FROM target_monthly t JOIN m USING (outlet) WHERE location <> 'AFRICA' GROUP BY 1, 4, 5, 6""", {"m": BUDGET_MAP}))
def monthly_targets(spark, sf):
    return _budgets(spark, sf)[0]


@query("g05_skipped_lines", with_ctes(["target_monthly"], """
SELECT reason, COUNT(*) AS lines FROM (SELECT DISTINCT location, outlet, year, CASE WHEN location = 'AFRICA' THEN 'business segment out of scope' ELSE 'no outlet mapped to this unit' END AS reason
FROM target_monthly WHERE location = 'AFRICA' OR outlet NOT IN (SELECT outlet FROM m)) GROUP BY 1""", {"m": BUDGET_MAP}))
def skipped_lines(spark, sf):
    r = _budgets(spark, sf)[1].select("grid_id", "row_number", "reason").distinct()
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


def day_target_sheets(spark, sf) -> DataFrame:
    t = X.target_daily(spark, X.once(spark, sf)).withColumn("grid_id", F.date_format("date", "'daytargets 'yyyy"))
    rows = t.groupBy("grid_id", "date").agg(*[F.max(F.when(F.col("location") == r, F.col("aop"))).cast("string").alias(r) for r in ("ASIA", "EUROPE")])
    rows = rows.withColumn("row_idx", F.datediff("date", F.trunc("date", "YEAR")) + 2)
    g = rows.select("grid_id").distinct()
    head = label_row(g, 1, ["Date", "ASIA", "EUROPE", "Grand Total"], "daytargets.xlsx")
    total = label_row(g, 500, ["Grand Total", "5", "5", "10"], "daytargets.xlsx")
    return stack(head, total, lay(rows, [(0, F.date_format("date", "dd-MM-yyyy")), (1, F.col("ASIA")), (2, F.col("EUROPE")), (3, F.lit("1"))], "daytargets.xlsx"))


@query("g06_daily_targets", with_ctes(["target_daily"], "SELECT location, date, CAST(aop AS DOUBLE) AS aop FROM target_daily"))
def daily_targets(spark, sf):
    return LY.daily_targets(materialise(day_target_sheets(spark, sf)), PLACES)


def outlet_target_sheets(spark, sf, segment: str | None = None) -> DataFrame:
    """Revenue (of one segment, if given) written as daily outlet targets: location and segment banners over outlet columns."""
    rev = X.once(spark, sf).rev.where(F.lit(True) if segment is None else F.col("segment") == segment).withColumn("grid_id", month_id("outlettargets "))
    cols = rev.select("grid_id", "location", "segment", "outlet").distinct().withColumn("col_idx", F.row_number().over(W.partitionBy("grid_id").orderBy("location", "segment", "outlet")))
    first = lambda *k: F.row_number().over(W.partitionBy("grid_id", *k).orderBy("col_idx")) == 1
    c = cols.withColumns({"fl": first("location"), "fs": first("location", "segment")})
    banner = c.select("grid_id", "col_idx", F.explode(F.create_map(F.lit(1), F.when(F.col("fl"), F.col("location")), F.lit(2), F.when(F.col("fs"), F.col("segment")), F.lit(3), F.col("outlet"))).alias("row_idx", "value")).where("value is not null")
    corner = cols.select("grid_id", F.lit(0).alias("col_idx"), F.lit(3).alias("row_idx"), F.lit("Date").alias("value")).distinct()
    end = cols.groupBy("grid_id").agg((F.max("col_idx") + 1).alias("col_idx"))
    total = end.select("grid_id", "col_idx", F.explode(F.create_map(F.lit(1), F.lit("Grand Total"), F.lit(3), F.lit("Grand Total"), F.lit(5), F.lit("77"))).alias("row_idx", "value"))
    day_row = F.datediff("date", F.trunc("date", "MM")) + 4
    data = rev.join(cols, ["grid_id", "location", "segment", "outlet"]).select("grid_id", "col_idx", day_row.alias("row_idx"), text("revenue").alias("value"))
    days = rev.select("grid_id", F.lit(0).alias("col_idx"), day_row.alias("row_idx"), F.date_format("date", "dd/MM/yyyy").alias("value")).distinct()
    out = reduce(DataFrame.unionByName, [x.select("grid_id", F.col("row_idx").cast("int"), F.col("col_idx").cast("int"), "value") for x in (banner, corner, total, data, days)])
    return out.select("grid_id", F.lit("outlettargets.xlsx").alias("source"), F.lit("Sheet1").alias("sheet"), "row_idx", "col_idx", "value")


@query("g07_outlet_day_targets", with_ctes(["rev"], """
SELECT location, segment, outlet, CAST(YEAR(date) AS INT) AS year, CAST(MONTH(date) AS INT) AS month, CAST(SUM(revenue) AS DOUBLE) AS aop FROM rev GROUP BY 1, 2, 3, 4, 5"""))
def outlet_day_targets(spark, sf):
    return LY.outlet_day_targets(materialise(outlet_target_sheets(spark, sf)), PLACES, YEARS)


TRAFFIC_SQL = "SELECT {d} AS date, CAST(NULL AS DATE) AS period_end, 'daily' AS granularity, location, {t} AS terminal, CAST({v} AS DOUBLE) AS traffic FROM traffic_base {g}"


def flat_traffic_sheets(spark, sf) -> DataFrame:
    t = X.once(spark, sf).traffic_base.withColumn("grid_id", month_id("flat "))
    rows = t.withColumn("row_idx", F.row_number().over(W.partitionBy("grid_id").orderBy("date", "location", "terminal")))
    head = label_row(rows.select("grid_id").distinct(), 0, ["Date", "Location", "Terminal", "Traffic"], "flat.csv")
    return stack(head, lay(rows, [(0, F.date_format("date", "dd-MM-yyyy")), (1, F.col("location")), (2, F.col("terminal")), (3, text("traffic"))], "flat.csv"))


@query("g09_flat_traffic", with_ctes(["traffic_base"], TRAFFIC_SQL.format(d="date", t="terminal", v="traffic", g="")))
def flat_traffic(spark, sf):
    return LY.flat_traffic(materialise(flat_traffic_sheets(spark, sf)), PLACES, YEARS)


TERMINALS = {"1-urgent": "T1", "2-high": "T2", "3-medium dep": "T3", "3-medium arr": "T3"}
TERM_SQL = "CASE terminal WHEN '1-URGENT' THEN 'T1' WHEN '2-HIGH' THEN 'T2' WHEN '3-MEDIUM' THEN 'T3' ELSE terminal END"
GROUPS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _cross(t: DataFrame, keys: list[str], label, source: str) -> DataFrame:
    """Rows of a cross-tab: a quarter departs, the rest arrives."""
    at = lambda g, f: F.max(F.when(F.col("terminal") == g, F.col("traffic") * F.lit(f).cast("decimal(3,2)"))).cast("string")
    rows = t.groupBy("grid_id", "sheet", *keys).agg(*[at(g, f).alias(f"{s}{i}") for i, g in enumerate(GROUPS) for s, f in (("d", "0.25"), ("a", "0.75"))])
    rows = rows.withColumn("row_idx", F.row_number().over(W.partitionBy("grid_id").orderBy(*keys)) + 2)
    g = rows.select("grid_id", "sheet").distinct()
    seg, sub = [None], ["Month" if source.startswith("crossmonth") else "Day"]
    for name in GROUPS:
        seg += [name, None]
        sub += ["Dep.", "Arr."]
    seg, sub = seg + ["G.Total"], sub + ["Arr."]
    row = lambda r, ls: lay(g.withColumn("row_idx", F.lit(r)), [(i, F.lit(x)) for i, x in enumerate(ls) if x is not None], source, F.col("sheet"))
    body = lay(rows, [(0, label), *[(1 + 2 * i + j, F.col(f"{s}{i}")) for i in range(5) for j, s in enumerate("da")], (11, F.lit("999"))], source, F.col("sheet"))
    tail = lay(g.withColumn("row_idx", F.lit(900)), [(0, F.lit("Total")), (1, F.lit("1"))], source, F.col("sheet"))
    fiscal = lay(g.withColumn("row_idx", F.lit(899)), [(0, F.lit("Fy24-25")), (1, F.lit("1"))], source, F.col("sheet"))
    return stack(row(1, seg), row(2, sub), body, fiscal, tail)


def cross_month_sheets(spark, sf) -> DataFrame:
    t = X.once(spark, sf).traffic_base.groupBy(F.trunc("date", "MM").alias("month"), "location", "terminal").agg(F.sum("traffic").alias("traffic"))
    t = t.withColumns({"grid_id": F.concat(F.lit("crossmonth "), "location"), "sheet": F.concat(F.lit("Traffic "), "location")})
    return _cross(t, ["month"], F.date_format("month", "MMM-yyyy"), "crossmonth.xlsx")


def cross_day_sheets(spark, sf) -> DataFrame:
    t = X.once(spark, sf).traffic_base.withColumns({"grid_id": F.concat(F.lit("crossday "), "location", F.date_format("date", " yyyy-MM")),
                                              "sheet": F.concat("location", F.date_format("date", "' Traffic 'MMM yyyy"))})
    return _cross(t, ["date"], F.dayofmonth("date").cast("string"), "crossday.xlsx")


@query("g10_cross_tab_monthly", with_ctes(["traffic_base"], f"""
SELECT CAST(DATE_TRUNC('month', date) AS DATE) AS date, LAST_DAY(date) AS period_end, 'monthly' AS granularity, location, {TERM_SQL} AS terminal, CAST(SUM(traffic) AS DOUBLE) AS traffic
FROM traffic_base GROUP BY 1, 2, 3, 4, 5"""))
def cross_tab_monthly(spark, sf):
    return LY.cross_tab_traffic(materialise(cross_month_sheets(spark, sf)), PLACES, TERMINALS, YEARS)


@query("g10_cross_tab_daily", with_ctes(["traffic_base"], TRAFFIC_SQL.format(d="date", t=TERM_SQL, v="traffic", g="")))
def cross_tab_daily(spark, sf):
    return LY.cross_tab_traffic(materialise(cross_day_sheets(spark, sf)), PLACES, TERMINALS, YEARS)


KIND_SQL = "CASE WHEN terminal IN ('1-URGENT', '2-HIGH') THEN 'International' ELSE 'Domestic' END"


def by_kind(spark, sf) -> DataFrame:
    """Day rows with domestic / international arrivals and departures as texts."""
    t = X.once(spark, sf).traffic_base
    kind = F.when(F.col("terminal").isin("1-URGENT", "2-HIGH"), "International").otherwise("Domestic")
    per = t.groupBy("date", "location", kind.alias("kind")).agg(F.sum("traffic").alias("x"))
    at = lambda k, f: F.max(F.when(F.col("kind") == k, F.col("x") * F.lit(f).cast("decimal(3,2)"))).cast("string")
    return per.groupBy("date", "location").agg(at("Domestic", "0.25").alias("da"), at("Domestic", "0.75").alias("dd"), at("International", "0.25").alias("ia"), at("International", "0.75").alias("id"))


KINDS_SQL = TRAFFIC_SQL.format(d="date", t=KIND_SQL, v="SUM(traffic)", g="GROUP BY 1, 2, 3, 4, 5")


def side_by_side_sheets(spark, sf) -> DataFrame:
    """Two sections per sheet: the year before (made of ones) on the left, the month itself on the right."""
    t = by_kind(spark, sf).withColumns({"grid_id": F.concat(F.lit("sides "), "location", F.date_format("date", " yyyy-MM")), "sheet": F.concat(F.lit("Dom-Int "), "location"),
                                       "row_idx": F.dayofmonth("date") + 3})
    g = t.select("grid_id", "sheet", F.trunc("date", "MM").alias("m")).distinct()
    row = lambda r, ls: lay(g.withColumn("row_idx", F.lit(r)), [(i, x if not isinstance(x, str) else F.lit(x)) for i, x in ls], "sides.xlsx", F.col("sheet"))
    both = lambda ls: ls + [(i + 9, x) for i, x in ls]
    top = row(0, [(0, F.date_format(F.add_months("m", -12), "yyyy-MM-dd")), (9, F.date_format("m", "yyyy-MM-dd"))])
    types = row(1, both([(1, "Domestic"), (5, "International")]))
    metric = row(2, both([(0, "Date"), (1, "PAX"), (3, "Flights"), (5, "PAX"), (7, "Flights")]))
    ad = row(3, both([(i, "Arrival" if i % 2 else "Dep.") for i in range(1, 9)]))
    day = F.dayofmonth("date").cast("string")
    one = F.lit("1")
    left = [(0, day)] + [(i, one) for i in range(1, 9)]
    right = [(9, day), (10, F.col("da")), (11, F.col("dd")), (12, one), (13, one), (14, F.col("ia")), (15, F.col("id")), (16, one), (17, one)]
    return stack(top, types, metric, ad, lay(t, left + right, "sides.xlsx", F.col("sheet")))


@query("g11_g13_typed_traffic", with_ctes(["traffic_base"], KINDS_SQL))
def typed_traffic(spark, sf):
    return LY.typed_traffic(materialise(side_by_side_sheets(spark, sf)), PLACES, "latest", YEARS)


def transposed_sheets(spark, sf) -> DataFrame:
    """Days across: domestic rows, a gap, international rows."""
    t = by_kind(spark, sf).withColumns({"grid_id": F.concat(F.lit("across "), "location", F.date_format("date", " yyyy-MM")), "sheet": F.col("location")})
    # The layout tells types apart by block order only, so both blocks must be there.
    enough = t.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"), F.count("da").alias("d"), F.count("ia").alias("i")).where("n >= 3 and d > 0 and i > 0").select("grid_id")
    t = t.join(enough, "grid_id", "left_semi")
    g = t.select("grid_id", "sheet").distinct()
    row = lambda r, ls: lay(g.withColumn("row_idx", F.lit(r)), [(i, F.lit(x)) for i, x in ls], "across.xlsx", F.col("sheet"))
    col = F.dayofmonth("date") + 1
    heads = [row(1, [(1, "Domestic"), (5, "International")]), row(2, [(0, "Date"), (1, "PAX"), (3, "Flights"), (5, "PAX"), (7, "Flights")]), row(3, [(i, "Arrival" if i % 2 else "Dep.") for i in range(1, 9)])]
    line = lambda r, v: lay(t.withColumn("row_idx", F.lit(r)), [(col, v)], "across.xlsx", F.col("sheet"))
    total = row(5, [(40, "Total (MTD)")])
    return stack(*heads, line(5, F.date_format("date", "yyyy-MM-dd")), total, line(6, F.col("da")), line(7, F.col("dd")), line(9, F.col("ia")), line(10, F.col("id")))


@query("g12_r05_transposed_traffic", with_ctes(["traffic_base"], f"""
SELECT k.* FROM ({KINDS_SQL}) k JOIN (SELECT location, DATE_TRUNC('month', date) AS m FROM traffic_base GROUP BY 1, 2 HAVING COUNT(DISTINCT date) >= 3 AND COUNT(DISTINCT {KIND_SQL}) = 2) e
ON e.location = k.location AND e.m = DATE_TRUNC('month', k.date)"""))
def transposed_traffic(spark, sf):
    return LY.transposed_traffic(materialise(transposed_sheets(spark, sf)), PLACES, YEARS)


def export_sheets(spark, sf) -> DataFrame:
    t = by_kind(spark, sf).withColumns({"grid_id": F.concat(F.lit("export "), "location"), "sheet": F.col("location"), "row_idx": F.datediff("date", F.lit("1994-12-31"))})
    g = t.select("grid_id", "sheet").distinct()
    head = label_row(g, 0, ["DATE", "DOM_ARR_PAX", "DOM_DEP_PAX", "DOM_TOTAL_PAX", "INT_ARR_PAX", "INT_DEP_PAX"], "export.csv", F.col("sheet"))
    return stack(head, lay(t, [(0, F.date_format("date", "yyyy-MM-dd")), (1, F.col("da")), (2, F.col("dd")), (3, F.lit("5")), (4, F.col("ia")), (5, F.col("id"))], "export.csv", F.col("sheet")))


@query("g14_r07_flat_export", with_ctes(["traffic_base"], KINDS_SQL))
def flat_export(spark, sf):
    return LY.flat_export(materialise(export_sheets(spark, sf)), PLACES, YEARS)


def corpus(spark, sf) -> DataFrame:
    sf = X.once(spark, sf)
    return stack(*[f(spark, sf) for f in (long_sheets, pivot_sheets, stacked_sheets, budget_sheets, day_target_sheets, outlet_target_sheets,
                                          flat_traffic_sheets, cross_month_sheets, cross_day_sheets, side_by_side_sheets, export_sheets)])


_LAYOUTS = {"long": ("long_revenue", "revenue"), "pivot": ("wide_pivot", "revenue"), "stacked": ("stacked_blocks", "revenue"), "budget": ("monthly_targets", "target"),
            "daytargets": ("daily_targets", "target"), "outlettargets": ("outlet_day_targets", "target"), "flat": ("flat_traffic", "traffic"),
            "crossmonth": ("cross_tab", "traffic"), "crossday": ("cross_tab", "traffic"), "sides": ("typed_traffic", "traffic"), "export": ("flat_export", "traffic")}
_COUNTS = {
    "long": "SELECT COUNT(DISTINCT DATE_TRUNC('month', date)) AS n FROM rev", "pivot": "SELECT COUNT(DISTINCT DATE_TRUNC('month', date)) FROM rev",
    "stacked": "SELECT COUNT(DISTINCT YEAR(date)) FROM rev", "budget": "SELECT COUNT(DISTINCT year) FROM target_monthly", "daytargets": "SELECT COUNT(DISTINCT YEAR(date)) FROM target_daily",
    "outlettargets": "SELECT COUNT(DISTINCT DATE_TRUNC('month', date)) FROM rev", "flat": "SELECT COUNT(DISTINCT DATE_TRUNC('month', date)) FROM traffic_base",
    "crossmonth": "SELECT COUNT(DISTINCT location) FROM traffic_base", "crossday": "SELECT COUNT(DISTINCT (location, DATE_TRUNC('month', date))) FROM traffic_base",
    "sides": "SELECT COUNT(DISTINCT (location, DATE_TRUNC('month', date))) FROM traffic_base", "export": "SELECT COUNT(DISTINCT location) FROM traffic_base",
}


@query("s21_g08_route_grids", with_ctes(["rev", "traffic_base", "target_monthly", "target_daily"], " UNION ALL ".join(
    f"SELECT '{k}' AS kind, '{la}' AS layout, '{r}' AS route, ({_COUNTS[k]}) AS grids" for k, (la, r) in _LAYOUTS.items())))
def route_grids(spark, sf):
    kinds = LY.grid_kinds(materialise(corpus(spark, sf)), PLACES, YEARS)
    return kinds.groupBy(F.split("grid_id", " ")[0].alias("kind"), "layout", "route").agg(F.count(F.lit(1)).alias("grids"))


# Layouts in the order of preference, the last one first.
_PREFERRED = f"""
SELECT *, ROW_NUMBER() OVER (PARTITION BY date, location, terminal, granularity ORDER BY o DESC) AS n FROM (
  SELECT 0 AS o, 'flat_traffic' AS layout, k.* FROM ({TRAFFIC_SQL.format(d="date", t="terminal", v="traffic", g="")}) k
  UNION ALL SELECT 1, 'cross_tab', k.* FROM ({TRAFFIC_SQL.format(d="date", t=TERM_SQL, v="traffic", g="")}) k
  UNION ALL SELECT 1, 'cross_tab', CAST(DATE_TRUNC('month', date) AS DATE), LAST_DAY(date), 'monthly', location, {TERM_SQL}, CAST(SUM(traffic) AS DOUBLE) FROM traffic_base GROUP BY 3, 4, 6, 7
  UNION ALL SELECT 2, 'typed_traffic', k.* FROM ({KINDS_SQL}) k
  UNION ALL SELECT 3, 'transposed_traffic', k.* FROM ({KINDS_SQL}) k JOIN across a ON a.location = k.location AND a.m = DATE_TRUNC('month', k.date)
  UNION ALL SELECT 4, 'flat_export', k.* FROM ({KINDS_SQL}) k WHERE YEAR(date) % 2 = 0)"""


def two_kind_sheets(spark, sf) -> DataFrame:
    """Two tables of the same month side by side, domestic on the left, international on the right."""
    t = by_kind(spark, sf).withColumns({"grid_id": F.concat(F.lit("kinds "), "location", F.date_format("date", " yyyy-MM")), "sheet": F.col("location"), "row_idx": F.dayofmonth("date") + 3})
    g = t.select("grid_id", "sheet", F.trunc("date", "MM").alias("m")).distinct()
    row = lambda r, ls: lay(g.withColumn("row_idx", F.lit(r)), [(i, x if not isinstance(x, str) else F.lit(x)) for i, x in ls], "kinds.xlsx", F.col("sheet"))
    top = row(0, [(0, F.date_format("m", "yyyy-MM-dd")), (4, F.date_format("m", "yyyy-MM-dd"))])
    heads = [row(1, [(1, "Domestic"), (5, "International")]), row(2, [(0, "Date"), (1, "PAX"), (4, "Date"), (5, "PAX")]), row(3, [(1, "Arrival"), (2, "Dep."), (5, "Arrival"), (6, "Dep.")])]
    day = F.dayofmonth("date").cast("string")
    return stack(top, *heads, lay(t, [(0, day), (1, F.col("da")), (2, F.col("dd")), (4, day), (5, F.col("ia")), (6, F.col("id"))], "kinds.xlsx", F.col("sheet")))


@query("g13_two_kinds", with_ctes(["traffic_base"], KINDS_SQL))
def two_kinds(spark, sf):
    return LY.typed_traffic(materialise(two_kind_sheets(spark, sf)), PLACES, "same month", YEARS)


@query("g15_all_traffic", with_ctes(["traffic_base"], """
SELECT date, period_end, granularity, location, terminal, traffic, layout FROM p WHERE n = 1""", {
    "across": f"SELECT location, DATE_TRUNC('month', date) AS m FROM traffic_base GROUP BY 1, 2 HAVING COUNT(DISTINCT date) >= 3 AND COUNT(DISTINCT {KIND_SQL}) = 2", "p": _PREFERRED}))
def all_traffic(spark, sf):
    """All traffic layouts, transposed sheets and tables side by side included, all years; the export holds the even years alone."""
    sf = X.once(spark, sf)
    exports = export_sheets(spark, sf)
    even = exports.where("col_idx = 0 and row_idx > 0 and cast(substring(value, 1, 4) as int) % 2 = 1").select("grid_id", "row_idx")
    exports = exports.join(even, ["grid_id", "row_idx"], "left_anti")
    parts = [f(spark, sf) for f in (flat_traffic_sheets, cross_month_sheets, cross_day_sheets, side_by_side_sheets, two_kind_sheets, transposed_sheets)]
    cells = materialise(stack(*parts, exports))
    return LY.all_traffic(cells, PLACES, TERMINALS, LY.grid_kinds(cells, PLACES, YEARS), YEARS)[0].select(*LY.TRAFFIC, "layout")
