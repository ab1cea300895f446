"""Whole corpora: files of all layouts to stored rows, with rejects and an audit row for each file."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitemetrics.operators.reuse import stage_path, written
from sitemetrics.plans import layouts as LY
from sitemetrics.sources import corpus as CO
from sitemetrics.sources import store as ST
from sitemetrics.workload import facts as X
from sitemetrics.workload import sheets as SH
from sitemetrics.workload.facts import with_ctes
from sitemetrics.workload.registry import query
from sitemetrics.workload.sheets import CELL, PAIRS, PLACES, TERMINALS, YEARS, label_row, lay, month_id, stack, text

AT = dt.datetime(2024, 1, 1)
#: Files in the order in which they are delivered. The last three fail: a note without any table, a workbook whose budget sheet holds no
#: figure (its revenue sheet must not be stored either), and a long sheet without a readable date.
DELIVERED = [
    "long.csv", "pivot.xlsx", "stacked.xlsx", "detail.pdf", "budget.xlsx", "daytargets.xlsx", "outlettargets.xlsx", "flat.csv", "crossmonth.xlsx", "crossday.xlsx",
    "sides.xlsx", "across.xlsx", "export.csv", "note.txt", "halfdone.xlsx", "nodates.csv",
]
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def rules(spark, sf) -> CO.Rules:
    return CO.Rules(
        places=PLACES, terminals=TERMINALS, years=YEARS, site_columns=PAIRS, block_units={f"{s.lower()} group": s for s in SEGMENTS}, first_unit=SEGMENTS[0],
        unit_segments={"lounge": "Lounges"}, unit_map=SH.unit_map(spark, sf))


def failing_sheets(spark, sf) -> DataFrame:
    """One sheet per month and kind, so that the failing files grow with the data as well."""
    rev = X.once(spark, sf).rev
    months = rev.select(F.trunc("date", "MM").alias("m")).distinct()
    note = lay(months.select(F.concat(F.lit("note "), text("m")).alias("grid_id"), F.lit(0).alias("row_idx")), [(0, F.lit("Please find the reports attached"))], "note.txt")
    w = W.partitionBy("grid_id").orderBy("date", "segment", "outlet", "location")
    columns = lambda day: [(0, day), (1, F.col("location")), (2, F.col("segment")), (3, F.concat(F.lit("Ghost "), "outlet")), (4, text("pax")), (5, text("revenue"))]
    names = ["Date", "Location", "Business", "Sub-Business", "PAX", "Revenue"]
    good = rev.where(F.year("date") % 3 == 0).withColumn("grid_id", month_id("halfdone ")).withColumn("row_idx", F.row_number().over(w))
    half = stack(label_row(good.select("grid_id").distinct(), 0, names, "halfdone.xlsx"), lay(good, columns(F.date_format("date", "dd/MM/yyyy")), "halfdone.xlsx"))
    years = rev.select(F.concat(F.lit("halfbudget "), F.year("date").cast("string")).alias("grid_id")).distinct()
    budget = label_row(years, 0, ["Geographical Segment", "Business Segment", "Unit-ID", "01-01-2001"], "halfdone.xlsx")
    empty = label_row(years, 1, ["ASIA", "Lounge", "U none", "to be decided"], "halfdone.xlsx")
    bad = rev.where(F.year("date") % 3 == 1).withColumn("grid_id", month_id("nodates ")).withColumn("row_idx", F.row_number().over(w))
    undated = stack(label_row(bad.select("grid_id").distinct(), 0, names, "nodates.csv"), lay(bad, columns(F.lit("soon")), "nodates.csv"))
    return stack(note, half, budget, empty, undated)


def delivered_corpus(spark, sf) -> DataFrame:
    """All layouts. Long sheets come first and hold the even months; the other revenue and traffic layouts share the years among them, but for
    monthly cross-tabs and the export, which hold all. Outlet targets are those of one segment."""
    sf = X.once(spark, sf)
    even = SH.long_sheets(spark, sf).where(F.substring("grid_id", -2, 2).cast("int") % 2 == 0)
    year = F.regexp_extract("grid_id", "([0-9]{4})", 1).cast("int")
    of_years = lambda f, k: f(spark, sf).where(year % 3 == k)
    parts = [even, SH.outlet_target_sheets(spark, sf, "BUILDING"), failing_sheets(spark, sf), *[f(spark, sf) for f in (SH.budget_sheets, SH.day_target_sheets, SH.cross_month_sheets, SH.export_sheets)], *[
        of_years(f, k) for f, k in ((SH.pivot_sheets, 0), (SH.stacked_sheets, 1), (SH.sectioned_sheets, 2), (SH.flat_traffic_sheets, 0), (SH.cross_day_sheets, 1), (SH.side_by_side_sheets, 2), (SH.transposed_sheets, 2))]]
    order = F.array_position(F.array(*[F.lit(n) for n in DELIVERED]), F.col("source"))
    return stack(*parts).select(*CELL, F.timestamp_seconds(order * 60).alias("delivered"))


# Per file: rows read (one per key of the file), rows inserted, and what they add up to.
MONTH = "CAST(DATE_TRUNC('month', date) AS DATE)"
FILE_ROWS = {
    "rv": f"""
SELECT 'long.csv' AS f, date, segment, outlet, location, pax, revenue FROM rev WHERE MONTH(date) % 2 = 0
UNION ALL SELECT 'pivot.xlsx', date, segment, outlet, location, pax, revenue FROM rev WHERE YEAR(date) % 3 = 0
UNION ALL SELECT 'stacked.xlsx', date, 'Main', segment || ' ' || outlet, location, pax, revenue FROM rev WHERE YEAR(date) % 3 = 1
UNION ALL SELECT 'detail.pdf', date, segment, outlet, location, pax, revenue FROM rev WHERE YEAR(date) % 3 = 2""",
    "tr": f"""
SELECT 'flat.csv' AS f, date, location, terminal, 'daily' AS granularity, traffic FROM traffic_base WHERE YEAR(date) % 3 = 0
UNION ALL SELECT 'crossmonth.xlsx', {MONTH}, location, {SH.TERM_SQL}, 'monthly', SUM(traffic) FROM traffic_base GROUP BY 1, 2, 3, 4
UNION ALL SELECT 'crossday.xlsx', date, location, {SH.TERM_SQL}, 'daily', traffic FROM traffic_base WHERE YEAR(date) % 3 = 1
UNION ALL SELECT 'sides.xlsx', date, location, {SH.KIND_SQL}, 'daily', SUM(traffic) FROM traffic_base WHERE YEAR(date) % 3 = 2 GROUP BY 1, 2, 3, 4
UNION ALL SELECT 'across.xlsx', k.date, k.location, k.terminal, 'daily', k.traffic FROM ({SH.KINDS_SQL}) k JOIN across a ON a.location = k.location AND a.m = DATE_TRUNC('month', k.date) WHERE YEAR(k.date) % 3 = 2
UNION ALL SELECT 'export.csv', date, location, {SH.KIND_SQL}, 'daily', SUM(traffic) FROM traffic_base GROUP BY 1, 2, 3, 4""",
    "tm": """
SELECT 'budget.xlsx' AS f, location, m.target AS outlet, CAST(year AS INT) AS year, CAST(month AS INT) AS month, CAST(SUM(aop) AS DOUBLE) AS aop FROM target_monthly t JOIN m USING (outlet)
WHERE location <> 'AFRICA' GROUP BY 1, 2, 3, 4, 5
UNION ALL SELECT 'outlettargets.xlsx', location, outlet, CAST(YEAR(date) AS INT), CAST(MONTH(date) AS INT), CAST(SUM(revenue) AS DOUBLE) FROM rev WHERE segment = 'BUILDING' GROUP BY 1, 2, 3, 4, 5""",
}
ACROSS = f"SELECT location, DATE_TRUNC('month', date) AS m FROM traffic_base GROUP BY 1, 2 HAVING COUNT(DISTINCT date) >= 3 AND COUNT(DISTINCT {SH.KIND_SQL}) = 2"
RANK = "list_position([{}], f)".format(", ".join(f"'{n}'" for n in DELIVERED))


def _first(rows: str, key: str) -> str:
    return f"SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY {RANK}) = 1 AS put FROM {rows}"


CORPUS = {
    "m": SH.BUDGET_MAP, "across": ACROSS, **FILE_ROWS, "rvp": _first("rv", "date, segment, outlet, location"), "trp": _first("tr", "date, location, terminal, granularity"),
    "tmp": _first("tm", "location, outlet, year, month"),
}
NEEDS = ["rev", "traffic_base", "target_monthly", "target_daily"]
_PER_FILE = """
SELECT f, 'Revenue' AS load_type, COUNT(*) AS read_rows, CAST(COUNT_IF(put) AS BIGINT) AS inserted, MIN(date) FILTER (put) AS report_date, CAST(SUM(revenue) FILTER (put) AS DOUBLE) AS revenue, 0.0::DOUBLE AS traffic, 0.0::DOUBLE AS target, CAST(SUM(pax) FILTER (put) AS DOUBLE) AS pax FROM rvp GROUP BY f
UNION ALL SELECT f, 'Traffic', COUNT(*), CAST(COUNT_IF(put) AS BIGINT), MIN(date) FILTER (put), 0, CAST(SUM(traffic) FILTER (put) AS DOUBLE), 0, 0 FROM trp GROUP BY f
UNION ALL SELECT f, 'AOP', COUNT(*), CAST(COUNT_IF(put) AS BIGINT), MIN(MAKE_DATE(year, month, 1)) FILTER (put), 0, 0, CAST(SUM(CAST(aop AS DECIMAL(30,8))) FILTER (put) AS DOUBLE), 0 FROM tmp GROUP BY f
UNION ALL SELECT 'daytargets.xlsx', 'AOP', COUNT(*), COUNT(*), MIN(date), 0, 0, CAST(SUM(CAST(CAST(aop AS DOUBLE) AS DECIMAL(30,8))) AS DOUBLE), 0 FROM target_daily"""
_FAILED = """
SELECT 'note.txt' AS f, 'no known layout' AS reason, CAST(0 AS BIGINT) AS read_rows
UNION ALL SELECT 'halfdone.xlsx', 'no usable row in monthly_targets sheet halfbudget ' || MIN(YEAR(date)), COUNT(*) FILTER (YEAR(date) % 3 = 0) FROM rev
UNION ALL SELECT 'nodates.csv', 'no usable row in long_revenue sheet nodates ' || strftime(MIN(date), '%Y-%m'), 0 FROM rev WHERE YEAR(date) % 3 = 1"""
AUDIT_COLUMNS = ["file_name", "status", "reason", "load_type", "read_rows", "inserted", "skipped", "report_date", "revenue", "traffic", "target", "pax"]


@query("s21_ingest_corpus", with_ctes(NEEDS, """
SELECT f AS file_name, 'Available' AS status, CAST(NULL AS VARCHAR) AS reason, CASE WHEN inserted > 0 THEN load_type END AS load_type, read_rows, inserted, read_rows - inserted AS skipped, report_date,
  CAST(COALESCE(revenue, 0) AS DOUBLE) AS revenue, CAST(COALESCE(traffic, 0) AS DOUBLE) AS traffic, CAST(COALESCE(target, 0) AS DOUBLE) AS target, CAST(COALESCE(pax, 0) AS DOUBLE) AS pax FROM pf
UNION ALL SELECT f, 'Failed', reason, NULL, read_rows, 0, 0, NULL, 0, 0, 0, 0 FROM failed""", CORPUS | {"pf": _PER_FILE, "failed": _FAILED}))
def ingest_corpus(spark, sf):
    """One audit row per file; a file that fails stores nothing."""
    sf = X.once(spark, sf)
    return CO.ingest_corpus(spark, stage_path(spark, "corpus-store"), delivered_corpus(spark, sf), rules(spark, sf), "first", AT).select(*AUDIT_COLUMNS)


@query("s21_stored_rows", with_ctes(NEEDS, f"""
SELECT 'revenue' AS name, f AS source_file, date, location, outlet, segment, CAST(revenue AS DOUBLE) AS amount FROM rvp WHERE put
UNION ALL SELECT 'traffic', f, date, location, terminal, granularity, CAST(traffic AS DOUBLE) FROM trp WHERE put
UNION ALL SELECT 'target_monthly', f, MAKE_DATE(year, month, 1), location, outlet, NULL, CAST(aop AS DOUBLE) FROM tmp WHERE put
UNION ALL SELECT 'target_daily', 'daytargets.xlsx', date, location, NULL, NULL, CAST(aop AS DOUBLE) FROM target_daily""", CORPUS))
def stored_rows(spark, sf):
    """What the tables hold after the batch: the file of every row included."""
    root, sf = stage_path(spark, "corpus-store"), X.once(spark, sf)
    CO.ingest_corpus(spark, root, delivered_corpus(spark, sf), rules(spark, sf), "first", AT)
    none = F.lit(None).cast("string")
    read = lambda spec, date, third, fourth: CO.read_committed(spark, root, spec).select(
        F.lit(spec.name).alias("name"), "source_file", date.alias("date"), "location", third.alias("outlet"), fourth.alias("segment"), F.col(spec.measure).alias("amount"))
    return read(ST.REVENUE, F.col("date"), F.col("outlet"), F.col("segment")).unionByName(read(ST.TRAFFIC, F.col("date"), F.col("terminal"), F.col("granularity"))).unionByName(
        read(ST.TARGET_MONTHLY, F.make_date("year", "month", F.lit(1)), F.col("outlet"), none)).unionByName(read(ST.TARGET_DAILY, F.col("date"), none, none))


@query("g10_rejected_cells", with_ctes(["rev", "traffic_base", "target_daily"], f"""
SELECT 'crossmonth.xlsx' AS source, 'column without a meaning' AS reason, COUNT(DISTINCT (location, {MONTH})) AS cells FROM traffic_base
UNION ALL SELECT 'crossmonth.xlsx', 'unreadable date', COUNT(DISTINCT location) FROM traffic_base
UNION ALL SELECT 'crossmonth.xlsx', 'below the first total row', COUNT(DISTINCT location) FROM traffic_base
UNION ALL SELECT 'sides.xlsx', 'table of another month', COUNT(DISTINCT (date, location)) * 8 FROM traffic_base
UNION ALL SELECT 'sides.xlsx', 'no column of customers', COUNT(DISTINCT (date, location)) * 4 FROM traffic_base
UNION ALL SELECT 'daytargets.xlsx', 'column without a meaning', COUNT(DISTINCT date) FROM target_daily
UNION ALL SELECT 'daytargets.xlsx', 'first cell is not a date', COUNT(DISTINCT YEAR(date)) * 3 FROM target_daily
UNION ALL SELECT 'outlettargets.xlsx', 'column without a meaning', COUNT(*) FROM (SELECT DATE_TRUNC('month', date) FROM rev GROUP BY 1 HAVING COUNT_IF(DAY(date) = 2) > 0)
UNION ALL SELECT 'outlettargets.xlsx', 'first cell is not a date', COUNT(*) FROM (SELECT DATE_TRUNC('month', date) FROM rev GROUP BY 1 HAVING COUNT_IF(DAY(date) = 2) = 0)"""))
def rejected_cells(spark, sf):
    """Every value cell of these layouts that became no fact, by reason."""
    sf = X.once(spark, sf)
    cells = written(stack(SH.cross_month_sheets(spark, sf), SH.side_by_side_sheets(spark, sf), SH.day_target_sheets(spark, sf), SH.outlet_target_sheets(spark, sf)), "cells")
    of = lambda name: cells.where(F.col("source") == name)
    parts = {
        "cross_tab": LY.read_cross_tab(of("crossmonth.xlsx"), PLACES, TERMINALS, YEARS), "typed_traffic": LY.read_typed_traffic(of("sides.xlsx"), PLACES, "same month", YEARS),
        "daily_targets": LY.read_daily_targets(of("daytargets.xlsx"), PLACES), "outlet_day_targets": LY.read_outlet_day_targets(of("outlettargets.xlsx"), PLACES, YEARS)}
    lost = LY.lost_cells(parts).join(cells.select("grid_id", "source").distinct(), "grid_id")
    return lost.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("cells"))
