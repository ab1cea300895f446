"""Store statistics and simple feeds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import dates as D
from sitemetrics.operators.aggregate import exact
from sitemetrics.operators.select import within


def dates_summary(facts: DataFrame) -> DataFrame:
    """Per date: revenue, customers, distinct outlets; newest first."""
    return facts.groupBy("date").agg(
        F.sum(exact(facts, "revenue")).cast("double").alias("total_revenue"),
        F.sum(exact(facts, "pax")).cast("double").alias("total_pax"),
        F.count_distinct("outlet").alias("outlets"),
    ).orderBy(F.desc("date"))


def store_stats(facts: DataFrame) -> DataFrame:
    """Rows, first and last date, number of dates. Dates are reduced first, so no distinct over all rows."""
    per_day = facts.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return per_day.agg(
        F.sum("n").alias("total_rows"), F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.count("date").alias("distinct_dates"),
    )


def available_periods(facts: DataFrame) -> DataFrame:
    """Every date, Monday, month and year that has data, as (unit, start)."""
    days = facts.select("date").distinct()
    units = {"date": F.col("date"), "week": D.week_start("date"), "month": D.month_start("date"), "year": D.year_start("date")}
    pairs = [x for n, c in units.items() for x in (F.lit(n), c)]
    return days.select(F.explode(F.create_map(*pairs)).alias("unit", "start")).distinct()


def available_terminals(traffic: DataFrame) -> DataFrame:
    return traffic.where("terminal is not null and terminal <> ''").select("terminal").distinct().orderBy("terminal")


def target_months(targets: DataFrame) -> DataFrame:
    return targets.select("year", "month").distinct().orderBy("year", "month")


def daily_totals(facts: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return facts.where(within(facts, start, end)).groupBy("date").agg(
        F.sum(exact(facts, "revenue")).cast("double").alias("revenue"), F.sum(exact(facts, "pax")).cast("double").alias("pax")
    ).orderBy("date")


def days_covered(facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.groupBy(*keys).agg(F.count_distinct("date").alias("days"))


def chart_feeds(facts: DataFrame) -> DataFrame:
    """Revenue by segment and by location as (feed, label, revenue), from one reduced table."""
    small = facts.groupBy("segment", "location").agg(F.sum(exact(facts, "revenue")).alias("r"))
    fed = small.select(
        F.explode(F.create_map(F.lit("segment"), F.col("segment"), F.lit("location"), F.col("location"))).alias("feed", "label"), "r"
    )
    return fed.groupBy("feed", "label").agg(F.sum("r").cast("double").alias("revenue")).orderBy("feed", F.desc("revenue"), "label")


def location_union(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("location").distinct()
    for f in frames[1:]:
        out = out.unionByName(f.select("location").distinct())
    return out.distinct()
