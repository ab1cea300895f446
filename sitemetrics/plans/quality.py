"""Validation report, duplicate log, canonical cleaning and reject reasons."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import labels as L
from sitemetrics.functions import numbers as NB
from sitemetrics.functions.dates import any_date
from sitemetrics.operators.aggregate import exact
from sitemetrics.operators.ordered import duplicated_rows, keep_one
from sitemetrics.plans.infer import plausible_date, row_reason

KEY = ["date", "segment", "outlet", "location"]
NUMBERS = ["pax", "revenue", "aop", "traffic"]


def parse_totals(rows: DataFrame) -> DataFrame:
    """Rows, revenue, customers and first date of a parsed batch."""
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(exact(rows, "revenue")), F.lit(0)).cast("double").alias("total_revenue"),
        F.coalesce(F.sum(exact(rows, "pax")), F.lit(0)).cast("double").alias("total_pax"), F.min("date").alias("date"))


def canonical(df: DataFrame, order: Column, acronyms: list[str] = ()) -> DataFrame:
    """Canonical revenue rows from any frame with the required columns, whatever their case.

    Labels are trimmed and title-cased, numbers and dates coerced (bad values become NULL), rows without a date or
    without both measures dropped, and the last row per key in ``order`` kept.
    """
    named = df.toDF(*[c.strip().lower() for c in df.columns])
    missing = [c for c in [*KEY, "pax", "revenue"] if c not in named.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    number = lambda c: NB.float_or_null(c) if c in named.columns else F.lit(None).cast("double")
    clean = named.select(
        any_date("date").alias("date"), L.title_case("segment", list(acronyms)).alias("segment"), F.trim("outlet").alias("outlet"),
        L.title_case("location").alias("location"), *[number(c).alias(c) for c in NUMBERS], order.alias("__order"))
    kept = clean.where("date is not null and not (pax is null and revenue is null)")
    return keep_one(kept, KEY, F.desc("__order")).drop("__order")


def validation_report(df: DataFrame, places: list[str], segments: list[str], today: dt.date, groups: list[str] = ()) -> DataFrame:
    """Eight checks as (check, passed, affected, message) rows, in two aggregates: one over rows, one over keys.

    A missing column fails ``required_columns`` and is NULL for the other checks.
    """
    groups = list(groups)
    kinds = {"date": "date", "pax": "double", "revenue": "double"}
    missing = [c for c in [*KEY, "pax", "revenue"] if c not in df.columns]
    df = df.withColumns({c: F.lit(None).cast(kinds.get(c, "string")) for c in missing}) if missing else df
    blank = lambda c: L.is_blank(c)
    per_key = df.groupBy(*groups, *KEY).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("revenue").isNull()).alias("no_revenue"), F.count_if(F.coalesce(F.col("pax") < 0, F.lit(False))).alias("bad_pax"))
    dups = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    times = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    required = [c for c in missing if c != "pax"]
    agg = per_key.groupBy(*groups).agg(
        F.sum("n").alias("rows"), F.lit(len(required)).cast("bigint").alias("required_columns"),
        times(F.col("date").isNull() | ~plausible_date("date", today)).alias("dates"), F.sum("no_revenue").alias("revenue"), F.sum("bad_pax").alias("pax"),
        times(~F.coalesce(F.col("location").isin(places), F.lit(False))).alias("locations"),
        times(~F.coalesce(F.col("segment").isin(segments), F.lit(False))).alias("segments"), times(blank("outlet")).alias("outlets"), dups.alias("duplicates"))
    # Check names and messages.
    texts = {
        "required_columns": "required columns missing", "dates": "rows without a plausible date", "revenue": "rows without revenue", "pax": "rows with negative customers",
        "locations": "rows with an unknown location", "segments": "rows with an unknown segment", "outlets": "rows without an outlet", "duplicates": "rows sharing a key",
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check"), (F.col(k) == 0).alias("passed"), F.col(k).alias("affected"), F.concat(F.col(k).cast("string"), F.lit(f" {t}")).alias("message"))
                     for k, t in texts.items()])
    return agg.select(*groups, F.explode(rows).alias("c")).select(*groups, "c.*")


def validation_summary(report: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Pass flag, failing checks and a summary text."""
    s = report.groupBy(*groups).agg(
        F.bool_and("passed").alias("passed"), F.avg(F.col("passed").cast("int")).alias("pass_rate"),
        F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))).alias("failing"), F.count(F.lit(1)).alias("n"))
    text = F.when(F.col("passed"), "all checks passed").otherwise(F.concat(F.size("failing").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" checks failed: "), F.array_join("failing", ", ")))
    return s.select(*groups, "passed", "pass_rate", "failing", text.alias("summary"))


def duplicate_log(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return duplicated_rows(df, keys)


def reject_counts(rows: DataFrame, today: dt.date, first: dt.date = dt.date(2015, 1, 1)) -> DataFrame:
    """How many rows each reason would reject; accepted rows count under 'accepted'."""
    return rows.withColumn("reason", F.coalesce(row_reason(today, first), F.lit("accepted"))).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
