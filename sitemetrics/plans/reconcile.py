"""Daily facts first, prorated longer-period facts for the days they leave open, gaps counted."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemetrics.operators.aggregate import exact
from sitemetrics.operators.select import starting_until, within


def overlapping(traffic: DataFrame, start: dt.date, end: dt.date, location: str | None = None) -> DataFrame:
    """Daily rows inside the range and monthly rows whose span touches it."""
    lo, hi = sorted((start, end))
    daily = (F.col("granularity") == "daily") & within(traffic, lo, hi)
    span_end = F.coalesce("period_end", "date")
    monthly = (F.col("granularity") == "monthly") & (F.col("date") <= F.lit(hi)) & (span_end >= F.lit(lo))
    picked = traffic.where(starting_until(traffic, hi)).where(daily | monthly)
    return picked.where(F.col("location") == location) if location is not None else picked


def _spread(spans: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """One row per (key, day) covered by a span, with the span's per-day share; the latest span wins a day."""
    days = F.sequence(F.greatest("span_start", lo), F.least("span_end", hi))
    length = F.datediff("span_end", "span_start") + 1
    daily = spans.where("span_end >= span_start").select(
        *keys, F.explode(days).alias("day"), "span_start", "value", length.alias("span_days")
    )
    latest = F.max_by(F.struct("value", "span_days", "span_start"), "span_start").alias("s")
    return daily.groupBy(*keys, "day").agg(latest).select(*keys, "day", "s.*")


def reconcile(
    daily: DataFrame, spans: DataFrame, keys: list[str], start: dt.date, end: dt.date, out: str
) -> DataFrame:
    """Best total per key over a closed range.

    ``daily``: keys, day, value (several rows per day add up). ``spans``: keys, span_start, span_end, value.
    Days with a daily row use it; other days take value / days(span) of the span covering them; days with
    neither are counted. Spans are expanded to days, so everything is an equi-aggregate on (keys, day).
    """
    lo, hi = sorted((start, end))
    n_days = (hi - lo).days + 1
    in_range = daily.where(F.col("day").between(F.lit(lo), F.lit(hi)))
    per_day = in_range.groupBy(*keys, "day").agg(F.sum("value").alias("daily"))
    touching = spans.where((F.col("span_start") <= F.lit(hi)) & (F.col("span_end") >= F.lit(lo)))
    filler = _spread(touching, keys, F.lit(lo), F.lit(hi))
    none = lambda t: F.lit(None).cast(t)
    value_type = dict(per_day.dtypes)["daily"]
    marked = per_day.select(
        *keys, "day", "daily", F.lit(True).alias("has_daily"), none("decimal(38,8)").alias("value"),
        none("int").alias("span_days"),
    ).unionByName(
        filler.select(
            *keys, "day", none(value_type).alias("daily"), F.lit(False).alias("has_daily"),
            F.col("value").cast("decimal(38,8)").alias("value"), "span_days",
        )
    )
    # One row per (key, day): the daily figure if there is one, else its span.
    day_rows = marked.groupBy(*keys, "day").agg(
        F.bool_or("has_daily").alias("has_daily"), F.max("daily").alias("daily"),
        F.max("value").alias("value"), F.max("span_days").alias("span_days")
    )
    # Open days are summed exactly per span length and divided once, shortest spans first,
    # so the result does not depend on row order. There are only a few span lengths.
    open_day = ~F.col("has_daily")
    per_length = (
        day_rows.withColumns({c: F.when(open_day, F.col(c)) for c in ("span_days", "value")})
        .groupBy(*keys, "span_days")
        .agg(F.sum("daily").alias("daily"), F.sum("value").alias("value"), F.count(F.lit(1)).alias("days"))
    )
    parts = F.array_sort(F.collect_list(F.when(F.col("span_days").isNotNull(), F.struct("span_days", "value"))))
    filled = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["value"].cast("double") / p["span_days"])
    return per_length.groupBy(*keys).agg(
        F.coalesce(F.sum("daily"), F.lit(0)).cast("double").alias("daily"), parts.alias("parts"), F.sum("days").alias("days"),
    ).select(
        *keys, (F.col("daily") + filled).alias(out), (F.size("parts") > 0).alias("is_estimated"),
        (F.lit(n_days) - F.col("days")).cast("int").alias("missing_days"),
    )


def traffic_total(traffic: DataFrame, start: dt.date, end: dt.date, location: str | None = None) -> DataFrame:
    """Best visitor total per (location, terminal) with an estimate flag and the number of uncovered days."""
    t = overlapping(traffic, start, end, location).withColumn("value", exact(traffic, "traffic"))
    keys = ["location", "terminal"]
    daily = t.where("granularity = 'daily'").select(*keys, F.col("date").alias("day"), "value")
    spans = t.where("granularity = 'monthly'").select(
        *keys, F.col("date").alias("span_start"), F.coalesce("period_end", "date").alias("span_end"), "value"
    )
    return reconcile(daily, spans, keys, start, end, "traffic")


def targets_touching(monthly: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Monthly targets of every month the range touches."""
    lo, hi = sorted((start, end))
    n = F.col("year") * 12 + F.col("month")
    return monthly.where(F.col("year").between(lo.year, hi.year)).where(n.between(lo.year * 12 + lo.month, hi.year * 12 + hi.month))


def targets_of_month(monthly: DataFrame, year: int, month: int) -> DataFrame:
    return monthly.where((F.col("year") == year) & (F.col("month") == month))


def target_total(
    daily: DataFrame, monthly: DataFrame, start: dt.date, end: dt.date, location: str | None = None
) -> DataFrame:
    """Best target per location: daily targets, then outlet months summed and prorated for open days."""
    keys = ["location"]
    d = daily.where(within(daily, start, end)).select("location", F.col("date").alias("day"), exact(daily, "aop").alias("value"))
    picked = targets_touching(monthly, start, end)
    first = F.make_date("year", "month", F.lit(1))
    m = (
        picked.groupBy("location", "year", "month").agg(F.sum(exact(monthly, "aop")).alias("value"))
        .select("location", first.alias("span_start"), F.last_day(first).alias("span_end"), "value")
    )
    if location is not None:
        d, m = d.where(F.col("location") == location), m.where(F.col("location") == location)
    return reconcile(d, m, keys, start, end, "aop_target")


def coverage_gaps(facts: DataFrame, totals: DataFrame) -> DataFrame:
    """Locations with facts whose visitor total is absent, estimated or incomplete."""
    per_location = totals.groupBy("location").agg(
        F.bool_or("is_estimated").alias("is_estimated"), F.sum("missing_days").alias("missing_days")
    )
    sites = facts.select("location").distinct().join(per_location, "location", "left")
    return sites.select(
        "location", F.col("missing_days").isNull().alias("no_traffic"),
        F.coalesce("is_estimated", F.lit(False)).alias("is_estimated"),
        F.coalesce("missing_days", F.lit(0)).alias("missing_days"),
    )


def missing_days(facts: DataFrame, keys: list[str], start: dt.date, end: dt.date) -> DataFrame:
    """Calendar days of the range without a row, per key present in the facts.

    The calendar is generated per key and the covered days are removed by an anti join on (key, day).
    """
    lo, hi = sorted((start, end))
    seen = facts.where(within(facts, lo, hi)).select(*keys, "date").distinct()
    calendar = seen.select(*keys).distinct().withColumn("date", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    return calendar.join(seen, [*keys, "date"], "left_anti")
