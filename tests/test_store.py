from __future__ import annotations

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from sitemetrics.sources import store as ST
from sitemetrics.streaming.ingest import distinct_events, file_source, ingest_stream

D = dt.date
AT = dt.datetime(2026, 7, 6, 12)
REV = "date string, segment string, outlet string, location string, pax string, revenue string"


def batch(spark, rows):
    return spark.createDataFrame(rows, REV)


def test_repeated_load_adds_nothing(spark):
    root = tempfile.mkdtemp(prefix="store-")
    first = batch(spark, [("2026-07-05", " Lounges ", "A", "North", "10", "100.5"), ("2026-07-05", "Lounges", "A", "North", "99", "999"), ("2026-08-01", "Spa", "B", "South", "x", "50")])
    counts = ST.load(spark, root, ST.REVENUE, ST.clean_revenue(first), "a.csv", AT, F.asc("revenue")).collect()[0]
    assert (counts["inserted"], counts["skipped"], counts["total_rows"]) == (2, 1, 3)
    again = ST.load(spark, root, ST.REVENUE, ST.clean_revenue(first), "a.csv", AT + dt.timedelta(1)).collect()[0]
    assert (again["inserted"], again["skipped"]) == (0, 3)
    more = batch(spark, [("2026-07-05", "Lounges", "A", "North", "1", "1"), ("2026-07-06", "Lounges", "A", "North", "5", "5")])
    ST.load(spark, root, ST.REVENUE, ST.clean_revenue(more), "b.csv", AT + dt.timedelta(2))
    stored = {(r["date"], r["outlet"]): (r["revenue"], r["pax"], r["source_file"]) for r in ST.read_table(spark, root, ST.REVENUE).collect()}
    assert stored == {(D(2026, 7, 5), "A"): (100.5, 10.0, "a.csv"), (D(2026, 8, 1), "B"): (50.0, None, "a.csv"), (D(2026, 7, 6), "A"): (5.0, 5.0, "b.csv")}
    log = [(r["file_name"], r["row_count"], r["primary_total"]) for r in ST.history(spark, root).collect()]
    assert log == [("b.csv", 1, 5.0), ("a.csv", 0, 0.0), ("a.csv", 2, 150.5)]


def test_retag_touches_only_outdated_months(spark):
    root = tempfile.mkdtemp(prefix="store-")
    ST.load(spark, root, ST.REVENUE, ST.clean_revenue(batch(spark, [("2026-07-05", "Old", "A", "North", "1", "1"), ("2026-08-05", "New", "A", "North", "1", "1")])), "a", AT)
    rules = spark.createDataFrame([("old", None, "New", "Old")], "raw_segment string, outlet_key string, segment string, business_unit string")
    assert [r["year_month"] for r in ST.retag_segments(spark, root, rules).collect()] == [202607]
    got = {r["date"]: (r["segment"], r["business_unit"]) for r in ST.read_table(spark, root, ST.REVENUE).collect()}
    assert got == {D(2026, 7, 5): ("New", "Old"), D(2026, 8, 5): ("New", "New")}


def test_targets_and_traffic_cleaning(spark):
    t = spark.createDataFrame([("A", "x", 2026, 7, "5"), ("A", "x", 2026, 8, "bad")], "location string, outlet string, year int, month int, aop string")
    assert [r["segment"] for r in ST.clean_monthly(t, "Main").collect()] == ["Main"]
    root = tempfile.mkdtemp(prefix="store-")
    assert ST.load(spark, root, ST.TARGET_MONTHLY, ST.clean_monthly(t, "Main"), "t", AT).collect()[0]["inserted"] == 1
    assert ST.read_table(spark, root, ST.TARGET_MONTHLY).count() == 1
    assert ST.for_range(ST.read_table(spark, root, ST.TRAFFIC), D(2026, 1, 1), D(2026, 2, 1)).count() == 0


def test_stream_replay_and_late_files(spark):
    root, inbox = tempfile.mkdtemp(prefix="store-"), tempfile.mkdtemp(prefix="inbox-")
    schema = "date date, location string, traffic double"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
    run = lambda: ingest_stream(file_source(spark, inbox, schema), root, ST.TRAFFIC, ST.clean_traffic, f"{root}/cp", "in").awaitTermination()
    put([(D(2026, 7, 5), "A", 10.0), (D(2026, 7, 6), "A", 20.0)])
    run()
    put([(D(2026, 7, 5), "A", 99.0), (D(2026, 7, 1), "A", 5.0)])
    run()
    run()
    got = {r["date"].day: r["traffic"] for r in ST.read_table(spark, root, ST.TRAFFIC).collect()}
    assert got == {5: 10.0, 6: 20.0, 1: 5.0}


def test_distinct_events_keeps_bounded_state(spark):
    e = spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.col("value").alias("k"))
    assert distinct_events(e, ["k"], "ts", "1 hour").isStreaming


@pytest.mark.parametrize("picks,n", [([], 2), (["A"], 1)])
def test_selection(spark, picks, n):
    from sitemetrics.operators.select import selected

    assert selected(spark.createDataFrame([("A",), ("B",)], "location string"), "location", picks).count() == n
