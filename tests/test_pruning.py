"""Date-bounded reads of a stored table open only the months that they need."""

from __future__ import annotations

import datetime as dt
import re
import tempfile

import pytest

from sitemetrics.plans import compare, periods, reconcile, stats
from sitemetrics.sources import store as ST

D = dt.date
PAIR = periods.PeriodPair(D(2026, 7, 1), D(2026, 7, 6), D(2026, 6, 1), D(2026, 6, 6))


@pytest.fixture(scope="module")
def root(spark):
    root = tempfile.mkdtemp(prefix="pruning-")
    rev = [(f"2026-{m:02d}-05", "S", "A", "North", "1", "2") for m in range(1, 13)]
    ST.load(spark, root, ST.REVENUE, ST.clean_revenue(spark.createDataFrame(rev, "date string, segment string, outlet string, location string, pax string, revenue string")), "r", dt.datetime(2026, 12, 31))
    tra = [(f"2026-{m:02d}-05", "North", "1") for m in range(1, 13)]
    ST.load(spark, root, ST.TRAFFIC, ST.clean_traffic(spark.createDataFrame(tra, "date string, location string, traffic string")), "t", dt.datetime(2026, 12, 31))
    tgt = [("North", "A", y, 7, "5") for y in (2025, 2026, 2027)]
    ST.load(spark, root, ST.TARGET_MONTHLY, ST.clean_monthly(spark.createDataFrame(tgt, "location string, outlet string, year int, month int, aop string"), "S"), "m", dt.datetime(2026, 12, 31))
    return root


READS = {
    "q01": (ST.REVENUE, lambda t: compare.compare_periods(t, PAIR)),
    "q02": (ST.REVENUE, lambda t: compare.named_comparison(t, {"a": PAIR, "b": PAIR})),
    "q09": (ST.REVENUE, lambda t: compare.multi_period_snapshot(t, {"week": (D(2026, 7, 1), D(2026, 7, 6)), "last_week": (D(2026, 6, 1), D(2026, 6, 6))})),
    "a10": (ST.TRAFFIC, lambda t: reconcile.traffic_total(t, D(2026, 7, 1), D(2026, 7, 31))),
    "a21": (ST.REVENUE, lambda t: stats.daily_totals(t, D(2026, 7, 1), D(2026, 7, 31))),
    "s09": (ST.REVENUE, lambda t: ST.for_date(t, D(2026, 7, 5))),
    "s10": (ST.REVENUE, lambda t: ST.for_dates(t, [D(2026, 7, 5), D(2026, 8, 5)])),
    "s11": (ST.REVENUE, lambda t: ST.for_range(t, D(2026, 8, 1), D(2026, 7, 1))),
    "s12": (ST.TRAFFIC, lambda t: reconcile.overlapping(t, D(2026, 7, 1), D(2026, 7, 31))),
    "s13": (ST.TARGET_MONTHLY, lambda t: reconcile.targets_touching(t, D(2026, 7, 1), D(2026, 7, 31))),
}


@pytest.mark.parametrize("name", READS)
def test_partitions_are_pruned(spark, root, name):
    spec, read = READS[name]
    df = read(ST.read_table(spark, root, spec))
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"PartitionFilters: \[([^\n]*?), PushedFilters", plan)
    assert found and all(spec.partition in f for f in found), plan
    assert df.count() > 0
