from __future__ import annotations

import calendar
import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sitemetrics.plans import allocate as A
from sitemetrics.plans import reconcile as R

D = dt.date
TRAFFIC = "date date, period_end date, granularity string, location string, terminal string, traffic double"


def month_row(y, m, loc, term, v):
    return (D(y, m, 1), D(y, m, calendar.monthrange(y, m)[1]), "monthly", loc, term, v)


def brute(rows, lo, hi):
    """Day by day, the plain way."""
    days = [lo + dt.timedelta(i) for i in range((hi - lo).days + 1)]
    out = {}
    for key in {(r[3], r[4]) for r in rows}:
        daily, spans = {}, []
        for d, e, g, loc, term, v in rows:
            if (loc, term) != key:
                continue
            if g == "daily" and lo <= d <= hi:
                daily[d] = daily.get(d, 0) + v
            elif g == "monthly" and d <= hi and e >= lo:
                spans.append((d, e, v))
        if not daily and not spans:
            continue
        total, est, gap = sum(daily.values()), False, 0
        for x in days:
            if x in daily:
                continue
            hit = max((s for s in spans if s[0] <= x <= s[1]), default=None)
            if hit:
                est, total = True, total + hit[2] / ((hit[1] - hit[0]).days + 1)
            else:
                gap += 1
        out[key] = (total, est, gap)
    return out


daily_rows = st.tuples(st.integers(0, 89), st.sampled_from(["A", "B"]), st.sampled_from(["", "T1"]), st.integers(1, 500))
month_rows = st.tuples(st.integers(1, 3), st.sampled_from(["A", "B"]), st.sampled_from(["", "T1"]), st.integers(1, 90000))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(daily_rows, min_size=1, max_size=40), st.lists(month_rows, max_size=4, unique_by=lambda r: r[:3]), st.integers(0, 60), st.integers(0, 60))
def test_reconciliation_equals_day_loop(spark, daily, monthly, a, b):
    rows = [(D(2024, 1, 1) + dt.timedelta(d), None, "daily", loc, t, float(v)) for d, loc, t, v in daily]
    rows += [month_row(2024, m, loc, t, float(v)) for m, loc, t, v in monthly]
    x, y = D(2024, 1, 1) + dt.timedelta(a), D(2024, 1, 1) + dt.timedelta(b)
    got = {(r["location"], r["terminal"]): (r["traffic"], r["is_estimated"], r["missing_days"])
           for r in R.traffic_total(spark.createDataFrame(rows, TRAFFIC), x, y).collect()}
    want = brute(rows, *sorted((x, y)))
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0]) and got[k][1:] == want[k][1:]


def test_overlapping_spans_count_once(spark):
    rows = [(D(2024, 1, 1), D(2024, 1, 31), "monthly", "A", "", 310.0), (D(2024, 1, 16), D(2024, 1, 31), "monthly", "A", "", 32.0)]
    r = R.traffic_total(spark.createDataFrame(rows, TRAFFIC), D(2024, 1, 15), D(2024, 1, 16)).collect()[0]
    assert r["traffic"] == pytest.approx(10 + 2) and r["missing_days"] == 0


TOTALS = "location string, terminal string, traffic double, is_estimated boolean, missing_days int"


def test_pool_fallback_label_counts_once(spark):
    totals = spark.createDataFrame([("A", "T3", 100.0, False, 2), ("B", "T3 Dom", 7.0, True, 0), ("B", "T3", 100.0, False, 0), ("C", "", 1000.0, False, 1)], TOTALS)
    pool = spark.createDataFrame([("P", "T3 Dom", "T3", 0.8), ("P", "T3 Int", "T3", 0.2)], "pool string, terminal string, fallback string, site_share double")
    got = {r["location"]: r for r in A.pool_traffic(totals, pool).collect()}
    assert got["A"]["traffic"] == 100.0 and got["A"]["traffic_missing_days"] == 2
    assert got["B"]["traffic"] == 107.0 and got["B"]["traffic_is_estimated"]
    assert got["C"]["traffic"] == 1000.0 and got["C"]["traffic_is_estimated"]


def test_share_adds_up_and_falls_back_to_equal(spark):
    facts = spark.createDataFrame([("A", "x", 30.0), ("A", "y", 70.0), ("B", "x", -5.0), ("B", "y", 5.0)], "location string, outlet string, revenue double")
    site = spark.createDataFrame([("A", 200.0), ("B", 50.0)], "location string, aop_target double")
    got = {(r["location"], r["outlet"]): r["aop_target"] for r in A.target_by_share(facts, site).collect()}
    assert got == {("A", "x"): pytest.approx(60), ("A", "y"): pytest.approx(140), ("B", "x"): 25.0, ("B", "y"): 25.0}
