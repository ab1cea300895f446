"""One sheet delivered under several file names: its figures count once, and the first delivery stays."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitemetrics.plans import layouts as LY
from sitemetrics.plans import quality
from sitemetrics.sources import files as FS
from sitemetrics.sources import store as ST
from tests.conftest import cells_of

PLACES = {"ridge": "Ridge", "dale": "Dale"}


def daily(amount, blank=0):
    return [*[[""]] * blank, ["Date", "Ridge", "Dale", "Grand Total"], ["04-Jul-2026", amount, amount + 1, 0], ["05-Jul-2026", amount + 2, None, 0]]


def cross(amount, blank=0):
    return [*[[""]] * blank, ["", "Alpha", "", "Beta", ""], ["Month", "Dep", "Arr", "Dep", "Arr"], ["Apr'26", amount, 1, 2, 3]]


def outlet_days(amount, blank=0):
    return [*[[""]] * blank, ["", "Ridge", ""], ["", "Food", ""], ["Date", "Stall", "Bar"], ["04-Jul-2026", amount, 2], ["05-Jul-2026", amount, 3]]


def delivered(spark, sheet, blank=0):
    """The sheet twice, and a changed version that came later."""
    grids = {"g1": ("b.xlsx", "Ridge", sheet(10, blank)), "g2": ("c.xlsx", "Ridge", sheet(10, blank)), "g3": ("a.xlsx", "Ridge", sheet(500, blank))}
    when = F.create_map(*[F.lit(x) for s, d in (("b.xlsx", 1), ("c.xlsx", 2), ("a.xlsx", 3)) for x in (s, d)])
    return cells_of(spark, grids).withColumn("delivered", F.timestamp_seconds(when[F.col("source")]))


@pytest.mark.parametrize("blank", [0, 110])
def test_daily_targets_count_once(spark, blank):
    got = {(r.location, r.date.day): r.aop for r in LY.daily_targets(delivered(spark, daily, blank), PLACES).collect()}
    assert got == {("Ridge", 4): 10, ("Dale", 4): 11, ("Ridge", 5): 12}


@pytest.mark.parametrize("blank", [0, 110])
def test_cross_tab_counts_once(spark, blank):
    got = {r.terminal: r.traffic for r in LY.cross_tab_traffic(delivered(spark, cross, blank), PLACES, {}).collect()}
    assert got == {"Alpha": 11, "Beta": 5}


def test_outlet_day_targets_count_once(spark):
    got = {r.outlet: r.aop for r in LY.outlet_day_targets(delivered(spark, outlet_days, 100), PLACES).collect()}
    assert got == {"Stall": 20, "Bar": 5}


def test_unit_cell_is_found_above_any_header(spark):
    sheet = [[""]] * 30 + [["", 100000]] + daily(3)
    got = {(r.location, r.date.day): r.aop for r in LY.daily_targets(cells_of(spark, {"u": ("u", "s", sheet)}), PLACES).collect()}
    assert got[("Ridge", 4)] == 300000


def test_incomplete_keys_are_rejected_once_per_load(spark, tmp_path):
    rows = [("2026-07-05", "S", "A", "North", "1", "2"), ("no date", "S", "B", "North", "1", "2")]
    batch = ST.clean_revenue(spark.createDataFrame(rows, "date string, segment string, outlet string, location string, pax string, revenue string"))
    for k in range(2):
        ST.load(spark, str(tmp_path), ST.REVENUE, batch, "f", dt.datetime(2026, 7, 6 + k))
    stored = ST.read_table(spark, str(tmp_path), ST.REVENUE)
    assert [r.outlet for r in stored.collect()] == ["A"] and ST.rejects(spark, str(tmp_path)).count() == 2
    derived, logged = ST.derived_history(stored, ST.REVENUE), ST.history(spark, str(tmp_path)).where("row_count > 0")
    assert sorted(map(tuple, derived.collect())) == sorted(map(tuple, logged.select(derived.columns).collect()))


def test_targets_are_stored_by_year(spark, tmp_path):
    rows = spark.createDataFrame([("A", "x", 2025, 7, "5"), ("A", "x", 2026, 7, "6")], "location string, outlet string, year int, month int, aop string")
    for k in range(2):
        ST.load(spark, str(tmp_path), ST.TARGET_MONTHLY, ST.clean_monthly(rows, "S"), "t", dt.datetime(2026, 7, 6 + k))
    assert sorted(p.name for p in (tmp_path / "target_monthly").iterdir() if p.is_dir()) == ["year=2025", "year=2026"]
    assert sorted(r.aop for r in ST.read_table(spark, str(tmp_path), ST.TARGET_MONTHLY).collect()) == [5, 6]


def test_retag_leaves_current_rows_alone(spark, tmp_path):
    rows = [("2026-07-05", "Old", "A", "North", "1", "1"), ("2026-07-06", "New", "A", "North", "1", "1")]
    df = spark.createDataFrame(rows, "date string, segment string, outlet string, location string, pax string, revenue string").withColumn("business_unit", F.when(F.col("segment") == "New", "Custom"))
    ST.load(spark, str(tmp_path), ST.REVENUE, ST.clean_revenue(df), "f", dt.datetime(2026, 7, 7))
    rules = spark.createDataFrame([("old", None, "New", "Fresh")], "raw_segment string, outlet_key string, segment string, business_unit string")
    ST.retag_segments(spark, str(tmp_path), rules)
    got = {r.date.day: (r.segment, r.business_unit) for r in ST.read_table(spark, str(tmp_path), ST.REVENUE).collect()}
    assert got == {5: ("New", "Fresh"), 6: ("New", "Custom")}


def test_a_missing_column_fails_its_check(spark):
    df = spark.createDataFrame([(dt.date(2026, 7, 5), "S", "North", 1.0)], "date date, segment string, location string, pax double")
    report = {r.check: r for r in quality.validation_report(df, ["North"], ["S"], dt.date(2026, 8, 1)).collect()}
    assert not report["required_columns"].passed and report["required_columns"].affected == 2 and report["locations"].passed


def test_json_documents_keep_their_own_wrapper(spark, tmp_path):
    for name, text in (("a", '{"data": [{"x": 1}, {"x": 2}]}'), ("b", '{"rows": [{"x": 3, "y": "z"}]}'), ("c", '{"x": 4}')):
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(int(r.x) for r in FS.read_json(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]
