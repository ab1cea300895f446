from __future__ import annotations

import datetime as dt

import pytest

from sitemetrics.plans import grids as G
from sitemetrics.plans import layouts as LY
from tests.conftest import cells_of

D = dt.date
PLACES = {"north": "North", "south": "South"}


def test_wide_pivot_with_targets_and_subtotals(spark):
    grid = [
        [None, "North", None, None, None, None, None, "North PAX.", "North Revenue.", "South", None, None],
        [None, "Lounges", None, None, "Spa", None, "Spa PAX.", None, None, "Lounges", None, None],
        [None, "L1", None, None, "S1", None, None, None, None, "L1", None, None],
        ["Date", "PAX.", "Revenue.", "Sum of AOP", "PAX.", "Revenue.", "PAX.", "PAX.", "Revenue.", "PAX.", "Revenue.", "Sum of AOP"],
        ["2026-07-05", 10, 100, 90, 5, 50, 999, 999, 999, 7, "70.5", 60],
        ["2026-07-06", 11, 110, None, None, None, 999, 999, 999, 8, 80, None],
        ["Grand Total", 21, 210, 90, 5, 50, 1, 1, 1, 15, 150, 60],
    ]
    got = {(r["date"].day, r["location"], r["outlet"]): (r["pax"], r["revenue"], r["aop_daily"])
           for r in LY.wide_pivot(cells_of(spark, {"g": ("f", "s", grid)}), PLACES).collect()}
    assert got == {(5, "North", "L1"): (10, 100, 90), (5, "North", "S1"): (5, 50, None), (5, "South", "L1"): (7, 70.5, 60),
                   (6, "North", "L1"): (11, 110, None), (6, "South", "L1"): (8, 80, None)}


def test_smallest_sheet_wins_across_sheets(spark):
    head = ["Date", "Location", "Business", "Sub-Business", "PAX", "Revenue"]
    big = [head, ["05/07/2026", "North", "Lounges", "A", 1, 1], ["06/07/2026", "North", "Lounges", "A", 2, 2], ["06/07/2026", "North", "Lounges", "A", 3, 3]]
    small = [head, ["05/07/2026", "North", "Lounges", "A", 9, 9]]
    got = {r["date"].day: r["revenue"] for r in LY.long_revenue(cells_of(spark, {"big": ("f", "s", big), "small": ("f", "s", small)}), PLACES).collect()}
    assert got == {5: 9, 6: 3}


def test_monthly_targets_units_combine_alias_and_rejects(spark):
    grid = [
        ["Plan", None, None, None, "100000"],
        [],
        [None, "Geographical Segment", "Business Segment", "Unit-ID", "01-04-2026", "01-05-2026", None, "01-06-2026"],
        [None, "North", "Lounge", "U1", "1.5", "2", None, "9"], [None, "North", "Lounge", "U2", "1", "-"], [None, "North", None, "roll-up", "7", "7"],
        [None, "North", "Lounge", "U3", "4"], [None, "Mars", "Lounge", "U1", "1"], [None, "South", "Rail", "U1", "1"], [None, "South", "Lounge", "U9", "1"],
    ]
    units = spark.createDataFrame([("North", "U1", "Joint"), ("North", "U2", "Joint"), ("North", "U3", "A"), ("North", "U3", "B")], "location string, unit_id string, outlet string")
    ok, rejects = LY.monthly_targets(cells_of(spark, {"g": ("f", "s", grid)}), PLACES, {"lounge": "Lounges"}, units, "Main")
    assert {(r["outlet"], r["month"]): r["aop"] for r in ok.collect()} == {("Joint", 4): 250000, ("Joint", 5): 200000, ("A", 4): 400000, ("B", 4): 400000}
    assert {r["row_number"]: r["reason"] for r in rejects.collect()} == {
        8: "location out of scope", 9: "business segment out of scope", 10: "no outlet mapped to this unit"}


def test_cross_tab_without_date_column_and_stop_row(spark):
    grid = [[None, "T1", None, "Other", None, "G.Total"], ["Day", "Dep.", "Arr.", "Dep.", "Arr.", None], [None, "1", "2", "3", "4", "99"], [None, " 1,000", "-", "5", None, "99"],
            ["Total", "1", "1", "1", "1", "1"], [None, "7", "7", "7", "7", "7"]]
    got = {(r["date"], r["terminal"]): r["traffic"] for r in LY.cross_tab_traffic(cells_of(spark, {"g": ("f", "North Traffic June-26", grid)}), PLACES, {"t1": "Terminal 1"}).collect()}
    assert got == {(D(2026, 6, 1), "Terminal 1"): 3, (D(2026, 6, 1), "Other"): 7, (D(2026, 6, 2), "Terminal 1"): 1000, (D(2026, 6, 2), "Other"): 5}


def test_side_by_side_all_sections_and_swapped_days(spark):
    head = ["Date", "PAX", None, "Flights", None, "PAX", None]
    grid = [
        ["2025-06-01"] + [None] * 6 + ["2026-06-01"],
        [None, "Domestic", None, None, None, "International", None] * 2,
        head + head, [None, "Arr", "Dep", "Arr", "Dep", "Arr", "Dep"] * 2,
        ["1", 1, 2, 9, 9, 3, 4, "2026-05-06", 10, 20, 9, 9, 30, 40],
    ]
    cells = cells_of(spark, {"g": ("f", "North", grid)})
    every = {(r["date"], r["terminal"]): r["traffic"] for r in LY.typed_traffic(cells, PLACES, "all").collect()}
    latest = {(D(2026, 6, 5), "Domestic"): 30, (D(2026, 6, 5), "International"): 70}
    assert every == {(D(2025, 6, 1), "Domestic"): 3, (D(2025, 6, 1), "International"): 7, **latest}
    assert {(r["date"], r["terminal"]): r["traffic"] for r in LY.typed_traffic(cells, PLACES).collect()} == latest


def test_sectioned_table_sums_aliased_lines(spark):
    grid = [["For the Day -> 05-07-2026"], ["Outlet / Business", "North", None, "South", None], ["Lounges"], ["Bar", "1", "5 ,01,992", "-", "-"], ["Main  Bar", "2", "8", "3", "4"],
            [None, "3", "502000", "3", "4"], ["Spa"], ["Bar", "7", "70", None, None], ["Total", "10", "1", "1", "1"]]
    alias = spark.createDataFrame([("main bar", "North", "Bar")], "alias string, location string, outlet string")
    got = {(r["segment"], r["outlet"], r["location"]): (r["pax"], r["revenue"], r["date"]) for r in LY.sectioned_table(
        cells_of(spark, {"g": ("f", "s", grid)}), [("North", 1, 2), ("South", 3, 4)], aliases=alias).collect()}
    day = D(2026, 7, 5)
    assert got == {("Lounges", "Bar", "North"): (3, 502000, day), ("Lounges", "Main Bar", "South"): (3, 4, day), ("Spa", "Bar", "North"): (7, 70, day)}


def test_daily_targets_report_skipped_rows(spark):
    grid = [["Date", "North", "South", "Grand Total"], ["05-07-2026", "1,000", None, "1"], ["Grand Total", "5", "5", "10"]]
    cells = cells_of(spark, {"g": ("f", "s", grid)})
    assert [(r["location"], r["date"], r["aop"]) for r in LY.daily_targets(cells, PLACES).collect()] == [("North", D(2026, 7, 5), 1000)]
    assert [r["row_number"] for r in LY.skipped_rows(cells, PLACES).collect()] == [3]


@pytest.mark.parametrize("name,grid,route", [
    ("traffic", [["Date", "Location", "Traffic"], ["2026-07-05", "North", 1]], "traffic"),
    ("revenue", [["Date", "Location", "Business", "Sub-Business", "PAX", "Revenue"], ["2026-07-05", "North", "L", "A", 1, 1]], "revenue"),
    ("target", [["Date", "North", "South", "Grand Total"], ["05-07-2026", "1", "2", "3"]], "target"), ("other", [["a", "b"], ["c", "d"]], "infer"),
])
def test_router(spark, name, grid, route):
    assert LY.grid_kinds(cells_of(spark, {name: ("f", "s", grid)}), PLACES).collect()[0]["route"] == route


def test_parts_of_one_table_are_joined(spark):
    cells = spark.createDataFrame([("f", 1, 0, 0, "a"), ("f", 1, 1, 0, "b"), ("f", 2, 0, 0, "c"), ("f", 3, 0, 1, "w")], "source string, page int, row_idx int, col_idx int, value string")
    got = sorted((r["grid_id"], r["row_idx"], r["value"]) for r in G.merge_same_width(cells).collect())
    assert [x[1:] for x in got] == [(0, "w"), (0, "a"), (1, "b"), (2, "c")]
