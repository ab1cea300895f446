"""Schema inference on sheets made for these tests: a ferry operator's counters, with its own labels and figures."""

from __future__ import annotations

import datetime as dt

import pytest

from sitemetrics.functions.vocabulary import Vocab
from sitemetrics.plans.infer import confidence_v2, infer
from tests.conftest import cells_of

TODAY = dt.date(2025, 3, 31)
VOCAB = Vocab(
    places={"east pier": "East Pier", "ep": "East Pier", "west quay": "West Quay", "wq": "West Quay", "old harbour": "Old Harbour"},
    segments={"tickets": "Ticketing", "ticketing": "Ticketing", "snacks": "Food", "food": "Food", "bikes": "Rental", "rental": "Rental"},
    outlet_keywords=[("booth", "Ticketing"), ("kiosk", "Food"), ("cycle", "Rental")],
)
FERRY = [("2025-03-09", "East Pier", "Ticketing", "Booth 1", 31, 77.75), ("2025-03-10", "West Quay", "Food", "Kiosk B", 12, 64.0), ("2025-03-11", "Old Harbour", "Rental", "Cycle Shed", 3, 49.5)]


def long_sheet(before: int = 0):
    """The three rows under plain headers, with `before` lines of remarks above."""
    remarks = [[f"remark {k}"] for k in range(before)]
    return [*remarks, ["Location", "Date", "Outlet", "Segment", "Revenue", "Pax"], *[[p, d, o, s, r, n] for d, p, s, o, n, r in FERRY]]


def by_place():
    """Two days, two piers side by side, two figures each."""
    head = ["Date", "Outlet", "Segment", "PAX West Quay", "Revenue West Quay", "PAX East Pier", "Revenue East Pier"]
    return [head, *[[f"{d:02d}/03/2025", "Kiosk B", "Food", d, d * 3.5, d + 1, d * 2.25] for d in (14, 15)]]


def by_day(days: int = 4, outlets: int = 3):
    """Amounts of outlets (rows) on days (columns): 7 * outlet + day."""
    head = ["Outlet", "Segment", *[f"{d:02d}-02-2025" for d in range(1, days + 1)]]
    return [["West Quay takings"], head, *[[f"Booth {o}", "Tickets", *[7 * o + d for d in range(1, days + 1)]] for o in range(1, outlets + 1)]]


GRIDS = {
    "plain": ("march.csv", "", long_sheet()),
    "deep": ("march_remarks.csv", "", long_sheet(130)),
    "titled": ("evening.xlsx", "Sheet7", [
        ["Evening count, 18-Feb-2025"], ["Location", "Outlet", "Visitors", "Revenue"], ["Old Harbour", "Cycle Shed", 9, "(41.25)"], ["", "Kiosk H", 22, "1,080.40"],
        ["East Pier", "Booth 2", 40, "Rs. 96"], ["Total", "", 71, 1135.15],
    ]),
    "by_place": ("piers.xlsx", "Both", by_place()),
    "by_day": ("february.xlsx", "West Quay", by_day()),
    "plan": ("plan.xlsx", "Budget", [["Budget for 2025"], ["Outlet", "Location", "01-05-2025", "01-06-2025"], ["Booth 1", "East Pier", 8, 9]]),
    "counts": ("gates.csv", "", [["Location", "Date", "Traffic"], ["East Pier", "2025-03-01", 501], ["West Quay", "2025-03-01", 377]]),
    "scaled": ("scaled.xlsx", "East Pier", [["Takings 02-03-2025 (Rs. in Lakhs)"], ["Segment", "Outlet", "Pax", "Revenue"], ["Tickets", "Booth 1", 630, 0.75]]),
    "letter": ("letter.txt", "", [["Dear all,"], ["see you at the quay"]]),
}


@pytest.fixture(scope="module")
def found(spark):
    result = infer(cells_of(spark, GRIDS), VOCAB, TODAY)
    rows = {}
    for r in result.rows.orderBy("grid_id", "row_idx", "date", "location").collect():
        rows.setdefault(r["grid_id"], []).append(r)
    return result, rows, {g["grid_id"]: g for g in result.grids.collect()}


@pytest.mark.parametrize("grid", ["plain", "deep"])
def test_long_sheets_come_back_wherever_the_header_is(found, grid):
    got = [(str(r["date"]), r["location"], r["segment"], r["outlet"], r["pax"], r["revenue"]) for r in found[1][grid]]
    assert got == FERRY


def test_missing_columns_are_recovered(found):
    got = found[1]["titled"]
    assert [(r["location"], r["segment"], r["pax"], r["revenue"]) for r in got] == [
        ("Old Harbour", "Rental", 9, -41.25), ("Old Harbour", "Food", 22, 1080.4), ("East Pier", "Ticketing", 40, 96)]
    assert {str(r["date"]) for r in got} == {"2025-02-18"}


def test_places_side_by_side(found):
    got = {(r["date"].day, r["location"]): (r["pax"], r["revenue"]) for r in found[1]["by_place"]}
    assert got == {(d, p): v for d in (14, 15) for p, v in (("West Quay", (d, d * 3.5)), ("East Pier", (d + 1, d * 2.25)))}
    assert found[2]["by_place"]["layout"] == "location_wide"


def test_days_side_by_side(found):
    got = {(r["outlet"], r["date"].day): r["revenue"] for r in found[1]["by_day"]}
    assert got == {(f"Booth {o}", d): 7 * o + d for o in range(1, 4) for d in range(1, 5)}
    assert found[2]["by_day"]["layout"] == "date_wide" and {r["location"] for r in found[1]["by_day"]} == {"West Quay"}


def test_other_sheets_are_turned_away_with_a_reason(found):
    _, rows, grids = found
    assert not {"plan", "counts", "letter"} & set(rows)
    assert "budget" in grids["plan"]["reason"] and "revenue" in grids["counts"]["reason"] and grids["letter"]["reason"] == "no header row found"


def test_a_stated_unit_scales_amounts_only(found):
    (row,) = found[1]["scaled"]
    assert (row["revenue"], row["pax"]) == (75000, 630)


def test_mapping_and_confidence(spark, found):
    result, _, grids = found
    how = {(m["grid_id"], m["role"]): (m["source"], m["method"]) for m in result.mapping.collect()}
    assert how["titled", "pax"][0] == "column 'Visitors'" and how["titled", "date"][1] == "recovered"
    rate = spark.createDataFrame([("plain", 1.0)], "grid_id string, pass_rate double")
    score = {x["grid_id"]: x for x in confidence_v2(result.mapping, result.rows, rate).collect()}["plain"]
    assert 0 < score["score"] <= 1 and score["level"] == "high" and 0 < grids["plain"]["confidence"] <= 1
