from __future__ import annotations

import datetime as dt

import pytest

from sitemetrics.operators.ordered import as_of_dates, fill_down, running_count
from sitemetrics.plans import periods as P

D = dt.date


@pytest.mark.parametrize("kind,mode,anchor,want", [
    ("Day-wise", "Full Period", D(2026, 7, 5), (D(2026, 7, 5), D(2026, 7, 5), D(2026, 7, 4), D(2026, 7, 4))),
    ("Week-wise", "Full Period", D(2026, 7, 5), (D(2026, 6, 29), D(2026, 7, 5), D(2026, 6, 22), D(2026, 6, 28))),
    ("Week-wise", "To-Date", D(2026, 7, 1), (D(2026, 6, 29), D(2026, 7, 1), D(2026, 6, 22), D(2026, 6, 24))),
    ("Month-wise", "To-Date", D(2026, 3, 31), (D(2026, 3, 1), D(2026, 3, 31), D(2026, 2, 1), D(2026, 2, 28))),
    ("Year-wise", "To-Date", D(2024, 3, 1), (D(2024, 1, 1), D(2024, 3, 1), D(2023, 1, 1), D(2023, 3, 2))),
    ("Year-wise", "Full Period", D(2024, 3, 1), (D(2024, 1, 1), D(2024, 12, 31), D(2023, 1, 1), D(2023, 12, 31))),
])
def test_ranges(kind, mode, anchor, want):
    p = P.resolve_ranges(kind, anchor, mode=mode)
    assert (p.current_start, p.current_end, p.compare_start, p.compare_end) == want


def test_options_and_labels():
    gap = P.resolve_ranges("Day-wise", D(2026, 7, 5), available=[D(2026, 7, 1), D(2026, 7, 9)])
    assert gap.compare_start == D(2026, 7, 1)
    assert P.resolve_ranges("Year-wise", D(2024, 3, 1), mode="To-Date", align="calendar").compare_end == D(2023, 3, 1)
    assert P.resolve_ranges("Month-wise", D(2026, 7, 5), compare_to=D(2025, 7, 9)).compare_label == "Jul 2025 (full month)"
    assert P.short_label(D(2026, 6, 15), D(2026, 6, 21)) == "Week of 15 Jun 2026"
    assert P.short_label(D(2026, 6, 1), D(2026, 6, 30)) == "Jun 2026"
    assert P.short_label(D(2026, 6, 1), D(2026, 6, 3), "other") == "01 Jun 2026 – 03 Jun 2026"
    assert P.safe_month_shift(D(2024, 1, 31), 1) == D(2024, 2, 29)


def test_vectorised_ranges_match_scalar(spark):
    days = [D(2024, 2, 29) + dt.timedelta(37 * i) for i in range(20)]
    anchors = spark.createDataFrame([(d,) for d in days], "anchor date")
    for kind in P.KINDS[1:]:
        for mode in P.MODES:
            for r in P.resolve_all(anchors, kind, mode).collect():
                p = P.resolve_ranges(kind, r["anchor"], mode=mode)
                assert (r["current_start"], r["current_end"], r["compare_start"], r["compare_end"], r["current_label"], r["compare_label"]) == (
                    p.current_start, p.current_end, p.compare_start, p.compare_end, p.current_label, p.compare_label)


def test_as_of(spark):
    seen = spark.createDataFrame([(D(2024, 1, 5),), (D(2025, 6, 1),)], "date date")
    anchors = spark.createDataFrame([(D(2024, 1, 4),), (D(2024, 1, 5),), (D(2025, 5, 31),), (D(2027, 1, 1),)], "anchor date")
    got = {r["anchor"]: r["nearest"] for r in as_of_dates(anchors, seen).collect()}
    assert got == {D(2024, 1, 4): None, D(2024, 1, 5): D(2024, 1, 5), D(2025, 5, 31): D(2024, 1, 5), D(2027, 1, 1): D(2025, 6, 1)}


def test_runs_join_up_across_chunks(spark):
    rows = [(g, i, f"{g}{i}" if i % 7 == 3 else None) for g in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i int, v string")
    want, last = {}, {}
    for g, i, v in rows:
        last[g] = v or last.get(g)
        want[(g, i)] = last[g]
    assert {(r["g"], r["i"]): r["v"] for r in fill_down(df, ["g"], "i", ["v"], chunk=5).collect()} == want
    counts = {(r["g"], r["i"]): r["n"] for r in running_count(df, ["g"], "i", df["v"].isNotNull(), "n", chunk=5).collect()}
    assert counts[("a", 39)] == 6 and counts[("b", 2)] == 0 and counts[("b", 10)] == 2
