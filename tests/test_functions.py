from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitemetrics.functions import dates as D
from sitemetrics.functions import formats as FM
from sitemetrics.functions import labels as L
from sitemetrics.functions import metrics as M
from sitemetrics.functions import numbers as NB


def run(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", fn("x").alias("y")).orderBy("i").collect()]


def test_messy_numbers(spark):
    got = run(spark, ["₹ 1,23,456.78", "Rs. 5000", "(2,500)", "1.2 L", "3 Cr", " - ", "", "12%", "abc", "2 lakhs", "(1.5 cr)", "NA", None, "4k", "7 mn"], NB.messy_number)
    assert got == [123456.78, 5000, -2500, pytest.approx(120000), 3e7, None, None, 12, None, 2e5, -1.5e7, None, None, None, 7e6]


def test_report_and_count_numbers(spark):
    assert run(spark, ["5 ,01,992", "-", "12 34.5x", None], NB.report_number) == [501992, None, 1234.5, None]
    assert run(spark, [" 10,64,438", "—", "", "x"], NB.count_number) == [1064438, None, None, None]


def test_dates(spark):
    got = run(spark, ["2026-07-05", "05/07/2026", "13/14/2026", "07/25/2026", "06-Jul-2026", "July 6, 2026", "45000", "12", "6th July 26", "2026-02-30", "1999-01-01", "2026-07-05 10:00:00"], D.text_date)
    d = dt.date
    assert got == [d(2026, 7, 5), d(2026, 7, 5), None, d(2026, 7, 25), d(2026, 7, 6), d(2026, 7, 6), d(2023, 3, 15), None, d(2026, 7, 6), None, None, d(2026, 7, 5)]
    assert run(spark, ["For 06-Jul-2026 (final)", "none"], D.date_in_text) == [d(2026, 7, 6), None]
    assert run(spark, ["Apr'24", "May-26", "May 2026", "Fy24-25", "x"], D.month_label) == [d(2024, 4, 1), d(2026, 5, 1), d(2026, 5, 1), None, None]
    assert run(spark, [d(2024, 3, 31), d(2024, 1, 15)], lambda c: D.month_shift(c, -1), "date") == [d(2024, 2, 29), d(2023, 12, 15)]


def test_changes_and_classes(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0), (110.0, 100.0), (1.0, None)], "c double, p double")
    assert [r[0] for r in df.select(M.pct_change("c", "p")).collect()] == [10.0, -1.0, None, None, pytest.approx(0.1), None]
    drv = spark.createDataFrame([(0.01, 0.02), (0.5, 0.1), (0.1, 0.5), (0.2, 0.19), (None, None)], "a double, b double")
    assert [r[0] for r in drv.select(M.driver_class("a", "b")).collect()] == ["Flat", "Volume-driven", "Spend-driven", "Mixed", "Flat"]
    assert run(spark, [0.06, -0.06, 0.05, None], M.trend_label, "double") == ["📈 Revenue Increase", "📉 Revenue Decline", "➡️ Stable", "➡️ Stable"]


def test_formats(spark):
    assert run(spark, [4935256.0, -120000.0, 122.0, None, 2.5, 3.5, float("nan")], FM.money_text, "double") == ["₹49,35,256", "₹-1,20,000", "₹122", "—", "₹2", "₹4", "—"]
    assert run(spark, [0.087, -0.034, None, 0.0], FM.pct_text, "double") == ["+8.70%", "-3.40%", "—", "+0.00%"]
    assert run(spark, [25.0, 25.1, 25.567, 0.0, None], FM.spend_text, "double") == ["25", "25.10", "25.57", "0", "-"]
    assert run(spark, ["+8.70%", "—", "-3.40%"], FM.pct_from_text) == [8.7, None, -3.4]


def test_labels(spark):
    assert run(spark, ["Sub-Business\n(new)", "PAX.", None], L.norm_label) == ["sub business (new)", "pax", ""]
    assert run(spark, ["o'neil (del) x-ray", "HQ"], lambda c: L.title_case(c, ["hq"])) == ["O'Neil (Del) X-Ray", "HQ"]
    assert run(spark, ["Grand Total", "total of x", "totally", "x overall"], L.is_total_label) == [True, True, False, True]
    assert run(spark, ["a​   b", " nan "], L.clean_cell) == ["a b", None]


def test_driver_sentences(spark):
    rows = [(-0.1, 0.02, 0.3, 0.2), (0.2, 0.0, 0.0, 0.2), (None, None, None, 0.3), (0.2, -0.3, -0.1, -0.2), (0.0, 0.0, 0.0, 0.0), (0.06, 0.2, 0.2, 0.4)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t double, n double, s double, r double")
    got = [x["y"] for x in df.select("i", M.revenue_driver_text("t", "n", "s", "r").alias("y")).orderBy("i").collect()]
    assert got[0] == "Revenue increased despite traffic decline due to higher SPP."
    assert got[1] == "Revenue increased mainly due to higher airport traffic."
    assert got[2] == "—" and got[3] == "Revenue declined despite higher traffic due to lower penetration."
    assert got[4] == "Revenue was broadly stable." and "penetration" in got[5]


def test_unit_notes(spark):
    assert run(spark, ["(Rs. in Lakhs)", "₹ '000", "plain"], NB.unit_multiplier) == [1e5, 1e3, 1.0]
    assert [r[0] for r in spark.range(1).select(F.lit(1)).collect()] == [1]
