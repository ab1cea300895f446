"""Whole corpora: files to stored rows, failing files, repeated and unfinished batches, rejects."""

from __future__ import annotations

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from sitemetrics.plans import layouts as LY
from sitemetrics.sources import corpus as CO
from sitemetrics.sources import store as ST
from tests.conftest import cells_of

AT = dt.datetime(2026, 7, 6, 12)
RULES = CO.Rules(places={"north": "North", "south": "South"}, terminals={"t one": "T1"})
LONG = ["Date", "Location", "Business", "Sub-Business", "PAX", "Revenue"]
GRIDS = {
    "a1": ("a.csv", "Sheet1", [LONG, ["05/07/2026", "North", "Spa", "One", "10", "100.5"], ["06/07/2026", "South", "Spa", "One", "x", "x"], ["soon", "South", "Spa", "One", "1", "1"]]),
    "b1": ("b.xlsx", "Data", [LONG, ["05/07/2026", "North", "Spa", "One", "99", "999"], ["07/07/2026", "North", "Spa", "Two", "1", "7"]]),
    "b2": ("b.xlsx", "Targets", [["Date", "North", "Other"], ["05-07-2026", "50", "1"], ["Total", "50", "1"]]),
    "b3": ("b.xlsx", "Cover", [["Prepared by the office"]]),
    "c1": ("c.xlsx", "Data", [LONG, ["08/07/2026", "North", "Spa", "Ghost", "1", "1"]]),
    "c2": ("c.xlsx", "Targets", [["Date", "North"], ["to be decided", "5"]]),
    "d1": ("d.txt", "", [["nothing to see", "here"]]),
    "e1": ("e.xlsx", "North", [[None, "T One", None], ["Day", "Dep.", "Arr."], ["01-07-2026", "5", "6"], ["Total", "5", "6"], ["02-07-2026", "1", "1"]]),
}


def stored(spark, root):
    rev = {(r["date"].day, r["outlet"]): (r["revenue"], r["source_file"], r["grid_id"], r["row_idx"]) for r in CO.read_committed(spark, root, ST.REVENUE).collect()}
    traffic = [(r["date"].day, r["location"], r["terminal"], r["traffic"], r["grid_id"]) for r in CO.read_committed(spark, root, ST.TRAFFIC).collect()]
    targets = [(r["location"], r["date"].day, r["aop"], r["source_file"]) for r in CO.read_committed(spark, root, ST.TARGET_DAILY).collect()]
    return rev, traffic, targets


@pytest.fixture(scope="module")
def loaded(spark):
    root = tempfile.mkdtemp(prefix="corpus-")
    return root, CO.ingest_corpus(spark, root, cells_of(spark, GRIDS), RULES, "one", AT)


def test_rows_keep_their_origin_and_failed_files_store_nothing(spark, loaded):
    rev, traffic, targets = stored(spark, loaded[0])
    assert rev == {(5, "One"): (100.5, "a.csv", "a1", 1), (7, "Two"): (7.0, "b.xlsx", "b1", 2)}
    assert traffic == [(1, "North", "T1", 11.0, "e1")]
    assert targets == [("North", 5, 50.0, "b.xlsx")]


def test_one_audit_row_per_file(spark, loaded):
    got = {r["file_name"]: (r["status"], r["reason"], r["load_type"], r["read_rows"], r["inserted"], r["skipped"], r["rejected"]) for r in loaded[1].collect()}
    assert got == {
        "a.csv": ("Available", None, "Revenue", 1, 1, 0, 2), "b.xlsx": ("Available", None, "AOP+Revenue", 3, 2, 1, 3),
        "c.xlsx": ("Failed", "no usable row in daily_targets sheet c2", None, 1, 0, 0, 1), "d.txt": ("Failed", "no known layout", None, 0, 0, 0, 0),
        "e.xlsx": ("Available", None, "Traffic", 1, 1, 0, 4),
    }
    assert [(r["batch_id"], r["files"], r["failed"]) for r in CO.commits(spark, loaded[0]).collect()] == [("one", 5, 2)]


def test_rejects_have_place_and_reason(spark, loaded):
    got = {(r["grid_id"], r["row_idx"], r["col_idx"], r["reason"]) for r in CO.read_rejects(spark, loaded[0], "one").collect()}
    assert got == {
        ("a1", 2, None, "neither customers nor revenue"), ("a1", 3, None, "unreadable date"), ("b2", 1, 2, "column without a meaning"),
        ("b2", 2, 1, "first cell is not a date"), ("b2", 2, 2, "first cell is not a date"), ("c2", 1, 1, "first cell is not a date"),
        ("e1", 3, 1, "below the first total row"), ("e1", 3, 2, "below the first total row"), ("e1", 4, 1, "below the first total row"), ("e1", 4, 2, "below the first total row"),
    }


def test_repeated_and_unfinished_batches(spark, loaded):
    root = loaded[0]
    before = stored(spark, root)
    again = CO.ingest_corpus(spark, root, cells_of(spark, GRIDS), RULES, "one", AT + dt.timedelta(1))
    assert again.count() == 5 and stored(spark, root) == before
    # A batch that stopped after some tables: its files are there, but no reader sees them; the repeated run replaces them.
    half = spark.createDataFrame([(dt.date(2026, 7, 30), "Lost")], "date date, outlet string").withColumns({"year_month": F.lit(202607), "revenue": F.lit(1.0)})
    half.write.partitionBy("year_month").parquet(f"{root}/revenue/batch_id=two")
    assert stored(spark, root) == before
    more = GRIDS | {"f1": ("f.csv", "", [LONG, ["05/07/2026", "North", "Spa", "One", "1", "1"], ["09/07/2026", "South", "Spa", "New", "2", "3"]])}
    audit = {r["file_name"]: (r["inserted"], r["skipped"]) for r in CO.ingest_corpus(spark, root, cells_of(spark, more), RULES, "two", AT + dt.timedelta(2)).collect()}
    assert audit == {"a.csv": (0, 1), "b.xlsx": (0, 3), "c.xlsx": (0, 0), "d.txt": (0, 0), "e.xlsx": (0, 1), "f.csv": (1, 1)}
    rev, traffic, targets = stored(spark, root)
    assert rev == before[0] | {(9, "New"): (3.0, "f.csv", "f1", 2)} and (traffic, targets) == before[1:]


def test_every_value_cell_is_a_fact_or_a_reject(spark):
    cells = cells_of(spark, {k: GRIDS[k] for k in ("b2", "e1")})
    for read, data in ((LY.read_daily_targets(cells.where("grid_id = 'b2'"), RULES.places), 4), (LY.read_cross_tab(cells.where("grid_id = 'e1'"), RULES.places, RULES.terminals), 6)):
        assert read.values.count() + read.rejects.count() == data


def test_an_empty_corpus(spark):
    root = tempfile.mkdtemp(prefix="corpus-")
    assert CO.ingest_corpus(spark, root, cells_of(spark, GRIDS).limit(0), RULES, "none", AT).count() == 0
    assert CO.read_committed(spark, root, ST.REVENUE).count() == 0
