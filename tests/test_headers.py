"""Misspelt headers, dictionary terms between word borders, sheets with days across."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitemetrics.functions import vocabulary as V
from sitemetrics.operators.ordered import fill_down, running_sum
from sitemetrics.operators.terms import found_terms, tag, terms_table
from sitemetrics.plans import infer as INF
from sitemetrics.plans.headers import header_matches
from tests.conftest import cells_of


@pytest.mark.parametrize("label, role, method", [
    ("Net Sales", "revenue", "synonym"), ("Sales Net", "revenue", "synonym"), ("Geographcal Segment", "segment", "synonym"), ("Tunrover Net", None, None), ("Footfal", "pax", "similar"), ("Serivce Point", "outlet", "similar"),
    ("Amount Totl", "revenue", "synonym"), ("Pasengers", "pax", "similar"), ("Growth %", None, None), ("S. No.", None, None), ("zzz", None, None),
])
def test_header_matches(spark, label, role, method):
    got = header_matches(spark.createDataFrame([(label,), (None,), ("",)], "label string"), "label").orderBy(F.desc("score")).first()
    assert (got["role"], got["method"]) == (role, method) if role else got is None or got["score"] < 0.6


def test_terms_stand_between_word_borders(spark):
    terms = terms_table(spark, {"goa": "Goa", "new delhi": "Delhi", "delhi": "Old Delhi", "del": "Delhi", "": "nothing"})
    texts = [("Goal sheet",), ("GOA-2026",), ("Traffic New_Delhi (del)",), ("delhi",), (None,), ("",), ("model",), ("goa delhi",)]
    got = {r["t"]: r["name"] for r in tag(spark.createDataFrame(texts, "t string"), "t", terms, "name").collect()}
    assert got == {"Goal sheet": None, "GOA-2026": "Goa", "Traffic New_Delhi (del)": "Delhi", "delhi": "Old Delhi", None: None, "": None, "model": None, "goa delhi": "Old Delhi"}


def test_a_large_dictionary_is_a_table(spark):
    terms = spark.range(10_000).select(F.concat(F.lit("site "), F.col("id").cast("string")).alias("term"), F.col("id").cast("string").alias("name"), F.col("id").cast("int").alias("priority"))
    found = found_terms(spark.createDataFrame([("at site 77, not site 99999",)], "t string"), "t", terms)
    assert [tuple(r) for r in found.collect()] == [("at site 77, not site 99999", "77", "site 77", 1)]
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000


VOCAB = V.Vocab(places={"north": "North"}, segments={"lounge": "Lounge"}, years=(2020, 2030))


def test_days_across_are_turned(spark):
    grid = [["Lounge report"], [None], ["Date", "01/07/2026", "02/07/2026", "03/07/2026"], ["PAX", "10", "11", "12"], ["Revenue", "100", None, "300"]]
    plain = [["Date", "Location", "Segment", "Outlet", "Revenue"], ["01/07/2026", "North", "Lounge", "A", "5"]]
    got = INF.infer(cells_of(spark, {"t": ("f.xlsx", "North", grid), "p": ("g.xlsx", "x", plain)}), VOCAB, dt.date(2026, 7, 5))
    assert {(r["grid_id"], r["date"].day, r["location"], r["segment"], r["pax"], r["revenue"]) for r in got.rows.collect()} == {
        ("t", 1, "North", "Lounge", 10.0, 100.0), ("t", 3, "North", "Lounge", 12.0, 300.0), ("p", 1, "North", "Lounge", None, 5.0)}
    assert {(r["grid_id"], r["layout"]) for r in got.grids.collect()} == {("t", "transposed"), ("p", "long")}


def test_misspelt_headers_are_inferred_on_request(spark):
    rows = [["Invoise Date", "City", "Bussiness Line", "Outlet Nmae", "Turnoverr"], ["01/07/2026", "North", "Lounge", "A", "5.25"], ["02/07/2026", "North", "Lounge", "B", "7.5"]]
    got = INF.infer(cells_of(spark, {"m": ("f.xlsx", "x", rows)}), VOCAB, dt.date(2026, 7, 5), fuzzy=True)
    assert {(r["date"].day, r["outlet"], r["revenue"]) for r in got.rows.collect()} == {(1, "A", 5.25), (2, "B", 7.5)}
    assert {r["role"]: r["method"] for r in got.mapping.collect()}["revenue"] == "header+content"


def test_carries_without_keys_go_up_in_levels(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 137 == 3, F.col("id")).alias("v"))
    got = fill_down(running_sum(df, [], "id", F.lit(1), "n", chunk=7), [], "id", ["v"], chunk=7).orderBy("id").collect()
    want = None
    for k, r in enumerate(got):
        want = k if k % 137 == 3 else want
        assert (r["id"], r["n"], r["v"]) == (k, k + 1, want)
