"""Work that queries share is done once: facts, stage tables and the parsing of cell texts."""

from sitemetrics.functions import vocabulary as V
from sitemetrics.operators.reuse import materialise
from sitemetrics.plans import grids as G
from sitemetrics.workload import facts as X
from sitemetrics.workload import sheets as SH

SF = "/root/testdata/sf0.001"
VOCAB = V.Vocab(places={"asia": "ASIA", "europe": "EUROPE"}, segments={}, outlet_keywords=[], years=(1990, 2050))


def test_sheets_are_made_from_facts_that_were_written(spark):
    """The order lines are not read again for every part of a sheet."""
    facts = X.once(spark, SF)
    for sheets in (SH.pivot_sheets, SH.outlet_target_sheets, SH.budget_sheets):
        files = sheets(spark, facts).inputFiles()
        assert files and not any("lineitem" in f for f in files)
    assert X.once(spark, facts) is facts


def test_targets_of_written_facts_equal_those_of_the_lines(spark):
    facts = X.once(spark, SF)
    for target in (X.target_monthly, X.target_daily):
        once, lines = target(spark, facts), target(spark, SF)
        assert once.schema == lines.schema
        assert once.exceptAll(lines).isEmpty() and lines.exceptAll(once).isEmpty()


def test_a_stage_table_is_a_table(spark):
    """A checkpoint computes its rows twice and is read back whole."""
    stage = materialise(spark.range(10).selectExpr("id", "cast(id as string) as text"))
    assert stage.select("id").inputFiles()
    assert sorted(r["text"] for r in stage.collect()) == sorted(str(i) for i in range(10))


def test_headers_of_read_cells_equal_those_of_raw_ones(spark):
    rows = [(0, 0, "Report  of 2020"), (1, 0, "Bill Date"), (1, 1, "City"), (1, 2, "Net Sales"), (2, 0, "03/04/2020"), (2, 1, "Asia"), (2, 2, "Rs. 1,200"), (3, 0, " "), (3, 1, "Europe"), (3, 2, "(5)")]
    cells = spark.createDataFrame([("a", "f", "s", r, c, v) for r, c, v in rows], "grid_id string, source string, sheet string, row_idx int, col_idx int, value string")
    read = materialise(G.read_cells(cells, VOCAB.years))
    assert read.count() == cells.count()
    assert sorted(G.header_row_scores(read, VOCAB).collect()) == sorted(G.header_row_scores(cells, VOCAB).collect())
    assert [r["header_row"] for r in G.find_headers(read, VOCAB).collect()] == [1]
    plan = G.find_transposed(read, VOCAB)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(value" not in plan


def test_sentences_read_the_order_lines_once(spark):
    """The breakdown of the classes is a stage table when its sentences are written."""
    from sitemetrics.workload.reporting import class_insight

    text = class_insight(spark, SF)
    assert not any("lineitem" in f for f in text.inputFiles())
    assert text.count() == 3
