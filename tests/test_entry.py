from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

# Plans whose shape matters: (query, largest number of lineitem scans).
ONE_SCAN = ["q01_two_period_comparison", "a02_grain_sets", "q02_named_comparison", "q09_multi_period_snapshot", "q04_volume_vs_spend", "o01_top_outlets"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


@pytest.mark.parametrize("name", ONE_SCAN)
def test_comparison_reads_the_facts_once(spark, name):
    plan = plan_of(entry.queries()[name](spark, SMALL))
    assert plan.count("lineitem.parquet") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "l_comment" not in plan


def test_date_filter_reaches_the_scan(spark):
    plan = plan_of(entry.queries()["q09_multi_period_snapshot"](spark, SMALL))
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(o_orderdate" in plan


def test_dedupe_limits_groups_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(entry.queries()["w02_dedupe_keep_last"](spark, SMALL))


@pytest.mark.parametrize("name", ["q01_two_period_comparison", "a10_traffic_reconciled", "j05_traffic_by_outlet_pool"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer part orders lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted((tuple(map(str, r)) for r in rel.fetchall()))
    got = sorted(tuple(map(str, (r[c] for c in cols))) for r in entry.queries()[name](spark, SMALL).collect())
    assert got == want
