"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from sitemetrics.llm.queries import CHECKS, QUERIES
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "documents benchmark labels pages embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rel = con.execute(CHECKS[name])
    columns = [d[0] for d in rel.description]
    want = sorted(tuple(map(str, r)) for r in rel.fetchall())
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want


def test_each_operator_has_one_query():
    assert sorted(n.split("_")[0] for n in QUERIES if n.startswith("op")) == sorted(f"op{k}" for k in range(1, 14)) and "pipeline" in QUERIES
