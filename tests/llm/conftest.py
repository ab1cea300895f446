from __future__ import annotations

import random

import pytest

from sitemetrics.llm.registry import ship_package

WORDS = "der haus lake river stone amber token quick violet über naïve winter summer field paper glass chair seven eight nine".split()


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(40)) for _ in range(n))


#: Nulls, empty and blank texts, a repeated row, a long text, odd characters; ids neither dense nor all positive.
ODD = [
    (5, None, "a"), (7, "", "a"), (9, " \t\n ", None), (-3, "one", "b"), (12, "Two words", "b"), (None, "a row without an id at all", "a"),
    (20, prose(1, 60), "a"), (20, prose(1, 60), "a"), (21, prose(1, 60), "b"), (22, prose(1, 59) + " changed", "b"), (40, prose(2, 9000), "a"),
    (41, "x" * 5000, "c"), (42, "Ünï ç ödé  \U0001f600 end.", "c"), (43, " line\x0bfeed\x1cfile", "c"),
]
SCHEMA = "doc_id long, text string, source string"


def documents(spark, rows=None):
    """The rows with extra columns that are named like ones inside the operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD if rows is None else rows, SCHEMA)
    clash = ["id", "key", "mark", "node", "kind", "label", "signature", "n_words", "words", "shard", "component", "score", "part"]
    return df.withColumns({c: F.lit("clash") for c in clash})
