"""Delimited files read in byte ranges against the same files read whole."""

from __future__ import annotations

import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sitemetrics.sources import files as FS


@pytest.fixture
def small_ranges(spark):
    sizes = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in sizes:
        spark.conf.set(k, "64")
    yield
    for k, v in sizes.items():
        spark.conf.set(k, v)


def texts() -> dict[str, bytes]:
    pick = random.Random(5)
    field = lambda: pick.choice(["1", "two words", '"a;b"', '"say ""x"""', '"up\n\ndown;\n"', "", '"' + "long " * 30 + '\nend"'])
    many = "\n".join(";".join(field() for _ in range(3)) for _ in range(120))
    return {
        "many.csv": many.encode(), "final.csv": (many + "\n").encode(), "crlf.csv": b"a,b\r\n1,\"x\ny\"\r\n\r\n2,3\r\n", "mark.csv": "﻿name\tvalue\né\t1\n".encode(),
        "latin.csv": "café|1\nplain|2\n".encode("latin-1") * 20, "odd.csv": (many + '\n5" pipe;1;2\nlast;3;4\n' + "x;y;z\n" * 30).encode(), "one.csv": b"alone", "empty.csv": b"",
        "quote.csv": b'"', "open.csv": b'a,b\n"never closed,c\nd,e\n',
    }


def test_ranges_agree_with_whole_files(spark, small_ranges):
    folder = Path(tempfile.mkdtemp(prefix="delimited-"))
    for name, data in texts().items():
        (folder / name).write_bytes(data)
    name = F.regexp_extract("source", "([^/]*)$", 1)
    rows = lambda df: sorted((r["f"], r["row_idx"], r["col_idx"], r["value"]) for r in df.select(name.alias("f"), "row_idx", "col_idx", "value").collect())
    whole = FS.read_files(spark, str(folder)).select("path", FS.decoded("content").alias("text"))
    ranged = FS.text_lines(spark, str(folder))
    assert ranged.where("path like '%many.csv'").select("block").distinct().count() > 20
    assert rows(FS.read_delimited(spark, str(folder))) == rows(FS.delimited_cells(whole).where("row_idx >= 0"))
