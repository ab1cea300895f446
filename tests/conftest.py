from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from sitemetrics.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cpus=4, memory="6g")
    yield s
    s.stop()


def cells_of(spark, grids: dict[str, tuple[str, str, list[list]]]):
    """Cell table from {grid_id: (source, sheet, rows)}; None and "" are blank."""
    rows = [
        (g, src, sheet, r, c, None if v is None else str(v))
        for g, (src, sheet, table) in grids.items() for r, line in enumerate(table) for c, v in enumerate(line)
    ]
    return spark.createDataFrame(rows, "grid_id string, source string, sheet string, row_idx int, col_idx int, value string")
