"""Driver-table workload: every operator run over the shared parquet tables, with its SQL check."""

from __future__ import annotations

import importlib

MODULES = ["comparison", "allocation", "reporting", "text", "sheets", "ingest", "corpora"]


def load_all() -> None:
    """Import every workload module once so that its queries are registered."""
    for name in MODULES:
        importlib.import_module(f"sitemetrics.workload.{name}")
