"""Check only the queries of the named workload modules. Usage: check_module.py sf module [module ...]"""

from __future__ import annotations

import importlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
import check  # noqa: E402
from sitemetrics.workload import registry  # noqa: E402

sf, mods = sys.argv[1], sys.argv[2:]
for m in mods:
    importlib.import_module(f"sitemetrics.workload.{m}")
names = [k for k, fn in registry.QUERIES.items() if fn.__module__.rsplit(".", 1)[1] in mods]
sys.argv = ["check", sf, *names]
sys.exit(min(check.main(), 1))
