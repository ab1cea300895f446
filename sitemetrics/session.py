"""Local session for tests, the bench and the checker. On a cluster use the session you are given."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(app: str, cpus: int = 8, memory: str = "12g", folder: str | None = None) -> SparkSession:
    """A single-machine session. `folder` takes the stage tables; a new temporary one if not given (one machine, so it is shared)."""
    folder = folder or tempfile.mkdtemp(prefix="sitemetrics-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{folder}")
        .config("spark.sql.warehouse.dir", f"file://{folder}/warehouse")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
