"""Incremental idempotent ingest: late, repeated and replayed deliveries change neither stored rows nor the audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitemetrics.sources import store

DELIVERED = "__delivered"


def ingest_stream(
    source: DataFrame, root: str, spec: store.TableSpec, clean: Callable[[DataFrame], DataFrame], checkpoint: str, name: str, *order: Column,
    key: list[str] | None = None, event_time: str | None = None, lateness: str = "1 hour",
) -> StreamingQuery:
    """Run every micro-batch through ``clean`` and the keyed load.

    With ``key`` and ``event_time`` rows repeated within ``lateness`` are dropped by watermarked state before the load. A batch bears the
    time of its own rows: the event time, else the time of the files (:func:`file_source`). So a batch that is run again after a failure
    has the file name and time of its first attempt: if that one has its audit row nothing is done; if it stopped earlier, the missing
    rows are added and the audit row tells of all of them.
    """
    if key and event_time:
        source = distinct_events(source, key, event_time, lateness)
    clock = event_time or DELIVERED
    if clock not in source.columns:
        raise ValueError("the stream needs an event time or the files' times of file_source")

    def load_batch(batch: DataFrame, epoch: int) -> None:
        spark, file = batch.sparkSession, f"{name}-{epoch}"
        at = batch.agg(F.max(F.col(clock).cast("timestamp"))).first()[0]
        if at is not None and not store.is_loaded(spark, root, file, at):
            store.load(spark, root, spec, clean(batch), file, at, *order, replay=True)

    return source.writeStream.foreachBatch(load_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_source(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", glob: str = "*", per_batch: int = 100) -> DataFrame:
    """Files of a folder as they arrive, with the time of each."""
    files = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(folder)
    return files.select("*", F.col("_metadata.file_modification_time").alias(DELIVERED))


def distinct_events(events: DataFrame, key: list[str], event_time: str, lateness: str) -> DataFrame:
    """Event-shaped input: one row per key within the lateness, with bounded state."""
    return events.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(key)
