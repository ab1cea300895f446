"""The fact store: date scans and keyed insert-or-ignore loads into partitioned Parquet tables.

One writer per table; a load appends only rows whose key is not stored yet.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sitemetrics.functions import numbers as NB
from sitemetrics.functions.dates import any_date
from sitemetrics.operators import dims
from sitemetrics.operators.aggregate import exact
from sitemetrics.operators.ordered import keep_one
from sitemetrics.operators.reuse import stage_path, written
from sitemetrics.operators.select import on_days, within


@dataclass(frozen=True)
class TableSpec:
    """Key, measure and schema of a stored table."""

    name: str
    key: tuple[str, ...]
    schema: str
    measure: str
    load_type: str
    partition: str = "year_month"


STAMP = "source_file string, uploaded_at timestamp"
REVENUE = TableSpec(
    "revenue", ("date", "segment", "outlet", "location"),
    f"date date, segment string, business_unit string, outlet string, location string, pax double, revenue double, aop double, traffic double, {STAMP}", "revenue", "Revenue")
TRAFFIC = TableSpec(
    "traffic", ("date", "location", "terminal", "granularity"),
    f"date date, period_end date, granularity string, location string, terminal string, traffic double, {STAMP}", "traffic", "Traffic")
TARGET_MONTHLY = TableSpec(
    "target_monthly", ("location", "outlet", "year", "month"),
    f"location string, segment string, business_unit string, outlet string, year int, month int, aop double, {STAMP}", "aop", "AOP", "year")
TARGET_DAILY = TableSpec("target_daily", ("location", "date"), f"location string, date date, aop double, {STAMP}", "aop", "AOP")
HISTORY = "file_name string, report_date date, row_count bigint, primary_total double, total_pax double, uploaded_at timestamp, status string, load_type string"


# --- scans -----------------------------------------------------------------------------------------------------


def for_date(facts: DataFrame, day: dt.date) -> DataFrame:
    return facts.where(on_days(facts, [day]))


def for_dates(facts: DataFrame, days: list[dt.date]) -> DataFrame:
    return facts.where(on_days(facts, days))


def for_range(facts: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Closed range, bounds in either order."""
    return facts.where(within(facts, start, end))


def stored_schema(spec: TableSpec) -> str:
    return f"{spec.schema}, year_month int" if spec.partition == "year_month" else spec.schema


def read_table(spark: SparkSession, root: str, spec: TableSpec) -> DataFrame:
    """Stored rows, an empty frame before the first load."""
    schema = stored_schema(spec)
    try:
        return spark.read.schema(schema).parquet(f"{root}/{spec.name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # any other fault must not look like an empty store
            raise
        return spark.createDataFrame([], schema)


# --- cleaning before a load ------------------------------------------------------------------------------------


def stamped(df: DataFrame, source_file: str, at: dt.datetime) -> DataFrame:
    return df.withColumns({"source_file": F.lit(source_file), "uploaded_at": F.lit(at)})


def clean_revenue(df: DataFrame, segment_map: DataFrame | None = None, keep: list[str] = ()) -> DataFrame:
    """Trimmed keys, canonical segment and unit, coerced numbers. Canonicalised before duplicates are looked for."""
    have = set(df.columns)
    number = lambda c: NB.float_or_null(c) if c in have else F.lit(None).cast("double")
    keys = df.withColumns({c: F.trim(F.col(c).cast("string")) for c in ("segment", "outlet", "location")}).withColumn("date", any_date("date"))
    tagged = dims.canonical_segment(keys, segment_map) if segment_map is not None else keys
    unit = F.col("business_unit") if "business_unit" in tagged.columns else F.col("segment")
    return tagged.select("date", "segment", unit.alias("business_unit"), "outlet", "location", *[number(c).alias(c) for c in ("pax", "revenue", "aop", "traffic")], *keep)


def clean_traffic(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Rows with a usable value; no terminal is the empty text, the granularity defaults to daily."""
    have = set(df.columns)
    text = lambda c: F.trim(F.col(c).cast("string")) if c in have else F.lit(None).cast("string")
    term, gran = text("terminal"), F.lower(text("granularity"))
    return df.select(
        any_date("date").alias("date"), (any_date("period_end") if "period_end" in have else F.lit(None).cast("date")).alias("period_end"),
        F.when(F.coalesce(gran, F.lit("")) == "", "daily").otherwise(gran).alias("granularity"), F.trim("location").alias("location"),
        F.when(F.lower(F.coalesce(term, F.lit("nan"))) == "nan", "").otherwise(term).alias("terminal"), NB.float_or_null("traffic").alias("traffic"), *keep,
    ).where("traffic is not null")


def clean_monthly(df: DataFrame, segment: str, keep: list[str] = ()) -> DataFrame:
    have = set(df.columns)
    text = lambda c, d: F.trim(F.col(c).cast("string")) if c in have else F.lit(d).cast("string")
    return df.select(
        F.trim("location").alias("location"), text("segment", segment).alias("segment"), text("business_unit", None).alias("business_unit"), F.trim("outlet").alias("outlet"),
        F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"), NB.float_or_null("aop").alias("aop"), *keep).where("aop is not null")


def clean_daily_target(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    return df.select(F.trim("location").alias("location"), any_date("date").alias("date"), NB.float_or_null("aop").alias("aop"), *keep).where("aop is not null")


def embedded_targets(rows: DataFrame, segment: str) -> DataFrame:
    """Daily targets carried by a revenue sheet, summed to outlet months."""
    kept = rows.where("aop_daily is not null")
    return kept.groupBy("location", "outlet", F.lit(segment).alias("segment"), F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum(exact(kept, "aop_daily")).cast("double").alias("aop"))


# --- keyed insert-or-ignore ------------------------------------------------------------------------------------


def has_key(key: tuple[str, ...] | list[str]) -> Column:
    """All parts of the key are there; rows without can't be told apart from one another and are rejected."""
    out = F.lit(True)
    for c in key:
        out = out & F.col(c).isNotNull()
    return out


def delivery_order(df: DataFrame, key: tuple[str, ...] | list[str]) -> list[Column]:
    """First delivered first: time, file, row of the file where the rows have these; the values only break ties."""
    known = [c for c in ("uploaded_at", "source_file", "row_idx") if c in df.columns]
    return [F.col(c).asc_nulls_last() for c in [*known, *[c for c in df.columns if c not in key and c not in known]]]


def new_rows(stored: DataFrame, incoming: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Rows to add: the first in ``order`` per key inside the batch, unless the key is stored already. Rows without a key part are left out."""
    return keep_one(incoming.where(has_key(key)), key, *order).join(stored.select(*key), key, "left_anti")


def load_counts(incoming: DataFrame, added: DataFrame) -> DataFrame:
    """(inserted, skipped, total_rows) of one load."""
    tagged = incoming.agg(F.count(F.lit(1)).alias("t")).withColumn("i", F.lit(0)).unionByName(added.agg(F.count(F.lit(1)).alias("i")).withColumn("t", F.lit(0)))
    return tagged.agg(F.sum("i").alias("inserted"), F.sum("t").alias("total_rows")).select("inserted", (F.col("total_rows") - F.col("inserted")).alias("skipped"), "total_rows")


def audit_row(added: DataFrame, spec: TableSpec, source_file: str, at: dt.datetime) -> DataFrame:
    """Load history row with totals over the rows really added."""
    day = F.min("date") if "date" in added.columns else F.min(F.make_date("year", "month", F.lit(1)))
    pax = F.sum(exact(added, "pax")) if "pax" in added.columns else F.lit(0)
    return added.agg(
        day.alias("report_date"), F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(exact(added, spec.measure)), F.lit(0)).cast("double").alias("primary_total"),
        F.coalesce(pax, F.lit(0)).cast("double").alias("total_pax"),
    ).select(F.lit(source_file).alias("file_name"), "report_date", "row_count", "primary_total", "total_pax", F.lit(at).alias("uploaded_at"),
             F.lit("Available").alias("status"), F.lit(spec.load_type).alias("load_type"))


def with_partition(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.withColumn("year_month", F.year("date") * 100 + F.month("date")) if spec.partition == "year_month" else df


def _totals(df: DataFrame, spec: TableSpec) -> list[Column]:
    """What the audit says of the rows really added."""
    day = F.min("date") if "date" in df.columns else F.min(F.make_date("year", "month", F.lit(1)))
    pax = F.sum(exact(df, "pax")) if "pax" in df.columns else F.lit(0).cast("double")
    return [
        day.alias("report_date"), F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(exact(df, spec.measure)), F.lit(0)).cast("double").alias("primary_total"),
        (F.coalesce(pax, F.lit(0)).cast("double") if "pax" in df.columns else F.max(pax)).alias("total_pax"),
    ]


def load(spark: SparkSession, root: str, spec: TableSpec, cleaned: DataFrame, source_file: str, at: dt.datetime, *order: Column, replay: bool = False) -> DataFrame:
    """Append the new rows of a cleaned batch, write the audit row, return the counts. Repeating a load adds nothing.

    ``replay`` says that an attempt at this very file and time may have stored rows and stopped before its audit row: the audit then tells
    of all rows that bear this file and time.

    Rows with a NULL in their key go to ``rejects`` instead. The batch is staged once; the partitions it touches, its size and its keyless
    rows are observed on that write, the audit's totals on the append itself, so no job only counts. Both are last stages of their jobs,
    where a task that is repeated after a lost executor counts once. Stored rows are read from the touched partitions alone. If the audit
    row is lost, :func:`derived_history` gives it from the stored rows.
    """
    stage, seen, put = stage_path(spark, spec.name), Observation(), Observation()
    batch = with_partition(stamped(cleaned, source_file, at), spec)
    batch.observe(
        seen, F.count(F.lit(1)).alias("total"), F.count_if(~has_key(spec.key)).alias("lost"), F.collect_set(spec.partition).alias("touched")
    ).write.parquet(stage)
    incoming = spark.read.schema(batch.schema).parquet(stage)
    size = seen.get
    stored = read_table(spark, root, spec).where(F.col(spec.partition).isin(list(size["touched"])) if size["touched"] else F.lit(False))
    columns = [c for c in spark.createDataFrame([], stored_schema(spec)).columns if c in incoming.columns]
    # The files of the table are listed when it is read, so the append does not read what it writes.
    added = new_rows(stored, incoming, list(spec.key), *(order or delivery_order(incoming.drop(spec.partition) if spec.partition == "year_month" else incoming, spec.key))).select(*columns)
    added.hint("rebalance", spec.partition).observe(put, *_totals(added, spec)).write.mode("append").partitionBy(spec.partition).parquet(f"{root}/{spec.name}")
    if size["lost"]:
        lost = incoming.where(~has_key(spec.key)).select(
            F.lit(spec.name).alias("table_name"), "source_file", "uploaded_at", F.lit("key part missing").alias("reason"), F.to_json(F.struct(*spec.key)).alias("key"))
        lost.write.mode("append").parquet(f"{root}/rejects")
    got = put.get.copy()
    if replay:
        mine = read_table(spark, root, spec).where(F.col(spec.partition).isin(list(size["touched"])) if size["touched"] else F.lit(False))
        mine = mine.where((F.col("source_file") == source_file) & (F.col("uploaded_at") == F.lit(at)))
        got = mine.agg(*_totals(mine, spec)).first().asDict()
    row = (source_file, got["report_date"], got["row_count"], got["primary_total"], got["total_pax"] or 0.0, at, "Available", spec.load_type)
    spark.createDataFrame([row], HISTORY).write.mode("append").parquet(f"{root}/load_history")
    inserted, total = put.get["row_count"], size["total"]
    return spark.createDataFrame([(inserted, total - inserted, total)], "inserted bigint, skipped bigint, total_rows bigint")


def rejects(spark: SparkSession, root: str) -> DataFrame:
    """Rows that loads have turned away, with the reason; an empty frame while there are none."""
    schema = "table_name string, source_file string, uploaded_at timestamp, reason string, key string"
    try:
        return spark.read.schema(schema).parquet(f"{root}/rejects")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def derived_history(stored: DataFrame, spec: TableSpec) -> DataFrame:
    """The history rows of all loads that added something, from the stored rows alone."""
    day = F.min("date") if "date" in stored.columns else F.min(F.make_date("year", "month", F.lit(1)))
    pax = F.sum(exact(stored, "pax")) if "pax" in stored.columns else F.lit(0)
    return stored.groupBy(F.col("source_file").alias("file_name"), "uploaded_at").agg(
        day.alias("report_date"), F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(exact(stored, spec.measure)), F.lit(0)).cast("double").alias("primary_total"),
        F.coalesce(pax, F.lit(0)).cast("double").alias("total_pax"),
    ).select("file_name", "report_date", "row_count", "primary_total", "total_pax", "uploaded_at", F.lit("Available").alias("status"), F.lit(spec.load_type).alias("load_type"))


def newest_first(loads: DataFrame) -> DataFrame:
    return loads.orderBy(F.desc("uploaded_at"), "file_name")


def is_loaded(spark: SparkSession, root: str, source_file: str, at: dt.datetime) -> bool:
    """Whether the audit has this file and time: its rows were stored before."""
    try:
        log = spark.read.schema(HISTORY).parquet(f"{root}/load_history")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return not log.where((F.col("file_name") == source_file) & (F.col("uploaded_at") == F.lit(at))).isEmpty()


def history(spark: SparkSession, root: str) -> DataFrame:
    """Load history, newest first."""
    return newest_first(spark.read.schema(HISTORY).parquet(f"{root}/load_history"))


def retagged(stored: DataFrame, segment_map: DataFrame) -> DataFrame:
    """Stored rows under the current segment rules: only outdated rows change; rows that then meet on one key leave the first stored."""
    columns = stored.columns
    marked = stored.withColumns({"__old_s": F.col("segment"), "__old_u": F.col("business_unit")})
    fixed = dims.canonical_segment(marked, segment_map)
    changed = ~F.col("segment").eqNullSafe(F.col("__old_s")) | ~F.col("business_unit").eqNullSafe(F.col("__old_u"))
    rows = fixed.withColumns({"__moved": changed}).select(*columns, "__moved")
    return keep_one(rows, list(REVENUE.key), F.col("uploaded_at").asc_nulls_last(), F.asc("__moved"), F.col("source_file").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in columns if c not in REVENUE.key]).drop("__moved")


def retag_segments(spark: SparkSession, root: str, segment_map: DataFrame) -> DataFrame:
    """Rewrite the months that hold rows with outdated segments or missing units; returns those months. Other rows keep their values."""
    stored = read_table(spark, root, REVENUE)
    months = [r[0] for r in dims.needs_segment_fix(stored, segment_map).select("year_month").distinct().orderBy("year_month").collect()]
    # Staged, since the months are read and overwritten.
    fixed = written(retagged(stored.where(F.col("year_month").isin(months) if months else F.lit(False)), segment_map), REVENUE.name)
    fixed.hint("rebalance", "year_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year_month").parquet(f"{root}/{REVENUE.name}")
    return spark.createDataFrame([(m,) for m in months], "year_month int")


def best_candidate(grids: DataFrame) -> DataFrame:
    """Best grid per source by confidence, then rows; ``others`` counts further accepted grids worth a warning."""
    ok = grids.where("accepted")
    per = ok.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("confidence", "n_rows", "grid_id")).alias("b"))
    return per.select("source", F.col("b.grid_id").alias("grid_id"), F.col("b.confidence").alias("confidence"), F.col("b.n_rows").alias("n_rows"), (F.col("n") - 1).alias("others"))
