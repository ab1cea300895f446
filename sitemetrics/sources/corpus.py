"""A corpus of files to stored rows in one batch: every file is routed, parsed, judged and loaded, or leaves nothing behind.

A batch is staged first and published last. Rows of all tables go to folders of the batch, which no reader opens; then the rejects and
the audit rows are written; the commit row comes at the very end. `read_committed` opens committed batches alone, so that a batch is seen
whole or not at all, whatever table the run stopped in. Repeating an unfinished batch replaces what it left; repeating a committed one
returns its audit. Files are judged one by one: a file that fails has no row in any table, and no other file is held up by it.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemetrics.functions import dates as D
from sitemetrics.functions import vocabulary as V
from sitemetrics.operators.aggregate import exact
from sitemetrics.operators.reuse import written
from sitemetrics.plans import layouts as LY
from sitemetrics.plans.grids import GRID
from sitemetrics.plans.infer import infer
from sitemetrics.sources import store as ST

TABLES = {t.name: t for t in (ST.REVENUE, ST.TRAFFIC, ST.TARGET_MONTHLY, ST.TARGET_DAILY)}
ORIGIN = ["source", "delivered", GRID, "row_idx", "layout"]
AUDIT = (
    "file_name string, status string, reason string, load_type string, grids bigint, unread_grids bigint, read_rows bigint, inserted bigint, skipped bigint,"
    " rejected bigint, report_date date, revenue double, traffic double, target double, pax double, uploaded_at timestamp"
)
COMMIT = "batch_id string, uploaded_at timestamp, files bigint, failed bigint"
REJECTS = f"source string, {GRID} string, layout string, row_idx int, col_idx int, value string, reason string"


@dataclass(frozen=True)
class Rules:
    """What a business knows about its reports: place names, terminals, site columns, units. ``vocab`` lets unknown layouts be inferred."""

    places: dict[str, str]
    terminals: dict[str, str] = field(default_factory=dict)
    years: tuple[int, int] = D.YEARS
    segment: str = "Main"
    site_columns: list[tuple[str, int, int]] = field(default_factory=list)
    block_units: dict[str, str] = field(default_factory=dict)
    first_unit: str | None = None
    own_segments: dict[str, str] = field(default_factory=dict)
    skipped_labels: tuple[str, ...] = ("total",)
    sections: dict[str, str] = field(default_factory=dict)
    unit_segments: dict[str, str] = field(default_factory=dict)
    unit_map: DataFrame | None = None
    vocab: V.Vocab | None = None
    today: dt.date | None = None


def parse_corpus(cells: DataFrame, kinds: DataFrame, rules: Rules) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(rows of each table with their origin, rejects of all layouts, grids that inference turned down with the reason)."""
    present = {row["layout"] for row in kinds.select("layout").distinct().collect()}
    cells, files = LY.by_layout(cells, kinds), written(LY.deliveries(cells), "deliveries")
    of = lambda name: LY.of_layout(cells, name)
    r = rules
    readers = {
        "revenue": {
            "long_revenue": lambda c: LY.read_long_revenue(c, r.places, r.years), "wide_pivot": lambda c: LY.read_wide_pivot(c, r.places, r.years),
            "stacked_blocks": lambda c: LY.read_stacked_blocks(c, r.site_columns, r.block_units, r.segment, r.first_unit or r.segment, r.own_segments, list(r.skipped_labels), r.years),
            "sectioned_table": lambda c: LY.read_sectioned_table(c, r.site_columns, r.sections, None, r.years)},
        "target_monthly": {
            "outlet_day_targets": lambda c: LY.read_outlet_day_targets(c, r.places, r.years),
            "monthly_targets": lambda c: LY.read_monthly_targets(c, r.places, r.unit_segments, r.unit_map, r.segment, r.years)[0]},
        "target_daily": {"daily_targets": lambda c: LY.read_daily_targets(c, r.places)},
        "traffic": LY.traffic_readers(r.places, r.terminals, r.years),
    }
    if not r.site_columns:  # which columns are whose is not known
        present -= {"stacked_blocks", "sectioned_table"}
    if r.unit_map is None:
        present -= {"monthly_targets"}
    tables, losses = {}, []
    for table, own in readers.items():
        parts = {name: read(of(name)) for name, read in own.items() if name in present}
        if parts:
            tables[table] = LY.with_origin(parts, files)
            losses.append(LY.lost_cells(parts))
    none = f"{GRID} string, row_idx int, col_idx int, value string, reason string, layout string"
    lost = reduce(DataFrame.unionByName, losses, cells.sparkSession.createDataFrame([], none))
    turned_down = None
    if r.vocab is not None and "unknown" in present:
        found = infer(of("unknown"), r.vocab, r.today or dt.date.today())
        rows = found.rows.join(files.drop("grid_rows"), GRID).withColumns({"layout": F.lit("inferred"), "preference": F.lit(len(readers["revenue"]))})
        tables["revenue"] = tables["revenue"].unionByName(rows, allowMissingColumns=True) if "revenue" in tables else rows
        line = F.to_json(F.struct("date", "segment", "outlet", "location", "pax", "revenue"))
        lost = lost.unionByName(found.rejected_rows.select(GRID, "row_idx", F.lit(None).cast("int").alias("col_idx"), line.alias("value"), "reason", F.lit("inferred").alias("layout")))
        turned_down = found.grids.where("not accepted").select(GRID, "reason")
    if "revenue" in tables and "aop_daily" in tables["revenue"].columns:  # S20: targets carried by a revenue sheet
        carried = tables["revenue"].where("aop_daily is not null")
        keys = ["location", "outlet", F.lit(r.segment).alias("segment"), F.year("date").alias("year"), F.month("date").alias("month")]
        summed = carried.groupBy("source", "delivered", GRID, "layout", "preference", *keys).agg(F.min("row_idx").alias("row_idx"), F.sum(exact(carried, "aop_daily")).cast("double").alias("aop"))
        tables["target_monthly"] = tables["target_monthly"].unionByName(summed, allowMissingColumns=True) if "target_monthly" in tables else summed
    if turned_down is None:
        turned_down = kinds.where("layout = 'unknown'").select(GRID, F.lit("no known layout").alias("reason"))
    return tables, lost.join(kinds.select(GRID, "source"), GRID), turned_down


def _cleaned(name: str, rows: DataFrame, rules: Rules) -> DataFrame:
    keep = [*ORIGIN, "preference"]
    if name == "revenue":
        # Rows with a target alone belong to the target table.
        return ST.clean_revenue(rows.where("pax is not null or revenue is not null"), keep=keep)
    if name == "traffic":
        return ST.clean_traffic(rows, keep=keep)
    return ST.clean_monthly(rows, rules.segment, keep=keep) if name == "target_monthly" else ST.clean_daily_target(rows, keep=keep)


def _folder(root: str, name: str, batch: str) -> str:
    return f"{root}/{name}/batch_id={batch}"


def commits(spark: SparkSession, root: str) -> DataFrame:
    """One row per committed batch."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{root}/commits/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def committed_ids(spark: SparkSession, root: str) -> list[str]:
    """Ids of the committed batches, oldest first: one for each load ever made, whatever its rows."""
    return [r["batch_id"] for r in commits(spark, root).orderBy("uploaded_at", "batch_id").collect()]


def stored_columns(spec: ST.TableSpec) -> str:
    return f"{spec.schema}, {GRID} string, row_idx int, layout string, batch_id string" + (", year_month int" if spec.partition == "year_month" else "")


def _read(spark: SparkSession, root: str, spec: ST.TableSpec, batches: list[str]) -> DataFrame:
    paths = [_folder(root, spec.name, b) for b in batches]
    if not paths:
        return spark.createDataFrame([], stored_columns(spec))
    return spark.read.schema(stored_columns(spec)).option("basePath", f"{root}/{spec.name}").parquet(*paths)


def read_committed(spark: SparkSession, root: str, spec: ST.TableSpec) -> DataFrame:
    """Rows of committed batches with file, grid, row and layout; the partition column prunes as in other tables."""
    return _read(spark, root, spec, committed_ids(spark, root))


def read_audit(spark: SparkSession, root: str, batch: str) -> DataFrame:
    return spark.read.schema(AUDIT).parquet(_folder(root, "load_audit", batch))


def read_rejects(spark: SparkSession, root: str, batch: str) -> DataFrame:
    return spark.read.schema(REJECTS).parquet(_folder(root, "rejects", batch))


def file_verdicts(cells: DataFrame, kinds: DataFrame, per_grid: DataFrame, turned_down: DataFrame) -> DataFrame:
    """One row per file: source, grids, unread_grids, reason. ``per_grid``: grid_id, n_rows with a whole key.

    A file fails when a sheet of a known layout gives no row, since then a part of what it reports would be missing, and when no sheet
    gives any. Sheets of no known layout beside others are covers and remarks.
    """
    judged = kinds.join(per_grid, GRID, "left").join(turned_down.withColumnRenamed("reason", "__why"), GRID, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    empty = (F.col("layout") != "unknown") & (F.col("n_rows") == 0)
    first = lambda cond, c: F.min_by(F.when(cond, c), F.when(cond, F.col(GRID)))
    per_file = judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("grids"), F.count_if(F.col("n_rows") == 0).alias("unread_grids"), F.sum("n_rows").alias("__rows"),
        first(empty, F.concat(F.lit("no usable row in "), F.col("layout"), F.lit(" sheet "), F.col(GRID))).alias("__empty"),
        first(F.col("n_rows") == 0, F.coalesce("__why", F.lit("no known layout"))).alias("__unknown"))
    reason = F.coalesce("__empty", F.when(F.col("__rows") == 0, F.col("__unknown")))
    return per_file.select("source", "grids", "unread_grids", reason.alias("reason"))


def _touched(rows: DataFrame, column: str) -> Column:
    """Condition on the partitions that a batch holds, as literals, so that others are not opened: months or years, not keys."""
    values = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().collect()]
    return F.col(column).isin(values) if values else F.lit(False)


def ingest_corpus(spark: SparkSession, root: str, cells: DataFrame, rules: Rules, batch: str, at: dt.datetime) -> DataFrame:
    """Load a corpus of cells (grid_id, source, sheet, row_idx, col_idx, value[, delivered]) as one batch; returns one audit row per file.

    Of a key that several files of the batch hold the first delivered file's row counts, inside a file the better layout's; keys that are
    stored already are skipped. Rows and cells that become no fact are kept with their reason (:func:`read_rejects`).
    """
    if batch in committed_ids(spark, root):
        return read_audit(spark, root, batch)
    cells = written(cells, "cells")
    kinds = written(LY.grid_kinds(cells, rules.places, rules.years), "kinds")
    tables, lost, turned_down = parse_corpus(cells, kinds, rules)
    staged, whole = {}, [spark.createDataFrame([], f"{GRID} string, n_rows bigint")]
    for name, spec in TABLES.items():
        if name not in tables:
            spark.createDataFrame([], stored_columns(spec)).drop("batch_id").write.mode("overwrite").parquet(_folder(root, name, batch))
            continue
        rows = tables[name]
        staged[name] = written(ST.with_partition(_cleaned(name, rows, rules), spec), name)
        whole.append(staged[name].where(ST.has_key(spec.key)).groupBy(GRID).agg(F.count(F.lit(1)).alias("n_rows")))
    per_grid = reduce(DataFrame.unionByName, whole).groupBy(GRID).agg(F.sum("n_rows").alias("n_rows"))
    files = written(file_verdicts(cells, kinds, per_grid, turned_down), "files")
    good = files.where("reason is null").select("source")
    earlier = committed_ids(spark, root)
    stamp = {"source_file": F.col("source"), "uploaded_at": F.lit(at)}
    keyless = []
    counts = [spark.createDataFrame([], "source string, load_type string, inserted bigint, report_date date, revenue decimal(38,6), traffic decimal(38,6), target decimal(38,6), pax decimal(38,6)")]
    for name, rows in staged.items():
        spec = TABLES[name]
        stored = _read(spark, root, spec, earlier).where(_touched(rows, spec.partition)) if earlier else None
        mine = rows.join(good, "source", "left_semi")
        order = [F.col("delivered").asc_nulls_last(), F.asc("source"), F.desc("preference") if name == "traffic" else F.asc("preference"), F.asc(GRID), F.asc("row_idx"), *[F.asc(c) for c in rows.columns if c not in (*spec.key, *ORIGIN, "preference")]]
        fresh = ST.keep_one(mine.where(ST.has_key(spec.key)), list(spec.key), *order)
        if stored is not None:
            fresh = fresh.join(stored.select(*spec.key), list(spec.key), "left_anti")
        missing = [c for c in spark.createDataFrame([], spec.schema).columns if c not in fresh.columns and c not in stamp]
        fresh = fresh.withColumns(stamp | {c: F.lit(None).cast(dict(spark.createDataFrame([], spec.schema).dtypes)[c]) for c in missing})
        columns = [*spark.createDataFrame([], spec.schema).columns, GRID, "row_idx", "layout"] + (["year_month"] if spec.partition == "year_month" else [])
        fresh.select(*columns).hint("rebalance", spec.partition).write.mode("overwrite").partitionBy(spec.partition).parquet(_folder(root, name, batch))
        line = F.to_json(F.struct(*spec.key))
        keyless.append(rows.where(~ST.has_key(spec.key)).select("source", GRID, "layout", "row_idx", F.lit(None).cast("int").alias("col_idx"), line.alias("value"), F.lit(f"key part of {name} missing").alias("reason")))
        put = _read(spark, root, spec, [batch])
        day = F.min("date") if "date" in spec.key else F.min(F.make_date("year", "month", F.lit(1)))
        sums = {n: (F.sum(exact(put, c)) if n == ("target" if name.startswith("target") else name) else F.lit(0)) for n, c in (("revenue", spec.measure), ("traffic", spec.measure), ("target", spec.measure))}
        pax = F.sum(exact(put, "pax")) if "pax" in put.columns else F.lit(0)
        counts.append(put.groupBy(F.col("source_file").alias("source")).agg(
            F.lit(spec.load_type).alias("load_type"), F.count(F.lit(1)).alias("inserted"), day.alias("report_date"),
            *[F.coalesce(v, F.lit(0)).cast("decimal(38,6)").alias(n) for n, v in sums.items()], F.coalesce(pax, F.lit(0)).cast("decimal(38,6)").alias("pax")))
    names = [c.split()[0] for c in REJECTS.split(", ")]
    rejects = reduce(DataFrame.unionByName, [lost.select(*names), *[k.select(*names) for k in keyless]])
    rejects.write.mode("overwrite").parquet(_folder(root, "rejects", batch))
    rejected = read_rejects(spark, root, batch).groupBy("source").agg(F.count(F.lit(1)).alias("rejected"))
    seen = reduce(DataFrame.unionByName, [files.select("source").limit(0)] + [t.where(ST.has_key(TABLES[n].key)).select("source") for n, t in staged.items()]).groupBy("source").agg(F.count(F.lit(1)).alias("read_rows"))
    loaded = reduce(DataFrame.unionByName, counts).groupBy("source").agg(
        F.array_join(F.array_sort(F.collect_set("load_type")), "+").alias("load_type"), F.sum("inserted").alias("inserted"), F.min("report_date").alias("report_date"),
        *[F.sum(c).cast("double").alias(c) for c in ("revenue", "traffic", "target", "pax")])
    none = lambda c, kind="bigint": F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    audit = files.join(seen, "source", "left").join(loaded, "source", "left").join(rejected, "source", "left").select(
        F.col("source").alias("file_name"), F.when(F.col("reason").isNull(), "Available").otherwise("Failed").alias("status"), "reason", "load_type", "grids", "unread_grids",
        none("read_rows"), none("inserted"), F.when(F.col("reason").isNull(), F.coalesce("read_rows", F.lit(0)) - F.coalesce("inserted", F.lit(0))).otherwise(0).cast("bigint").alias("skipped"),
        none("rejected"), "report_date", none("revenue", "double"), none("traffic", "double"), none("target", "double"), none("pax", "double"), F.lit(at).alias("uploaded_at"))
    audit.write.mode("overwrite").parquet(_folder(root, "load_audit", batch))
    _commit(spark, root, batch, at)
    return read_audit(spark, root, batch)


def _commit(spark: SparkSession, root: str, batch: str, at: dt.datetime) -> None:
    """The batch counts from here on. A second writer of the same batch fails instead of committing twice."""
    done = read_audit(spark, root, batch).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "Failed").alias("failed"))
    row = done.select(F.lit(batch).alias("batch_id"), F.lit(at).alias("uploaded_at"), "files", "failed")
    row.write.mode("errorifexists").parquet(f"{root}/commits/{batch}")
