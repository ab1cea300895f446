"""Known report layouts: cell grids to long facts. Every function handles all grids of a corpus at once.

Header positions and column meanings are tables of one row per grid or grid column; they are written once
(``materialise``) so that the passes over the cells stay separate, short plans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import dates as D
from sitemetrics.functions import labels as L
from sitemetrics.functions import numbers as NB
from sitemetrics.functions import vocabulary as V
from sitemetrics.operators.ordered import fill_down, keep_one, running_count
from sitemetrics.operators.reuse import materialise, stage_path, written
from sitemetrics.operators.terms import found_terms, terms_table
from sitemetrics.plans.grids import GRID, fill_across, filled, rows_as_columns

KEY = ["date", "segment", "outlet", "location"]
TRAFFIC_KEY = ["date", "location", "terminal", "granularity"]
TRAFFIC = ["date", "period_end", "granularity", "location", "terminal", "traffic"]

# Labels of the layouts.
METRIC_LABELS = ["pax", "revenue"]
DAILY_TARGET_LABEL = "sum of aop"
BLOCK_MARKER = "Revenue of:"
DEPARTURE_ARRIVAL = ["dep", "arr"]
ARRIVAL_DEPARTURE = ["arrival", "arr", "departure", "dep"]
ROLLUP_PREFIX = r"^(sub total|g\.?\s?total|grand total)"
STOP_LABELS = ["total", "full month", "avg. daily", "average", "avg", "growth", "pax count", "arrival", "departure", "arrivals", "departures"]
LAKH_CELL = 100000.0


@dataclass(frozen=True)
class Parsed:
    """What one layout gives. ``values``: facts with the grid and row that they come from; ``rejects``: cells (or whole rows, with no
    column) of its data area that became no fact, each with its reason: grid_id, row_idx, col_idx, value, reason.

    ``sums`` are added up per key inside a file; without, the smallest sheet's last row of a key counts.
    """

    values: DataFrame
    rejects: DataFrame
    keys: list[str]
    measures: list[str]
    sums: dict[str, Column] = field(default_factory=dict)

    def per_file(self, cells: DataFrame) -> DataFrame:
        """One row per key and file, with source, delivered, grid_id and row_idx (the first ones, where several cells add up)."""
        known = self.values.join(deliveries(cells), GRID)
        if not self.sums:
            one = keep_one(known, ["source", *self.keys], F.asc("grid_rows"), F.asc(GRID), F.desc("row_idx"))
            return one.select("source", "delivered", GRID, "row_idx", *self.keys, *self.measures)
        first = F.min(F.struct(GRID, "row_idx"))
        summed = known.groupBy("source", *self.keys).agg(
            F.min("delivered").alias("delivered"), first.alias("__at"), *[F.sum(c.cast("decimal(28,6)")).cast("double").alias(n) for n, c in self.sums.items()])
        return summed.select("source", "delivered", f"__at.{GRID}", "__at.row_idx", *self.keys, *self.sums)

    def rows(self, cells: DataFrame) -> DataFrame:
        """One row per key over all files: the first delivered file's."""
        if self.sums:
            return summed_per_file(self.values, cells, self.keys, self.sums)
        return last_per_key(with_grid_rows(self.values, cells), self.keys).select(*self.keys, *self.measures)


def _split(body: DataFrame, needs: dict[str, str | Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that have all the columns, rows that lack one with the first one's reason)."""
    reason = F.coalesce(*[F.when(F.col(c).isNull(), r if isinstance(r, Column) else F.lit(r)) for c, r in needs.items()])
    value = F.col("value") if "value" in body.columns else F.to_json(F.struct(*[F.col(c) for c in body.columns if c not in (GRID, "row_idx", *needs)]))
    column = F.col("col_idx") if "col_idx" in body.columns else F.lit(None).cast("int").alias("col_idx")
    lacking = body.withColumn("__reason", reason).where("__reason is not null")
    return body.where(" and ".join(f"{c} is not null" for c in needs)), lacking.select(GRID, "row_idx", column, value.alias("value"), F.col("__reason").alias("reason"))


# Reasons of rejected cells.
NO_DATE, NO_NUMBER, NO_PLACE, OTHER_COLUMN = "unreadable date", "not a number", "no known location", "column without a meaning"


def _header(cells: DataFrame, base: DataFrame, offsets: dict[str, int]) -> DataFrame:
    """One row per (grid, column) with the texts of the rows at ``base_row + offset``."""
    near = filled(cells).join(base.select(GRID, "base_row"), GRID)
    at = lambda o: F.max(F.when(F.col("row_idx") == F.col("base_row") + o, F.col("value")))
    wanted = near.where(F.col("row_idx").between(F.col("base_row") + min(offsets.values()), F.col("base_row") + max(offsets.values())))
    return wanted.groupBy(GRID, "col_idx").agg(*[at(o).alias(n) for n, o in offsets.items()])


def _first_row(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy(GRID).agg(F.min("row_idx").alias("base_row"))


def _below(cells: DataFrame, base: DataFrame, skip: int = 0) -> DataFrame:
    return filled(cells).join(base.select(GRID, "base_row"), GRID).where(F.col("row_idx") > F.col("base_row") + skip).drop("base_row")


def _place(c, places: dict[str, str]) -> Column:
    return L.vocabulary_match(c, places)


def deliveries(cells: DataFrame) -> DataFrame:
    """(grid_id, source, delivered, grid_rows): the file of every grid; ``delivered`` is NULL where the cells don't have it."""
    if set(cells.columns) == {GRID, "source", "delivered", "grid_rows"}:
        return cells
    when = F.col("delivered") if "delivered" in cells.columns else F.lit(None)
    return cells.groupBy(GRID).agg(
        F.min(F.coalesce("source", F.col(GRID))).alias("source"), F.min(when.cast("timestamp")).alias("delivered"), (F.max("row_idx") + 1).alias("grid_rows"))


def last_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first delivered file wins a key; inside it the smallest sheet's, and of a sheet the last row."""
    return keep_one(df, keys, F.col("delivered").asc_nulls_last(), F.asc("source"), F.asc("grid_rows"), F.asc(GRID), F.desc("row_idx"))


def with_grid_rows(df: DataFrame, cells: DataFrame) -> DataFrame:
    return df.join(deliveries(cells), GRID)


def summed_per_file(values: DataFrame, cells: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Exact sums per key inside each file; of a key that several files carry, the first delivered file's figure stays."""
    per_file = values.join(deliveries(cells), GRID).groupBy("source", *keys).agg(
        F.min("delivered").alias("delivered"), *[F.sum(c.cast("decimal(28,6)")).cast("double").alias(n) for n, c in sums.items()])
    return keep_one(per_file, keys, F.col("delivered").asc_nulls_last(), F.asc("source")).select(*keys, *sums)


def _down_to(cells: DataFrame, depth: int | None) -> DataFrame:
    """Cells of the first rows; all of them without a depth."""
    return cells if depth is None else cells.where(F.col("row_idx") < depth)


# --- revenue layouts -------------------------------------------------------------------------------------------


def alias_table(cells: DataFrame, aliases: dict[str, list[str]], required: list[str], depth: int | None = None) -> DataFrame:
    """Plain table under a header found by column aliases: one row per data row, one text column per role.

    The header is the row naming the most roles, the first of equals; an alias may equal or be contained in a label.
    """
    head = filled(_down_to(cells, depth)).withColumn("t", F.lower(F.trim("value")))
    exact, part = F.lit(None).cast("string"), F.lit(None).cast("string")
    for role, names in reversed(list(aliases.items())):
        exact = F.when(F.col("t").isin(names), role).otherwise(exact)
        for n in reversed(names):
            part = F.when(F.col("t").contains(n), role).otherwise(part)
    named = head.select(GRID, "row_idx", "col_idx", exact.alias("exact"), part.alias("part")).withColumn("role", F.coalesce("exact", "part")).where("role is not null")
    one = named.groupBy(GRID, "row_idx", "role").agg(F.min(F.struct(F.col("exact").isNull().alias("p"), "col_idx")).alias("b")).select(
        GRID, "row_idx", "role", F.col("b.col_idx").alias("col_idx"))
    per_row = one.groupBy(GRID, "row_idx").agg(F.count(F.lit(1)).alias("k"), *[F.bool_or(F.col("role") == r).alias(f"has_{r}") for r in required])
    fit = F.lit(True)
    for r in required:
        fit = fit & F.col(f"has_{r}")
    best = per_row.where(fit).groupBy(GRID).agg(F.max(F.struct("k", (-F.col("row_idx")).alias("r"))).alias("b")).select(GRID, (-F.col("b.r")).alias("base_row"))
    best = materialise(best)
    columns = materialise(one.join(best, GRID).where("row_idx = base_row").select(GRID, "col_idx", "role"))
    data = _below(cells, best).join(columns, [GRID, "col_idx"])
    return data.groupBy(GRID, "row_idx").agg(*[F.max(F.when(F.col("role") == r, F.col("value"))).alias(r) for r in aliases])


def read_long_revenue(cells: DataFrame, places: dict[str, str], years: tuple[int, int] = D.YEARS) -> Parsed:
    """Long sheets with date, segment, outlet, location, pax, revenue under known header names."""
    t = alias_table(cells, V.COLUMN_ALIASES, ["date", "outlet"])
    read = t.select(
        GRID, "row_idx", *[F.col(c).alias(f"text_{c}") for c in t.columns if c not in (GRID, "row_idx")], D.text_date("date", years).alias("date"),
        F.trim("segment").alias("segment"), F.trim("outlet").alias("outlet"), F.coalesce(_place("location", places), F.trim("location")).alias("location"),
        *[NB.messy_number(m).alias(m) for m in V.METRICS],
    ).withColumn("amount", F.coalesce("pax", "revenue"))
    kept, lost = _split(read, {"date": NO_DATE, "amount": "neither customers nor revenue"})
    return Parsed(kept.select(GRID, "row_idx", *KEY, *V.METRICS), lost, KEY, list(V.METRICS))


def long_revenue(cells: DataFrame, places: dict[str, str], years: tuple[int, int] = D.YEARS) -> DataFrame:
    return read_long_revenue(cells, places, years).rows(cells)


def row_flags(cells: DataFrame, places: dict[str, str], years: tuple[int, int] = D.YEARS) -> DataFrame:
    """What the labels of every grid row say about the layout: one row per (grid, row), from one pass over the cells.

    All of it is counts and truth values, so that the rows are summed up in hash tables without sorting the cells.
    """
    # Cells of digits and signs alone are no labels, so the label rules need not run on them.
    label = F.when(F.col("value").rlike(r"^[-+0-9.,:/ ]*$"), F.col("value")).otherwise(L.norm_label("value"))
    t, v, first = F.col("t"), F.col("value"), F.col("col_idx") == 0
    head = filled(cells).withColumn("t", label).withColumn("place", L.lookup(t, places).isNotNull())
    return head.groupBy(GRID, "row_idx").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(first).alias("labelled"),
        F.bool_or(F.when(first, D.date_in_text("value", years).isNotNull())).alias("titled"), F.bool_or(first & (t == "total")).alias("total"), F.bool_or(t == "date").alias("dated"), F.bool_or(first & (t == "date")).alias("date_first"),
        F.count_if(t.isin(METRIC_LABELS)).alias("metrics"), F.count_if(t == DAILY_TARGET_LABEL).alias("targets"), F.bool_or(t.contains("pax")).alias("pax"),
        F.bool_or(t.contains("traffic")).alias("traffic"), F.bool_or(t.contains("revenue") | (t == "pax")).alias("revenue"),
        F.bool_or(t.isin("outlet", "sub business", "business", "segment", "outlet name")).alias("business"),
        F.bool_or(t.contains("dom_arr_pax") | t.contains("dom arr pax")).alias("export"), F.bool_or(first & (v == BLOCK_MARKER)).alias("marker"),
        F.bool_or(t == "geographical segment").alias("geo"), F.bool_or(t == "business segment").alias("biz"), F.bool_or(t == "unit id").alias("unit"),
        F.count_if("place").alias("places"), F.count_if(t.isin(DEPARTURE_ARRIVAL)).alias("dep_arr"), F.count_if(t.isin(ARRIVAL_DEPARTURE)).alias("arr_dep"),
        F.bool_or(_type(v).isNotNull()).alias("typed"))


def _pivot_base(flags: DataFrame) -> DataFrame:
    rows = flags.where((F.col("metrics") >= 4) & (F.col("metrics") + F.col("targets") >= F.col("n") * 0.6))
    return _first_row(rows).where("base_row >= 3")


def find_wide_pivot(cells: DataFrame, depth: int | None = None) -> DataFrame:
    """Grids with a row of PAX. / Revenue. labels under three banner rows."""
    return _pivot_base(row_flags(_down_to(cells, depth), {}))


def read_wide_pivot(cells: DataFrame, places: dict[str, str], years: tuple[int, int] = D.YEARS) -> Parsed:
    """One row per day, PAX/Revenue[/Sum of AOP] column groups under location, segment and outlet banners; subtotals skipped."""
    base = materialise(find_wide_pivot(cells))
    h = materialise(_header(cells, base, {"loc": -3, "seg": -2, "out": -1, "metric": 0}).where("col_idx > 0"))
    rollup = lambda c: F.coalesce(L.norm_label(c).rlike(f"(pax|revenue|{DAILY_TARGET_LABEL})$"), F.lit(False))
    known = L.lookup(L.norm_label("loc"), places)
    stop = (known.isNull() & rollup("loc")) | rollup("seg")
    marked = h.select(
        GRID, "col_idx", L.norm_label("metric").alias("m"), known.alias("location"), F.when(~stop, F.col("seg")).alias("segment"),
        F.when(stop, F.lit("")).otherwise(F.col("out")).alias("outlet"), F.when(stop, F.lit(-1)).when(F.col("out").isNotNull(), F.col("col_idx")).alias("start"),
    )
    f = fill_across(marked, ["location", "segment", "outlet", "start"])
    metric = F.when(F.col("col_idx") == F.col("start"), "pax").when(F.col("m") == "revenue", "revenue").when(F.col("m") == DAILY_TARGET_LABEL, "aop_daily")
    groups = materialise(f.withColumn("metric", metric).where("start > 0 and metric is not null and location is not null and segment is not null").groupBy(
        GRID, "location", "segment", "outlet", "start", "metric").agg(F.min("col_idx").alias("col_idx")))
    data = _below(cells, base)
    days = data.where("col_idx = 0").select(GRID, "row_idx", D.text_date("value", years).alias("date"))
    body = data.where("col_idx > 0").join(groups, [GRID, "col_idx"], "left").join(days, [GRID, "row_idx"], "left").withColumn("x", NB.messy_number("value"))
    values, lost = _split(body, {"date": "first cell is not a date", "metric": OTHER_COLUMN, "x": NO_NUMBER})
    measures = ["pax", "revenue", "aop_daily"]
    rows = values.groupBy(GRID, "row_idx", "date", "segment", "outlet", "location", "start").agg(*[F.max(F.when(F.col("metric") == m, F.col("x"))).alias(m) for m in measures])
    return Parsed(rows, lost, KEY, measures)


def wide_pivot(cells: DataFrame, places: dict[str, str], years: tuple[int, int] = D.YEARS) -> DataFrame:
    return read_wide_pivot(cells, places, years).rows(cells)


def _paired(rows: DataFrame, pairs: list[tuple[str, int, int]], number) -> DataFrame:
    """One row per (row, site) from paired pax / revenue columns."""
    sites = F.array(*[F.struct(F.lit(s).alias("location"), number(f"c{p}").alias("pax"), number(f"c{r}").alias("revenue")) for s, p, r in pairs])
    out = rows.withColumn("s", F.explode(sites)).select("*", "s.*").drop("s")
    return out.where("pax is not null or revenue is not null")


def read_stacked_blocks(
    cells: DataFrame, pairs: list[tuple[str, int, int]], categories: dict[str, str], segment: str, first_unit: str,
    own_segments: dict[str, str], skip: list[str], years: tuple[int, int] = D.YEARS,
) -> Parsed:
    """Daily blocks stacked down a sheet; each starts with a marker row carrying the date, category rows set the unit."""
    rows = rows_as_columns(cells, max(max(p, r) for _, p, r in pairs) + 1)
    low = F.lower(F.trim("c0"))
    day = D.text_date("c1", years)
    marked = rows.withColumns({
        "label": low, "date": F.when(F.col("c0") == BLOCK_MARKER, day),
        "business_unit": F.when(F.col("c0") == BLOCK_MARKER, F.lit(first_unit)).otherwise(L.lookup(low, categories)),
    })
    block = running_count(marked, [GRID], "row_idx", F.col("date").isNotNull(), "block")
    # Rows above the first block, remarks and the labels to skip are no data; markers and categories are the table's own structure.
    f = fill_down(block, [GRID], "row_idx", ["date", "business_unit"]).where(
        F.col("c0").isNotNull() & (F.col("c0") != BLOCK_MARKER) & ~F.col("label").isin(list(categories)))
    judged = f.withColumns({"in_block": F.when(F.col("block") > 0, True), "wanted": F.when(~F.col("c0").startswith("*") & ~F.col("label").isin(skip), True)})
    kept, lost = _split(judged, {"in_block": "above the first block", "wanted": "remark or total row"})
    own = L.lookup(F.col("label"), own_segments)
    out = _paired(kept, pairs, NB.messy_number).select(
        GRID, "row_idx", "date", F.coalesce(own, F.lit(segment)).alias("segment"), F.coalesce(own, "business_unit").alias("business_unit"),
        F.trim("c0").alias("outlet"), "location", "pax", "revenue")
    return Parsed(out, lost, KEY, ["business_unit", "pax", "revenue"])


def stacked_blocks(
    cells: DataFrame, pairs: list[tuple[str, int, int]], categories: dict[str, str], segment: str, first_unit: str,
    own_segments: dict[str, str], skip: list[str], years: tuple[int, int] = D.YEARS,
) -> DataFrame:
    return read_stacked_blocks(cells, pairs, categories, segment, first_unit, own_segments, skip, years).rows(cells)


def read_sectioned_table(
    cells: DataFrame, pairs: list[tuple[str, int, int]], segments: dict[str, str] | None = None, aliases: DataFrame | None = None,
    years: tuple[int, int] = D.YEARS,
) -> Parsed:
    """Detail table with section rows (only the label filled), unlabelled subtotals and a total; several source
    lines of one outlet add up. The report date is the first date in the sheet's single-cell title rows.
    """
    n = max(max(p, r) for _, p, r in pairs) + 1
    rows = rows_as_columns(cells, n)
    others = F.coalesce(*[F.col(f"c{i}") for i in range(1, n)])
    titled = D.date_in_text("c0", years)
    lone = F.col("c0").isNotNull() & others.isNull()
    day = rows.where(lone).select(GRID, "row_idx", titled.alias("d")).where("d is not null").groupBy(GRID).agg(F.min_by("d", "row_idx").alias("date"))
    name = F.coalesce(L.lookup(L.norm_label("c0"), segments or {}), F.trim("c0"))
    marked = rows.withColumns({"is_section": lone & titled.isNull(), "segment": F.when(lone & titled.isNull(), name)})
    f = fill_down(marked, [GRID], "row_idx", ["segment"]).where(~F.col("is_section") & F.col("c0").isNotNull()).join(day, GRID, "left")
    judged = f.withColumn("wanted", F.when((F.lower(F.trim("c0")) != "total") & ~F.col("c0").isin("PAX", "Revenue"), True)).where(~lone)
    kept, lost = _split(judged, {"wanted": "total or header row", "date": "sheet without a date"})
    out = _paired(kept, pairs, NB.report_number).select(
        GRID, "row_idx", "date", F.coalesce("segment", F.lit("Unclassified")).alias("segment"), F.trim("c0").alias("outlet"), "location", "pax", "revenue")
    if aliases is not None:
        from sitemetrics.operators.dims import alias_outlet

        out = alias_outlet(out, aliases)
    return Parsed(out, lost, KEY, ["pax", "revenue"], {m: F.col(m) for m in ("pax", "revenue")})


def sectioned_table(
    cells: DataFrame, pairs: list[tuple[str, int, int]], segments: dict[str, str] | None = None, aliases: DataFrame | None = None,
    years: tuple[int, int] = D.YEARS,
) -> DataFrame:
    return read_sectioned_table(cells, pairs, segments, aliases, years).rows(cells)


def check_against_summary(parsed: DataFrame, summary: DataFrame, unit: float = 100000.0) -> DataFrame:
    """Segment x location totals that differ from the report's own summary block.

    ``summary``: segment, location, pax, revenue (in ``unit``). Tolerance: 1 customer; half a unit or 1 %.
    """
    sums = parsed.groupBy("segment", "location").agg(
        *[F.coalesce(F.sum(F.col(m).cast("decimal(28,6)")), F.lit(0)).cast("double").alias(f"parsed_{m}") for m in ("pax", "revenue")])
    s = summary.select("segment", "location", F.coalesce("pax", F.lit(0.0)).alias("summary_pax"), (F.coalesce("revenue", F.lit(0.0)) * unit).alias("summary_revenue"))
    j = s.join(sums, ["segment", "location"], "left").fillna(0.0, ["parsed_pax", "parsed_revenue"])
    off = (F.abs(F.col("parsed_pax") - F.col("summary_pax")) > 1) | (
        F.abs(F.col("parsed_revenue") - F.col("summary_revenue")) > F.greatest(F.lit(unit / 2), F.col("summary_revenue") * 0.01))
    return j.where(off)


# --- target layouts --------------------------------------------------------------------------------------------


def _units(cells: DataFrame, base: DataFrame) -> DataFrame:
    """Scale per grid: 100000 when a row above the header holds that number."""
    return base.select(GRID, "base_row").join(cells.select(GRID, "row_idx", "value"), GRID, "left").groupBy(GRID).agg(
        F.when(F.bool_or((F.col("row_idx") < F.col("base_row")) & (NB.count_number("value") == LAKH_CELL)), LAKH_CELL).otherwise(1.0).alias("unit"))


def _monthly_base(flags: DataFrame) -> DataFrame:
    return _first_row(flags.where("geo and biz and unit"))


def find_monthly_targets(cells: DataFrame, depth: int | None = None) -> DataFrame:
    return _monthly_base(row_flags(_down_to(cells, depth), {}))


def read_monthly_targets(
    cells: DataFrame, places: dict[str, str], unit_segments: dict[str, str], unit_map: DataFrame, segment: str, years: tuple[int, int] = D.YEARS
) -> tuple[Parsed, DataFrame]:
    """Budget sheet with month columns: leaf lines mapped to outlets, and the skipped lines with their reason.

    ``unit_map``: location, unit_id, outlet. Several lines of one outlet add up, one line may feed several outlets.
    Only the first unbroken run of month columns counts.
    """
    base = materialise(find_monthly_targets(cells))
    h = materialise(_header(cells, base, {"label": 0}).withColumns({"t": L.norm_label("label"), "month": D.text_date("label", years)}))
    counted = running_count(h, [GRID], "col_idx", F.col("month").isNotNull(), "k")
    runs = counted.where("month is not null").withColumn("run", F.col("col_idx") - F.col("k"))
    first = runs.groupBy(GRID).agg(F.min("run").alias("run"))
    months = runs.join(first, [GRID, "run"]).select(GRID, "col_idx", "month")
    role = lambda t: F.max(F.when(F.col("t") == t, F.col("col_idx")))
    roles = h.groupBy(GRID).agg(role("geographical segment").alias("g"), role("business segment").alias("b"), role("unit id").alias("u"))
    data = _below(cells, base)
    pick = lambda c: F.max(F.when(F.col("col_idx") == F.col(c), F.col("value")))
    lines = data.join(roles, GRID).groupBy(GRID, "row_idx").agg(pick("g").alias("geo"), pick("b").alias("biz"), pick("u").alias("unit_id")).where(
        "geo is not null and biz is not null")
    tagged = lines.withColumns({"location": L.lookup(L.norm_label("geo"), places), "business_unit": L.lookup(L.norm_label("biz"), unit_segments), "unit_id": F.trim("unit_id")})
    mapped = tagged.join(unit_map.select("location", "unit_id", "outlet"), ["location", "unit_id"], "left")
    reason = (
        F.when(F.col("location").isNull(), "location out of scope").when(F.col("business_unit").isNull(), "business segment out of scope")
        .when(F.col("outlet").isNull(), "no outlet mapped to this unit")
    )
    judged = materialise(mapped.withColumn("reason", reason))
    rejects = judged.where("reason is not null").select(GRID, (F.col("row_idx") + 1).alias("row_number"), F.col("geo").alias("location"), "biz", "unit_id", "reason")
    named = roles.select(GRID, F.explode(F.array("g", "b", "u")).alias("col_idx")).withColumn("named", F.lit(True))
    figures = data.join(named, [GRID, "col_idx"], "left").where("named is null").drop("named").withColumn("x", NB.count_number("value"))
    body = figures.join(months, [GRID, "col_idx"], "left").join(judged.withColumn("leaf", F.lit(True)), [GRID, "row_idx"], "left").join(_units(cells, base), GRID)
    body = body.withColumn("usable", F.when(F.col("reason").isNull(), True))
    ok, lost = _split(body, {"leaf": "line without segment labels", "usable": F.col("reason"), "month": "not in the first run of month columns", "x": NO_NUMBER})
    parts = ok.select(GRID, "row_idx", "location", F.lit(segment).alias("segment"), "business_unit", "outlet", F.year("month").alias("year"), F.month("month").alias("month"), "x", "unit")
    keys = ["location", "segment", "business_unit", "outlet", "year", "month"]
    return Parsed(parts, lost.distinct(), keys, ["aop"], {"aop": F.col("x") * F.col("unit")}), rejects


def monthly_targets(
    cells: DataFrame, places: dict[str, str], unit_segments: dict[str, str], unit_map: DataFrame, segment: str, years: tuple[int, int] = D.YEARS
) -> tuple[DataFrame, DataFrame]:
    parsed, skipped = read_monthly_targets(cells, places, unit_segments, unit_map, segment, years)
    return parsed.rows(cells), skipped


def _daily_base(flags: DataFrame) -> DataFrame:
    return _first_row(flags.where("date_first and places >= 1"))


def find_daily_targets(cells: DataFrame, places: dict[str, str], depth: int | None = None) -> DataFrame:
    return _daily_base(row_flags(_down_to(cells, depth), places))


def read_daily_targets(cells: DataFrame, places: dict[str, str]) -> Parsed:
    """Date rows x location columns; the grand total column and row are left out, blank means no target."""
    base = materialise(find_daily_targets(cells, places))
    h = _header(cells, base, {"label": 0}).select(GRID, "col_idx", L.lookup(L.norm_label("label"), places).alias("location"))
    data = _below(cells, base)
    days = data.where("col_idx = 0").select(GRID, "row_idx", D.target_date("value").alias("date"))
    body = data.where("col_idx > 0").join(h, [GRID, "col_idx"], "left").join(days, [GRID, "row_idx"], "left").join(_units(cells, base), GRID)
    values, lost = _split(body.withColumn("x", NB.count_number("value")), {"date": "first cell is not a date", "location": OTHER_COLUMN, "x": NO_NUMBER})
    return Parsed(values.select(GRID, "row_idx", "location", "date", "x", "unit"), lost, ["location", "date"], ["aop"], {"aop": F.col("x") * F.col("unit")})


def daily_targets(cells: DataFrame, places: dict[str, str]) -> DataFrame:
    return read_daily_targets(cells, places).rows(cells)


def skipped_rows(cells: DataFrame, places: dict[str, str]) -> DataFrame:
    """Rows of daily target sheets whose first cell is not a date."""
    data = _below(cells, find_daily_targets(cells, places)).where("col_idx = 0")
    return data.where(D.target_date("value").isNull()).select(GRID, (F.col("row_idx") + 1).alias("row_number"), "value", F.lit("first cell is not a date").alias("reason"))


def _outlet_day_base(flags: DataFrame) -> DataFrame:
    banner = flags.where("places >= 1").select(GRID, (F.col("row_idx") + 2).alias("row_idx"))
    return _first_row(flags.where("date_first").select(GRID, "row_idx").join(banner, [GRID, "row_idx"]))


def find_outlet_day_targets(cells: DataFrame, places: dict[str, str], depth: int | None = None) -> DataFrame:
    """Header rows with 'Date' first, two banner rows above, the upper one naming locations."""
    return _outlet_day_base(row_flags(_down_to(cells, depth), places))


def read_outlet_day_targets(cells: DataFrame, places: dict[str, str], years: tuple[int, int] = D.YEARS) -> Parsed:
    """Daily outlet targets under location and segment banners, summed to months."""
    base = materialise(find_outlet_day_targets(cells, places))
    h = _header(cells, base, {"loc": -2, "seg": -1, "outlet": 0}).where("col_idx > 0")
    known = L.lookup(L.norm_label("loc"), places)
    # An unknown, non-blank banner ends the previous one.
    marked = h.select(GRID, "col_idx", "outlet", F.coalesce(known, F.when(F.col("loc").isNotNull(), "")).alias("location"),
                      F.when(L.is_total_label("seg"), "").otherwise(F.col("seg")).alias("segment"))
    groups = fill_across(marked, ["location", "segment"]).where("outlet is not null and location <> '' and segment <> ''").where(~L.is_total_label("outlet"))
    data = _below(cells, base)
    days = data.where("col_idx = 0").select(GRID, "row_idx", D.text_date("value", years).alias("date"))
    body = data.where("col_idx > 0").join(groups, [GRID, "col_idx"], "left").join(days, [GRID, "row_idx"], "left").join(_units(cells, base), GRID)
    v, lost = _split(body.withColumn("x", NB.count_number("value")), {"date": "first cell is not a date", "outlet": OTHER_COLUMN, "x": NO_NUMBER})
    parts = v.select(GRID, "row_idx", "location", "segment", "outlet", F.year("date").alias("year"), F.month("date").alias("month"), "x", "unit")
    return Parsed(parts, lost, ["location", "segment", "outlet", "year", "month"], ["aop"], {"aop": F.col("x") * F.col("unit")})


def outlet_day_targets(cells: DataFrame, places: dict[str, str], years: tuple[int, int] = D.YEARS) -> DataFrame:
    return read_outlet_day_targets(cells, places, years).rows(cells)


# --- traffic layouts -------------------------------------------------------------------------------------------


def read_flat_traffic(cells: DataFrame, places: dict[str, str], years: tuple[int, int] = D.YEARS) -> Parsed:
    """Date, location, traffic and optionally terminal columns."""
    aliases = {k: V.COLUMN_ALIASES[k] for k in ("date", "location", "traffic")} | {"terminal": ["terminal"]}
    t = alias_table(cells, aliases, ["date", "location", "traffic"])
    read = t.select(
        GRID, "row_idx", *[F.col(c).alias(f"text_{c}") for c in aliases], D.text_date("date", years).alias("date"), F.lit(None).cast("date").alias("period_end"),
        F.lit("daily").alias("granularity"), F.coalesce(_place("location", places), F.trim("location")).alias("location"),
        F.coalesce(F.trim("terminal"), F.lit("")).alias("terminal"), NB.count_number("traffic").alias("traffic"))
    rows, lost = _split(read, {"date": NO_DATE, "traffic": NO_NUMBER})
    return Parsed(rows.select(GRID, "row_idx", *TRAFFIC), lost, TRAFFIC_KEY, ["period_end", "traffic"])


def flat_traffic(cells: DataFrame, places: dict[str, str], years: tuple[int, int] = D.YEARS) -> DataFrame:
    return read_flat_traffic(cells, places, years).rows(cells).select(*TRAFFIC)


def _sites(cells: DataFrame, places: dict[str, str]) -> DataFrame:
    """Location of a grid: its sheet name, then the first of its texts that names one, then its file name. A place or its code is named
    where it stands as words of its own: a "goal sheet" is not the site "goa". Distinct texts with letters are searched, each once.
    """
    terms = terms_table(cells.sparkSession, places)
    named = cells.groupBy(GRID).agg(F.min("sheet").alias("sheet"), F.min("source").alias("source"))
    texts = filled(cells).where(F.col("value").rlike(r"\p{L}")).select(GRID, "row_idx", "col_idx", "value")
    words = named.select(F.col("sheet").alias("value")).unionByName(named.select(F.col("source").alias("value"))).unionByName(texts.select("value"))
    found = materialise(found_terms(words, "value", terms).select("value", "name"))
    first = texts.join(found, "value").groupBy(GRID).agg(F.min_by("name", F.struct("row_idx", "col_idx")).alias("in_text"))
    by = lambda c, out: found.select(F.col("value").alias(c), F.col("name").alias(out))
    sites = named.join(first, GRID, "left").join(by("sheet", "__sheet"), "sheet", "left").join(by("source", "__source"), "source", "left")
    return sites.select(GRID, "sheet", F.coalesce("__sheet", "in_text", "__source").alias("location"))


def _cross_base(flags: DataFrame) -> DataFrame:
    return _first_row(flags.where("dep_arr >= 2 and row_idx >= 1"))


def find_cross_tab(cells: DataFrame, depth: int | None = None) -> DataFrame:
    return _cross_base(row_flags(_down_to(cells, depth), {}))


def read_cross_tab(cells: DataFrame, places: dict[str, str], terminals: dict[str, str], years: tuple[int, int] = D.YEARS) -> Parsed:
    """Column groups x departure / arrival, one row per month, date or day of the sheet's month.

    Groups map to a terminal by "group sub-label" or "group"; groups of one terminal add up, others keep their label.
    """
    base = materialise(find_cross_tab(cells))
    h = materialise(_header(cells, base, {"seg": -1, "sub": 0}))
    date_label = L.norm_label("sub").isin("day", "date", "month") | L.norm_label("seg").isin("day", "date", "month")
    date_col = materialise(base.join(h.where(date_label).groupBy(GRID).agg(F.min("col_idx").alias("dc")), GRID, "left").select(
        GRID, "base_row", F.coalesce("dc", F.lit(0)).alias("dc")))
    rollup = F.lower("seg").rlike(ROLLUP_PREFIX)
    banner = h.join(date_col.select(GRID, "dc"), GRID).where("col_idx > dc").select(
        GRID, "col_idx", L.norm_label("sub").alias("sub"), F.when(rollup, "").otherwise(F.trim("seg")).alias("group"))
    label = lambda c: F.lower(F.col(c))
    groups = fill_across(banner, ["group"]).where((F.col("group") != "") & F.col("sub").isin(DEPARTURE_ARRIVAL)).select(
        GRID, "col_idx", F.coalesce(L.lookup(F.concat(label("group"), F.lit(" "), "sub"), terminals), L.lookup(label("group"), terminals), "group").alias("terminal"))
    above = filled(cells).join(base.select(GRID, "base_row"), GRID).where("row_idx < base_row")
    month = above.withColumn("m", D.month_label("value")).where("m is not null").groupBy(GRID).agg(
        F.min_by("m", F.struct("row_idx", "col_idx")).alias("title_month"))
    info = _sites(cells, places).join(month, GRID, "left").select(GRID, "location", F.coalesce(D.month_in_name("sheet"), "title_month").alias("anchor"))
    data = _below(cells, date_col)
    stop = data.join(date_col.select(GRID, "dc"), GRID).where("col_idx = dc").where(F.lower(F.trim("value")).isin(STOP_LABELS)).groupBy(GRID).agg(F.min("row_idx").alias("stop"))
    labels = data.join(date_col.select(GRID, "dc"), GRID).groupBy(GRID, "row_idx").agg(F.max(F.when(F.col("col_idx") == F.col("dc"), F.col("value"))).alias("label"))
    numbered = running_count(labels, [GRID], "row_idx", F.col("label").isNull(), "blank_no")
    day_no = F.when(D.is_day_number("label"), F.col("label").try_cast("double").cast("int")).when(F.col("label").isNull(), F.col("blank_no").cast("int"))
    anchored = F.when(day_no <= F.dayofmonth(F.last_day("anchor")), F.date_add(F.trunc("anchor", "MM"), day_no - 1))
    dated = numbered.join(info, GRID).join(stop, GRID, "left").withColumns({
        "month": D.month_label("label"), "day": F.coalesce(D.text_date("label", years), anchored), "in_table": F.when(F.col("stop").isNull() | (F.col("row_idx") < F.col("stop")), True)})
    rows = dated.select(
        GRID, "row_idx", "location", "in_table", F.coalesce("month", "day").alias("date"), F.last_day("month").alias("period_end"),
        F.when(F.col("month").isNotNull(), "monthly").otherwise("daily").alias("granularity"))
    body = data.join(date_col.select(GRID, "dc"), GRID).where("col_idx > dc").join(groups, [GRID, "col_idx"], "left").join(rows, [GRID, "row_idx"], "left")
    v, lost = _split(body.withColumn("x", NB.count_number("value")), {
        "in_table": "below the first total row", "date": NO_DATE, "location": NO_PLACE, "terminal": OTHER_COLUMN, "x": NO_NUMBER})
    keys = ["date", "period_end", "granularity", "location", "terminal"]
    return Parsed(v.select(GRID, "row_idx", *keys, "x"), lost, keys, ["traffic"], {"traffic": F.col("x")})


def cross_tab_traffic(cells: DataFrame, places: dict[str, str], terminals: dict[str, str], years: tuple[int, int] = D.YEARS) -> DataFrame:
    return read_cross_tab(cells, places, terminals, years).rows(cells)


def _type(c) -> Column:
    t = F.lower(c)
    return F.when(t.contains("domestic"), "Domestic").when(t.contains("international"), "International")


def _typed_base(flags: DataFrame) -> DataFrame:
    above = flags.where("typed").select(GRID, (F.col("row_idx") + 1).alias("row_idx"))
    below = flags.where("arr_dep >= 2").select(GRID, (F.col("row_idx") - 1).alias("row_idx"))
    return _first_row(flags.where("dated and pax").select(GRID, "row_idx").join(above, [GRID, "row_idx"]).join(below, [GRID, "row_idx"]))


def find_typed_traffic(cells: DataFrame, depth: int | None = None) -> DataFrame:
    """Rows labelled Date / PAX with type banners above and arrival / departure labels below; ``base_row`` is the label row."""
    return _typed_base(row_flags(_down_to(cells, depth), {}))


def _typed_columns(cells: DataFrame, base: DataFrame) -> DataFrame:
    """Columns with section number, type, metric and arrival / departure label. A section starts at each 'Date' label."""
    h = _header(cells, base, {"type": -1, "metric": 0, "ad": 1})
    m = L.norm_label("metric")
    marked = h.select(GRID, "col_idx", _type(F.col("type")).alias("type"), F.when(m.isin("pax", "flights"), m).alias("metric"),
                      L.norm_label("ad").isin(ARRIVAL_DEPARTURE).alias("is_ad"), (m == "date").alias("is_date"))
    sections = running_count(marked, [GRID], "col_idx", F.col("is_date"), "section")
    return fill_across(sections, ["type", "metric"])


def read_typed_traffic(cells: DataFrame, places: dict[str, str], keep: str = "latest", years: tuple[int, int] = D.YEARS) -> Parsed:
    """Domestic / International x PAX / flights x arrival / departure, a row per day; only PAX is kept.

    Tables side by side are sections: ``keep="latest"`` takes the one with the later month, ``"same month"`` every section of the latest
    month (two tables of one month are two types; one of an older month is a comparison), ``"all"`` takes each.
    Days are dates (day and month swapped back where the reference month says so) or day numbers.
    """
    base = materialise(find_typed_traffic(cells))
    cols = materialise(_typed_columns(cells, base).withColumn("is_date", F.coalesce("is_date", F.lit(False))))
    date_cols = cols.where("is_date").select(GRID, "section", F.col("col_idx").alias("dc"))
    pax_cols = cols.where("is_ad and metric = 'pax' and type is not null and section > 0").select(GRID, "section", "col_idx", "type")
    where = cols.select(GRID, "col_idx", "section")
    top = filled(cells).join(base.select(GRID, "base_row"), GRID).where("row_idx < base_row").select(GRID, "col_idx", F.coalesce(D.month_label("value"), F.trunc(D.text_date("value", years), "MM")).alias("m")).where("m is not null")
    own = top.join(where, [GRID, "col_idx"]).groupBy(GRID, "section").agg(F.max("m").alias("own_month"))
    any_month = top.groupBy(GRID).agg(F.max("m").alias("grid_month"))
    info = _sites(cells, places).join(any_month, GRID, "left")
    sections = date_cols.join(own, [GRID, "section"], "left").join(info, GRID).select(
        GRID, "section", "dc", "location", F.coalesce("own_month", "grid_month", D.month_in_name("sheet")).alias("ref"))
    month = F.coalesce("ref", F.lit("1900-01-01").cast("date"))
    if keep == "latest":
        best = sections.groupBy(GRID).agg(F.max_by("section", F.struct(month, "section")).alias("section"))
        sections = sections.join(best.withColumn("chosen", F.lit(True)), [GRID, "section"], "left")
    elif keep == "same month":
        best = sections.groupBy(GRID).agg(F.max(month).alias("last"))
        sections = sections.join(best, GRID).withColumn("chosen", F.when(month == F.col("last"), True)).drop("last")
    else:
        sections = sections.withColumn("chosen", F.lit(True))
    sections = materialise(sections)
    data = _below(cells, base, 1)
    labels = data.join(sections, GRID).where("col_idx = dc")
    day_no = F.col("value").try_cast("double").cast("int")
    numbered = F.when(D.is_day_number("value") & (day_no <= F.dayofmonth(F.last_day("ref"))), F.date_add(F.trunc("ref", "MM"), day_no - 1))
    read = D.text_date("value", years)
    dated = labels.withColumns({"read": read, "numbered": numbered}).select(
        GRID, "row_idx", "section", "location", F.coalesce("numbered", D.fix_swapped_day("read", "ref")).alias("date"))
    body = data.join(cols.select(GRID, "col_idx", "section", "is_date"), [GRID, "col_idx"], "left").where("is_date is null or not is_date")
    body = body.join(pax_cols.drop("section"), [GRID, "col_idx"], "left")
    body = body.join(sections.select(GRID, "section", "chosen"), [GRID, "section"], "left").join(dated, [GRID, "row_idx", "section"], "left")
    v, lost = _split(body.withColumn("x", NB.count_number("value")), {
        "section": OTHER_COLUMN, "chosen": "table of another month", "date": NO_DATE, "location": NO_PLACE, "type": "no column of customers", "x": NO_NUMBER})
    sums = v.groupBy(GRID, "row_idx", "section", "date", "location", F.col("type").alias("terminal")).agg(F.sum(F.col("x").cast("decimal(28,6)")).cast("double").alias("traffic"))
    rows = sums.withColumns({"period_end": F.lit(None).cast("date"), "granularity": F.lit("daily")})
    return Parsed(rows, lost, TRAFFIC_KEY, ["period_end", "traffic"])


def typed_traffic(cells: DataFrame, places: dict[str, str], keep: str = "latest", years: tuple[int, int] = D.YEARS) -> DataFrame:
    return read_typed_traffic(cells, places, keep, years).rows(cells).select(*TRAFFIC)


def find_transposed(cells: DataFrame, base: DataFrame, years: tuple[int, int] = D.YEARS) -> DataFrame:
    """The first row below a typed header that holds three dates or more: days run across."""
    data = _below(cells, base, 1)
    heads = data.where(D.text_date("value", years).isNotNull() & NB.messy_number("value").isNull())
    return _first_row(heads.groupBy(GRID, "row_idx").agg(F.count(F.lit(1)).alias("n")).where("n >= 3"))


def read_transposed_traffic(cells: DataFrame, places: dict[str, str], years: tuple[int, int] = D.YEARS) -> Parsed:
    """Dates run across; blocks of numeric rows separated by blank rows belong to the types in banner order, rows of a block add up."""
    base = materialise(find_typed_traffic(cells))
    types = _typed_columns(cells, base).where("type is not null").groupBy(GRID, "type").agg(F.min("col_idx").alias("c"))
    from pyspark.sql import Window

    ranked = types.select(GRID, "type", F.row_number().over(Window.partitionBy(GRID).orderBy("c")).alias("block"))
    first = materialise(find_transposed(cells, base, years))
    heads = filled(cells).join(first, GRID).where("row_idx = base_row")
    days = materialise(heads.select(GRID, "col_idx", D.text_date("value", years).alias("date")).where("date is not null"))
    body = _below(cells, first).join(days, [GRID, "col_idx"], "left").withColumn("x", NB.count_number("value"))
    rows = body.where("date is not null and x is not null").select(GRID, "row_idx").distinct()
    # A numeric row starts a block when the row above it is not numeric.
    previous = rows.select(GRID, (F.col("row_idx") + 1).alias("row_idx"), F.lit(True).alias("follows"))
    numbered = running_count(rows.join(previous, [GRID, "row_idx"], "left"), [GRID], "row_idx", F.col("follows").isNull(), "block").select(GRID, "row_idx", "block")
    placed = body.join(numbered, [GRID, "row_idx"], "left").join(ranked, [GRID, "block"], "left").join(_sites(cells, places).select(GRID, "location"), GRID)
    out, lost = _split(placed, {"date": "column without a date", "x": NO_NUMBER, "location": NO_PLACE})
    named = out.select(GRID, "row_idx", "date", F.lit(None).cast("date").alias("period_end"), F.lit("daily").alias("granularity"), "location",
                       F.coalesce("type", F.concat(F.lit("Group"), (F.col("block") - 1).cast("string"))).alias("terminal"), "x")
    return Parsed(named, lost, ["date", "period_end", "granularity", "location", "terminal"], ["traffic"], {"traffic": F.col("x")})


def transposed_traffic(cells: DataFrame, places: dict[str, str], years: tuple[int, int] = D.YEARS) -> DataFrame:
    return read_transposed_traffic(cells, places, years).rows(cells).select(*TRAFFIC)


def read_flat_export(cells: DataFrame, places: dict[str, str], years: tuple[int, int] = D.YEARS) -> Parsed:
    """DATE, DOM_ARR_PAX, DOM_DEP_PAX, INT_ARR_PAX, INT_DEP_PAX columns, arrivals and departures added per type."""
    names = {"date": ["date"], "da": ["dom_arr_pax"], "dd": ["dom_dep_pax"], "ia": ["int_arr_pax"], "id": ["int_dep_pax"]}
    t = alias_table(cells, names, ["date", "da", "ia"])
    n = lambda c: F.coalesce(NB.count_number(c), F.lit(0.0))
    kinds = F.array(F.struct(F.lit("Domestic").alias("terminal"), (n("da") + n("dd")).alias("traffic")), F.struct(F.lit("International").alias("terminal"), (n("ia") + n("id")).alias("traffic")))
    texts = t.join(_sites(cells, places).select(GRID, "location"), GRID).withColumns({
        "day": D.text_date("date", years), "kinds": F.filter(kinds, lambda k: k["traffic"] > 0), "period_end": F.lit(None).cast("date"), "granularity": F.lit("daily")})
    full = texts.withColumn("counted", F.when(F.size("kinds") > 0, True))
    kept, lost = _split(full, {"day": NO_DATE, "location": NO_PLACE, "counted": "no customers in any column"})
    rows = kept.select(GRID, "row_idx", F.col("day").alias("date"), "period_end", "granularity", "location", F.explode("kinds").alias("k")).select(
        GRID, "row_idx", "date", "period_end", "granularity", "location", "k.*")
    return Parsed(rows, lost, TRAFFIC_KEY, ["period_end", "traffic"])


def flat_export(cells: DataFrame, places: dict[str, str], years: tuple[int, int] = D.YEARS) -> DataFrame:
    return read_flat_export(cells, places, years).rows(cells).select(*TRAFFIC)


# --- dispatch --------------------------------------------------------------------------------------------------


# Route of every layout; the order is the one in which a grid is tried.
ROUTES = {
    "flat_export": "traffic", "transposed_traffic": "traffic", "typed_traffic": "traffic", "cross_tab": "traffic", "flat_traffic": "traffic",
    "long_revenue": "revenue", "stacked_blocks": "revenue", "wide_pivot": "revenue",
    "monthly_targets": "target", "outlet_day_targets": "target", "daily_targets": "target", "sectioned_table": "revenue",
}


def grid_kinds(cells: DataFrame, places: dict[str, str], years: tuple[int, int] = D.YEARS) -> DataFrame:
    """Layout and route of every grid; the most specific layout wins. Traffic hints come first, then known revenue, targets."""
    flags = written(row_flags(cells, places, years), "rows")
    lone = (F.col("n") == 1) & F.col("labelled")
    titled = F.coalesce("titled", F.lit(False))
    found = flags.groupBy(GRID).agg(
        F.bool_or(F.col("dated") & F.col("traffic") & ~F.col("revenue")).alias("flat_traffic"), F.bool_or("export").alias("flat_export"), F.bool_or("marker").alias("stacked_blocks"),
        F.bool_or(F.col("dated") & F.col("business") & F.col("revenue")).alias("long_revenue"),
        (F.bool_or(lone & titled) & F.bool_or(lone & ~titled) & F.bool_or(~lone & F.col("total"))).alias("sectioned_table"))
    typed = written(_typed_base(flags), "typed")
    for name, base in (
        ("typed_traffic", typed), ("transposed_traffic", find_transposed(cells, typed, years)), ("cross_tab", _cross_base(flags)), ("wide_pivot", _pivot_base(flags)),
        ("monthly_targets", _monthly_base(flags)), ("outlet_day_targets", _outlet_day_base(flags)), ("daily_targets", _daily_base(flags)),
    ):
        found = found.join(base.select(GRID, F.lit(True).alias(name)), GRID, "left")
    layout, route = F.lit("unknown"), F.lit("infer")
    for name, to in reversed(ROUTES.items()):
        layout = F.when(F.col(name), name).otherwise(layout)
        route = F.when(F.col("layout") == name, to).otherwise(route)
    return cells.select(GRID, "source").distinct().join(found, GRID, "left").withColumn("layout", F.coalesce(layout, F.lit("unknown"))).withColumn("route", route).select(
        GRID, "source", "layout", "route")


def by_layout(cells: DataFrame, kinds: DataFrame) -> DataFrame:
    """The cells with their grid's ``layout``, written once by layout: a parser opens the files of its own grids alone."""
    path = stage_path(cells.sparkSession, "layouts")
    named = cells.join(kinds.select(GRID, "layout"), GRID)
    named.hint("rebalance", "layout").write.partitionBy("layout").parquet(path)
    return cells.sparkSession.read.schema(named.schema).parquet(path)


def of_layout(cells: DataFrame, name: str) -> DataFrame:
    """Cells of one layout; ``cells`` as of :func:`by_layout`."""
    return cells.where(F.col("layout") == name).drop("layout")


def traffic_readers(places: dict[str, str], terminals: dict[str, str], years: tuple[int, int] = D.YEARS) -> dict[str, Callable[[DataFrame], Parsed]]:
    """A parser for every traffic layout, the preferred one last. Of tables side by side those of the latest month are read."""
    return {
        "flat_traffic": lambda c: read_flat_traffic(c, places, years), "cross_tab": lambda c: read_cross_tab(c, places, terminals, years),
        "typed_traffic": lambda c: read_typed_traffic(c, places, "same month", years),
        "transposed_traffic": lambda c: read_transposed_traffic(c, places, years), "flat_export": lambda c: read_flat_export(c, places, years),
    }


def with_origin(parts: dict[str, Parsed], cells: DataFrame) -> DataFrame:
    """The rows of every file and layout: source, delivered, grid_id, row_idx, layout and the facts; later layouts have a higher ``preference``."""
    out = None
    for i, (name, p) in enumerate(parts.items()):
        one = p.per_file(cells).withColumns({"layout": F.lit(name), "preference": F.lit(i)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def lost_cells(parts: dict[str, Parsed]) -> DataFrame:
    """The rejects of several layouts."""
    out = None
    for name, p in parts.items():
        one = p.rejects.withColumn("layout", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def all_traffic(cells: DataFrame, places: dict[str, str], terminals: dict[str, str], kinds: DataFrame, years: tuple[int, int] = D.YEARS, first_year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of every traffic layout of a corpus. Rows have one per key, with the file, grid, row and layout they come from: the
    layout listed last wins, then the file delivered first. Rows before ``first_year`` are among the rejects.
    """
    own = by_layout(cells, kinds)
    parts = {name: read(of_layout(own, name)) for name, read in traffic_readers(places, terminals, years).items()}
    rows, lost = with_origin(parts, written(deliveries(cells), "deliveries")), lost_cells(parts)
    if first_year is not None:
        early = F.year("date") < first_year
        text = F.to_json(F.struct(*TRAFFIC))
        lost = lost.unionByName(rows.where(early).select(GRID, "row_idx", F.lit(None).cast("int").alias("col_idx"), text.alias("value"), F.lit(f"before {first_year}").alias("reason"), "layout"))
        rows = rows.where(~early)
    order = [F.desc("preference"), F.col("delivered").asc_nulls_last(), F.asc("source"), F.asc(GRID), F.asc("row_idx")]
    return keep_one(rows, TRAFFIC_KEY, *order).select(*TRAFFIC, "source", GRID, "row_idx", "layout"), lost
