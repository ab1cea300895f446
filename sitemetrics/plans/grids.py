"""Cell grids: ``cells(grid_id, source, sheet, row_idx, col_idx, value)``, blank cells may be absent.

One job works on all grids of a corpus; rows and columns are explicit, partition order is never used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import dates as D
from sitemetrics.functions import labels as L
from sitemetrics.functions import numbers as NB
from sitemetrics.functions import vocabulary as V
from sitemetrics.operators.ordered import fill_down, running_count, running_sum, top_per_group

GRID = "grid_id"


def cell_kind_columns(value: str, places: dict[str, str], years: tuple[int, int] = D.YEARS) -> list[Column]:
    """Exclusive kinds of a cell: number, date, location, blank."""
    number = NB.messy_number(value).isNotNull()
    date = ~number & D.text_date(value, years).isNotNull()
    blank = L.is_blank(value)
    place = ~number & ~date & ~blank & L.vocabulary_match(value, places).isNotNull()
    false = F.lit(False)
    return [
        F.coalesce(number, false).alias("is_number"), F.coalesce(date, false).alias("is_date"),
        F.coalesce(place, false).alias("is_location"), blank.alias("is_blank"),
    ]


# What every cell's text says, parsed once: the normalised label, the number and the date.
NORM, NUMBER, DAY = "__norm", "__number", "__day"


def with_readings(texts: DataFrame, years: tuple[int, int] = D.YEARS) -> DataFrame:
    """``texts`` (value, ...) with the three readings of each value; those that are there stay."""
    if NORM in texts.columns:
        return texts
    return texts.withColumns({NORM: L.norm_label("value"), NUMBER: NB.messy_number("value"), DAY: D.text_date("value", years)})


def read_cells(cells: DataFrame, years: tuple[int, int] = D.YEARS) -> DataFrame:
    """Cells with cleaned texts (NULL where blank) and their readings. Rows are dealt by grid row first, so that large sheets are parsed by many tasks."""
    return with_readings(cells.withColumn("value", L.clean_cell("value")).repartition(GRID, "row_idx"), years)


def filled(cells: DataFrame) -> DataFrame:
    """Non-blank cells with cleaned text."""
    if NORM in cells.columns:  # cleaned when read
        return cells.where("value is not null")
    return cells.withColumn("value", L.clean_cell("value")).where("value is not null")


def synonym_scores(label: Column, role: str) -> Column:
    """Best header score of a normalised label for a role: exact, whole word (0.8), part (0.6)."""
    bank = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w"), F.lit(_words(p)).alias("q")) for p, w in V.HEADER_SYNONYMS[role]])
    words = F.concat(F.lit(" "), F.regexp_replace(label, r"\W", " "), F.lit(" "))
    score = lambda s: (
        F.when(label == s["p"], s["w"])
        .when(words.contains(s["q"]) & (F.length(s["p"]) >= 3), s["w"] * 0.8)
        .when(label.contains(s["p"]) & (F.length(s["p"]) >= 4), s["w"] * 0.6)
        .otherwise(0.0)
    )
    best = F.array_max(F.transform(bank, score))
    if role == "pax":
        return best
    excluded = F.lit(False)
    for hint in V.EXCLUDING_HINTS:
        excluded = excluded | label.contains(hint)
    return F.when(excluded, -0.5).otherwise(best)


def _words(pattern: str) -> str:
    return " " + "".join(c if c.isalnum() or c == "_" else " " for c in pattern) + " "


def vocabulary_hit(label: Column) -> Column:
    """Best weight over all roles for header search: exact, else contained (0.7)."""
    bank = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for ps in V.HEADER_SYNONYMS.values() for p, w in ps])
    return F.array_max(F.transform(bank, lambda s: F.when(label == s["p"], s["w"]).when(
        label.contains(s["p"]) & (F.length(s["p"]) >= 3), s["w"] * 0.7).otherwise(0.0)))


def header_row_scores(cells: DataFrame, vocab: V.Vocab, depth: int | None = None) -> DataFrame:
    """Header likeness of every row (of the first ones, with a depth): text share, vocabulary hits, date headers."""
    head = with_readings(filled(cells if depth is None else cells.where(F.col("row_idx") < depth)), vocab.years)
    kind = F.when(F.col(NUMBER).isNotNull(), "number").when(F.col(DAY).isNotNull(), "date").otherwise("text")
    kinds = head.select(GRID, "row_idx", kind.alias("kind"), _metric_word(F.col(NORM)).alias("metric_word"), F.when(kind == "text", F.col(NORM)).alias("label"))
    # Labels repeat over files, so the vocabulary is matched once per distinct text; numbers and dates name nothing.
    words = kinds.select("label").where("label is not null").distinct().withColumn("hit", vocabulary_hit(F.col("label")))
    per_row = kinds.join(words, "label", "left").groupBy(GRID, "row_idx").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "text").alias("texts"), F.count_if(F.col("kind") == "date").alias("dates"),
        F.sum(F.coalesce("hit", F.lit(0.0)).cast("decimal(18,6)")).cast("double").alias("hits"), F.bool_or("metric_word").alias("metric_word"),
    )
    n = F.col("n")
    score = (F.col("texts") + F.col("dates")) / n * 0.4 + F.least(F.col("hits") / 3.0, F.lit(1.0)) * 0.6 + F.when(F.col("dates") >= 3, 0.1).otherwise(0.0)
    return per_row.withColumn("score", F.when(n < 2, 0.0).otherwise(score))


def _metric_word(label: Column) -> Column:
    out = F.lit(False)
    for role in ("pax", "revenue", "aop"):
        for p, _ in V.HEADER_SYNONYMS[role]:
            out = out | label.contains(p)
    return out


def find_headers(cells: DataFrame, vocab: V.Vocab, depth: int | None = None, floor: float = V.HEADER_FLOOR) -> DataFrame:
    """Best header row per grid and, if it belongs to the header, the row above it (``upper_row``)."""
    scores = header_row_scores(cells, vocab, depth)
    best = scores.groupBy(GRID).agg(F.max(F.struct("score", (-F.col("row_idx")).alias("r"))).alias("b")).select(
        GRID, (-F.col("b.r")).alias("header_row"), F.col("b.score").alias("header_score")
    ).where(F.col("header_score") >= floor)
    above = scores.where((F.col("score") >= 0.3) & ((F.col("n") >= 3) | F.col("metric_word"))).select(
        GRID, (F.col("row_idx") + 1).alias("header_row"), F.col("row_idx").alias("upper_row")
    )
    return best.join(above, [GRID, "header_row"], "left")


def find_transposed(cells: DataFrame, vocab: V.Vocab) -> DataFrame:
    """Sheets whose days run across: (grid_id, date_row). Two labels of the first column or more name a metric, below a row of three dates or more."""
    strong = [p for m in V.METRICS for p, w in V.HEADER_SYNONYMS[m] if w >= 0.9]
    read = with_readings(filled(cells), vocab.years)
    first = read.where("col_idx = 0").select(GRID, "row_idx", F.col(NORM).alias("__t"))
    texts = first.select("__t").distinct()
    words = F.concat(F.lit(" "), F.regexp_replace("__t", r"\W", " "), F.lit(" "))
    named = texts.where(F.exists(F.array(*[F.lit(_words(p)) for p in strong]), lambda q: words.contains(q)))
    metrics = first.join(named, "__t").select(GRID, F.col("row_idx").alias("metric_row"))
    likely = metrics.groupBy(GRID).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(GRID)
    heads = read.where("col_idx > 0").where(F.col(DAY).isNotNull() & F.col(NUMBER).isNull()).select(GRID, "row_idx").join(likely, GRID, "left_semi")
    dated = heads.groupBy(GRID, "row_idx").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").groupBy(GRID).agg(F.min("row_idx").alias("date_row"))
    below = metrics.join(dated, GRID).where("metric_row > date_row").groupBy(GRID, "date_row").agg(F.count(F.lit(1)).alias("n"))
    return below.where("n >= 2").select(GRID, "date_row")


def turn(cells: DataFrame, transposed: DataFrame) -> DataFrame:
    """Cells with rows and columns of the transposed sheets swapped from the row of dates on, which becomes the first column; the title rows
    above stay. Afterwards such a sheet is a plain one: a header of metric names over one row per day.
    """
    placed = cells.join(transposed, GRID, "left")
    swap = F.col("date_row").isNotNull() & (F.col("row_idx") >= F.col("date_row"))
    row = F.when(swap, F.col("date_row") + F.col("col_idx")).otherwise(F.col("row_idx"))
    column = F.when(swap, F.col("row_idx") - F.col("date_row")).otherwise(F.col("col_idx"))
    return placed.withColumns({"row_idx": row, "col_idx": column}).select(*cells.columns)


def header_labels(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """One label per column: header text, prefixed by the upper row's text carried to the right."""
    columns = cells.select(GRID, "col_idx").distinct()
    h = filled(cells).join(headers.select(GRID, "header_row", "upper_row"), GRID).where("row_idx = header_row or row_idx = upper_row")
    texts = h.groupBy(GRID, "col_idx").agg(
        F.max(F.when(F.col("row_idx") == F.col("header_row"), F.col("value"))).alias("low"),
        F.max(F.when(F.col("row_idx") == F.col("upper_row"), F.col("value"))).alias("up"),
    )
    per_column = columns.join(headers.select(GRID), GRID).join(texts, [GRID, "col_idx"], "left")
    carried = fill_down(per_column, [GRID], "col_idx", ["up"])
    low, up = F.coalesce("low", F.lit("")), F.coalesce("up", F.lit(""))
    label = F.when((up != "") & (up != low), F.trim(F.concat_ws(" ", up, low))).when(low != "", low).otherwise(up)
    return carried.select(GRID, "col_idx", label.alias("label"))


def title_texts(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Text above the header per grid, rows in order."""
    top = F.coalesce("upper_row", "header_row")
    above = filled(cells).join(headers, GRID).where(F.col("row_idx") < top)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"])
    rows = above.groupBy(GRID, "row_idx").agg(F.array_join(ordered(F.struct("col_idx", F.col("value").alias("t"))), " ").alias("line"))
    return rows.groupBy(GRID).agg(F.array_join(ordered(F.struct("row_idx", F.col("line").alias("t"))), " | ").alias("title"))


def rows_as_columns(cells: DataFrame, n_cols: int, keys: list[str] = ()) -> DataFrame:
    """One row per grid row with columns c0..c{n-1}."""
    return filled(cells).groupBy(GRID, *keys, "row_idx").agg(*[
        F.max(F.when(F.col("col_idx") == i, F.col("value"))).alias(f"c{i}") for i in range(n_cols)
    ])


def fill_across(header: DataFrame, cols: list[str]) -> DataFrame:
    """Carry banner texts to the right; ``header``: one row per (grid, column)."""
    return fill_down(header, [GRID], "col_idx", cols)


def blocks(rows: DataFrame, is_break: Column, out: str = "block") -> DataFrame:
    """Block number per row, one higher from every marker row on."""
    return running_count(rows, [GRID], "row_idx", is_break, out)


def drop_junk_rows(cells: DataFrame, headers: DataFrame, labels: DataFrame) -> DataFrame:
    """Data cells below the header without blank, total and repeated-header rows.

    ``labels``: grid_id, col_idx, label. A row repeats the header when at least half of its labels (two or more) recur.
    """
    data = filled(cells).join(headers.select(GRID, "header_row"), GRID).where("row_idx > header_row").drop("header_row")
    text = F.col(NORM) if NORM in cells.columns else L.norm_label("value")
    names = labels.where("label <> ''").select(GRID, "col_idx", L.norm_label("label").alias("__h"))
    width = names.groupBy(GRID).agg(F.greatest(F.lit(2.0), F.count(F.lit(1)) / 2).alias("__w"))
    judged = data.select(GRID, "row_idx", "col_idx", text.alias("__t")).join(names, [GRID, "col_idx"], "left").groupBy(GRID, "row_idx").agg(
        F.bool_or((F.col("col_idx") < 4) & L.is_total_label("__t")).alias("__total"), F.count_if(F.col("__t") == F.col("__h")).alias("__n"),
    )
    junk = judged.join(width, GRID).where(F.col("__total") | (F.col("__n") >= F.col("__w"))).select(GRID, "row_idx")
    return data.join(junk, [GRID, "row_idx"], "left_anti")


def rank_candidates(cells: DataFrame, n: int | None = None) -> DataFrame:
    """All grids of each source (the best n, if given) ranked by size and vocabulary: log1p(rows) * log1p(cols) + 3 * hits + 2 for a text header."""
    c = filled(cells)
    size = c.groupBy("source", GRID).agg(F.count_distinct("row_idx").alias("n_rows"), F.count_distinct("col_idx").alias("n_cols"))
    first = c.where("row_idx < 10")
    words = first.select("value").distinct().withColumn("known", vocabulary_hit(L.norm_label("value")) > 0)
    hits = first.join(words, "value").groupBy(GRID).agg(
        F.count_if("known").alias("hits"), F.bool_and(F.when(F.col("row_idx") == 0, NB.messy_number("value").isNull())).alias("text_header")
    )
    score = F.log1p("n_rows") * F.log1p("n_cols") + 3.0 * F.coalesce("hits", F.lit(0)) + F.when(F.coalesce("text_header", F.lit(False)), 2.0).otherwise(0.0)
    scored = size.join(hits, GRID, "left").withColumn("score", score)
    return top_per_group(scored, ["source"], n or 2**31 - 1, F.desc("score"), F.col(GRID), rank="rank")


def merge_same_width(cells: DataFrame) -> DataFrame:
    """Table parts of one source with equal width become one grid, rows renumbered in ``page`` order; widest first.

    Row numbers come from running part sizes, not from sorting the cells.
    """
    parts = cells.groupBy("source", "page").agg((F.max("col_idx") + 1).alias("width"), (F.max("row_idx") + 1).alias("n_rows"))
    placed = running_sum(parts, ["source", "width"], "page", F.col("n_rows"), "offset", inclusive=False)
    grid = F.concat(F.col("source"), F.lit("#"), F.lpad((100000 - F.col("width")).cast("string"), 5, "0"))
    return cells.join(placed, ["source", "page"]).select(
        "source", grid.alias(GRID), (F.col("row_idx") + F.col("offset")).cast("int").alias("row_idx"), "col_idx", "value",
    )
