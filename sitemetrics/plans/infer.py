"""Schema inference over a corpus of cell grids: which column is what, how the sheet is laid out, what is missing."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import dates as D
from sitemetrics.functions import labels as L
from sitemetrics.functions import numbers as NB
from sitemetrics.functions import vocabulary as V
from sitemetrics.operators.ordered import fill_down, top_per_group
from sitemetrics.operators.reuse import materialise
from sitemetrics.plans import grids as G
from sitemetrics.plans.headers import header_matches

GRID = G.GRID
KEY_ORD, METRIC_ORD = 1_000_000, 1_000_001


@dataclass
class Inference:
    """``rows``: canonical accepted rows. ``rejected_rows``: rows with a reason. ``grids``: status per grid.
    ``mapping``: one row per (grid, role)."""

    rows: DataFrame
    rejected_rows: DataFrame
    grids: DataFrame
    mapping: DataFrame


def logical_columns(labels: DataFrame, vocab: V.Vocab) -> DataFrame:
    """Meaning of every physical column. In wide sheets a column is a (key, metric) pair of the melted table."""
    t = L.norm_label("label")
    metric = F.lit(None).cast("string")
    for role in reversed(V.METRICS):
        strong = F.array(*[F.lit(G._words(p)) for p, w in V.HEADER_SYNONYMS[role] if w >= 0.9])
        words = F.concat(F.lit(" "), F.regexp_replace(t, r"\W", " "), F.lit(" "))
        metric = F.when(F.exists(strong, lambda q: words.contains(q)), role).otherwise(metric)
    pattern = "|".join(sorted((p.replace(".", r"\.") for r in V.METRICS for p, w in V.HEADER_SYNONYMS[r] if w >= 0.9), key=len, reverse=True))
    bare = F.trim(F.regexp_replace(F.lower("label"), rf"\b({pattern})\b", ""))
    tagged = labels.withColumns({
        "metric": metric, "date_key": F.coalesce(D.text_date("label", vocab.years), D.text_date(bare, vocab.years)),
        "place_key": F.coalesce(L.vocabulary_match("label", vocab.places), L.vocabulary_match(bare, vocab.places)),
    })
    per_grid = tagged.groupBy(GRID).agg(
        F.count_if(F.col("date_key").isNotNull()).alias("nd"), F.count_if(F.col("place_key").isNotNull()).alias("np")
    )
    layout = F.when(F.col("nd") >= 3, "date_wide").when(F.col("np") >= 2, "location_wide").otherwise("long")
    typed = tagged.join(per_grid.select(GRID, layout.alias("layout")), GRID)
    key = F.when(F.col("layout") == "date_wide", F.col("date_key").cast("string")).when(F.col("layout") == "location_wide", F.col("place_key"))
    melted = typed.withColumn("key", key)
    is_value = F.col("key").isNotNull()
    metric_name = F.coalesce("metric", F.lit("revenue"))
    order = {m: METRIC_ORD + i for i, m in enumerate(V.METRICS)}
    metric_ord = F.lit(None).cast("int")
    for m, o in order.items():
        metric_ord = F.when(metric_name == m, o).otherwise(metric_ord)
    return melted.select(
        GRID, "col_idx", "layout", "key",
        F.when(is_value, metric_ord).otherwise(F.col("col_idx")).alias("ord"),
        F.when(is_value, metric_name).otherwise(F.col("label")).alias("label"),
    )


def profiles(data: DataFrame, vocab: V.Vocab) -> DataFrame:
    """What the values of each logical column look like; ``data``: grid_id, ord, value."""
    share = lambda c: F.avg(c.cast("int"))
    t = F.col(G.NORM)
    v = G.with_readings(data, vocab.years).select(
        GRID, "ord", t.alias("t"), F.col(G.NUMBER).alias("x"), F.col(G.DAY).isNotNull().alias("d"),
        L.label_match(t, vocab.places).isNotNull().alias("p"), L.label_match(t, vocab.segments, 5).isNotNull().alias("s"),
    )
    return v.groupBy(GRID, "ord").agg(
        F.count(F.lit(1)).alias("n"), share(F.coalesce("d", F.lit(False))).alias("date"), share(F.col("x").isNotNull()).alias("num"),
        share(F.coalesce("p", F.lit(False))).alias("loc"), share(F.coalesce("s", F.lit(False))).alias("seg"),
        share(F.col("x").isNull() & ~F.coalesce("d", F.lit(False))).alias("text"),
        F.avg((F.abs(F.col("x") - F.round("x")) < 1e-9).cast("int")).alias("int_like"),
        F.avg(F.abs("x").cast("decimal(28,4)")).cast("double").alias("mean_abs"),
        (F.approx_count_distinct("t") / F.count(F.lit(1))).alias("uniq"),
    )


def _content_score(role: str) -> Column:
    numeric = (F.col("num") >= 0.7) & (F.col("date") < 0.3)
    int_like = F.coalesce("int_like", F.lit(0.0))
    plain = {"date": F.col("date"), "location": F.col("loc"), "segment": F.col("seg")}
    if role in plain:
        return plain[role]
    if role == "outlet":
        free_text = (F.col("text") >= 0.6) & (F.col("loc") < 0.5) & (F.col("seg") < 0.5)
        return F.when(free_text, 0.4 + 0.3 * F.least(F.col("uniq") * 2, F.lit(1.0))).otherwise(0.0)
    if role == "business_unit":
        return F.when(F.col("seg") >= 0.5, 0.3).otherwise(0.0)
    bonus = {"pax": F.when(int_like >= 0.9, 0.15).otherwise(0.0), "revenue": F.when(int_like < 0.9, 0.05).otherwise(0.0)}.get(role, F.lit(0.0))
    return F.when(numeric, 0.35 + bonus).otherwise(0.0)


def role_scores(columns: DataFrame, profile: DataFrame, fuzzy: bool = False) -> DataFrame:
    """Score of every (grid, column, role) from header and content, with the magnitude tie-break.

    ``columns``: grid_id, ord, label. With ``fuzzy`` a header that names a role badly or not at all may be a misspelt synonym.
    """
    named = columns.groupBy(GRID, "ord").agg(F.min("label").alias("label"))
    # Header labels repeat over files: score each distinct text once.
    texts = named.select("label").distinct().withColumn("t", L.norm_label("label"))
    heads = texts.select("label", *[F.when(F.col("t") == "", 0.0).otherwise(G.synonym_scores(F.col("t"), r)).alias(f"h_{r}") for r in V.ROLES])
    if fuzzy:
        like = header_matches(texts, "label").where("method = 'similar'").groupBy("label").agg(*[F.max(F.when(F.col("role") == r, F.col("score"))).alias(f"f_{r}") for r in V.ROLES])
        better = lambda r: F.when(F.col(f"h_{r}") < 0, F.col(f"h_{r}")).otherwise(F.greatest(f"h_{r}", F.coalesce(f"f_{r}", F.lit(0.0))))
        heads = heads.join(like, "label", "left").select("label", *[better(r).alias(f"h_{r}") for r in V.ROLES])
    both = profile.join(named, [GRID, "ord"]).join(heads, "label")
    numeric = profile.where("num >= 0.7 and date < 0.5")
    extremes = numeric.groupBy(GRID).agg(
        F.count(F.lit(1)).alias("k"), F.min(F.struct("mean_abs", "ord")).alias("lo"), F.max(F.struct("mean_abs", "ord")).alias("hi")
    ).where("k >= 2").select(GRID, F.col("lo.ord").alias("small_ord"), F.col("hi.ord").alias("large_ord"))
    wide = both.join(extremes, GRID, "left")
    cells = []
    for i, r in enumerate(V.ROLES):
        h, c = F.col(f"h_{r}"), _content_score(r)
        tie = {"pax": F.col("ord") == F.col("small_ord"), "revenue": F.col("ord") == F.col("large_ord")}.get(r, F.lit(False))
        score = F.least(h, F.lit(1.0)) * 0.6 + F.least(c, F.lit(1.0)) * 0.55 + F.when(tie, 0.12).otherwise(0.0)
        method = F.when((h > 0) & (c > 0), "header+content").when(h > 0, "header").otherwise("content")
        cells.append(F.when((h > 0) | (c > 0), F.struct(F.lit(r).alias("role"), F.lit(i).alias("role_no"), score.alias("score"), method.alias("method"), h.alias("header_score"))))
    return wide.select(GRID, "ord", "label", F.explode(F.array_compact(F.array(*cells))).alias("x")).select(GRID, "ord", "label", "x.*")


def assign_roles(scores: DataFrame, floor: float = V.ASSIGN_FLOOR) -> DataFrame:
    """Greedy one-to-one assignment, best score first.

    With R roles, only a role's R best columns can ever be picked (the others block at most R - 1 of them),
    so each grid folds at most R * R candidates however wide the sheet is; the result is exact.
    """
    n = len(V.ROLES)
    live = top_per_group(scores.where(F.col("score") >= floor), [GRID, "role"], n, F.desc("score"), F.col("ord"), rank="__k").drop("__k")
    item = F.struct((-F.col("score")).alias("neg"), "ord", "role_no", "role", "label", "method")
    listed = live.groupBy(GRID).agg(F.array_sort(F.collect_list(item)).alias("items"))
    empty = F.expr("struct(cast(array() as array<int>) as ords, cast(array() as array<string>) as roles, filter(items, x -> false) as picks)")
    taken = lambda a, x: F.array_contains(a["ords"], x["ord"]) | F.array_contains(a["roles"], x["role"])
    step = lambda a, x: F.when(taken(a, x), a).otherwise(F.struct(
        F.array_append(a["ords"], x["ord"]).alias("ords"), F.array_append(a["roles"], x["role"]).alias("roles"), F.array_append(a["picks"], x).alias("picks")))
    folded = listed.select(GRID, F.explode(F.aggregate("items", empty, step)["picks"]).alias("p"))
    return folded.select(
        GRID, F.col("p.role").alias("role"), F.col("p.ord").alias("ord"), F.col("p.label").alias("label"),
        F.least(-F.col("p.neg"), F.lit(0.99)).alias("confidence"), F.col("p.method").alias("method"),
    )


def _by_role(assigned: DataFrame) -> DataFrame:
    """One row per grid: column number and confidence of every role."""
    pick = lambda r, c: F.max(F.when(F.col("role") == r, F.col(c)))
    return assigned.groupBy(GRID).agg(
        *[pick(r, "ord").alias(f"o_{r}") for r in V.ROLES], *[pick(r, "confidence").alias(f"k_{r}") for r in V.ROLES],
        *[pick(r, "method").alias(f"m_{r}") for r in V.ROLES], *[pick(r, "label").alias(f"l_{r}") for r in V.ROLES],
    )


FIRST_PLAUSIBLE = dt.date(2015, 1, 1)


def infer(cells: DataFrame, vocab: V.Vocab, today: dt.date, accept: float = V.ACCEPT, first: dt.date = FIRST_PLAUSIBLE, fuzzy: bool = False) -> Inference:
    """Canonical revenue rows from grids of unknown layout; what cannot be understood is rejected with a reason.

    Sheets with days across and metrics down are turned first. ``fuzzy`` lets misspelt headers and changed word order name a role.
    """
    # Texts are parsed once; all that follows works on what was read.
    cells = materialise(G.read_cells(cells, vocab.years))
    turned = materialise(G.find_transposed(cells, vocab))
    cells = cells if turned.isEmpty() else G.turn(cells, turned)
    meta = cells.groupBy(GRID).agg(F.min("source").alias("source"), F.min("sheet").alias("sheet"))
    # Each stage result is small next to the cells (one row per grid, column or grid row) and is written once.
    headers = materialise(G.find_headers(cells, vocab))
    labels = materialise(G.header_labels(cells, headers))
    columns = materialise(logical_columns(labels, vocab))
    titles = G.title_texts(cells, headers)
    data = materialise(G.drop_junk_rows(cells, headers, labels).select(GRID, "row_idx", "col_idx", "value", G.NORM, G.NUMBER, G.DAY).join(
        columns.withColumnRenamed("label", "__label"), [GRID, "col_idx"]))
    prof = materialise(profiles(data, vocab))
    key_cols = columns.where("key is not null").select(GRID, "layout").distinct()
    is_date = F.col("layout") == "date_wide"
    one, zero = F.lit(1.0), F.lit(0.0)
    key_profile = key_cols.select(
        GRID, F.lit(KEY_ORD).alias("ord"), F.lit(1).cast("bigint").alias("n"), F.when(is_date, one).otherwise(zero).alias("date"), zero.alias("num"),
        F.when(is_date, zero).otherwise(one).alias("loc"), zero.alias("seg"), F.when(is_date, zero).otherwise(one).alias("text"),
        F.lit(None).cast("double").alias("int_like"), F.lit(None).cast("double").alias("mean_abs"), one.alias("uniq"),
    )
    key_names = key_cols.select(GRID, F.lit(KEY_ORD).alias("ord"), F.when(is_date, "date").otherwise("location").alias("label"))
    scores = role_scores(columns.select(GRID, "ord", "label").unionByName(key_names), prof.unionByName(key_profile), fuzzy)
    by_role = materialise(_by_role(assign_roles(scores)))
    across = turned.select(GRID, F.lit("transposed").alias("__turned"))
    shape = columns.groupBy(GRID).agg(F.max("layout").alias("layout")).join(across, GRID, "left")
    shape = shape.select(GRID, F.coalesce("__turned", "layout").alias("layout"))

    # A sparse left-hand column of place names serves as section labels where no location column was found.
    size = prof.groupBy(GRID).agg(F.max("n").alias("n_rows"))
    section = prof.where((F.col("ord") < 3) & (F.col("loc") >= 0.8)).join(size, GRID).where(F.col("n") <= F.col("n_rows") * 0.6).groupBy(GRID).agg(
        F.min("ord").alias("section_ord"))
    header_text = labels.groupBy(GRID).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "label"))), lambda x: x["label"]), " | ").alias("header_text"))
    actuals = labels.select("label").distinct().withColumn("t", L.norm_label("label")).withColumn(
        "actual", (G.synonym_scores(F.col("t"), "revenue") >= 0.8) | (G.synonym_scores(F.col("t"), "pax") >= 0.8))
    has_actuals = labels.join(actuals, "label").groupBy(GRID).agg(F.bool_or("actual").alias("has_actuals"))

    text = F.concat_ws(" | ", "title", "header_text")
    context = F.lower(F.concat_ws(" ", "title", "sheet", "source", "header_text"))
    norm = L.norm_label(context)
    first_of = lambda f, *cs: F.coalesce(*[f(F.col(c)) for c in cs])
    place = lambda c: L.vocabulary_match(c, vocab.places)
    segment = lambda c: L.vocabulary_match(c, vocab.segments, 5)
    grid = (
        meta.join(headers.select(GRID, "header_row"), GRID, "left").join(titles, GRID, "left").join(header_text, GRID, "left")
        .join(has_actuals, GRID, "left").join(by_role, GRID, "left").join(section, GRID, "left").join(shape, GRID, "left")
        .withColumns({
            "unit": NB.unit_multiplier(text),
            "ctx_date": first_of(lambda c: D.date_in_text(c, vocab.years), "title", "source"),
            "ctx_location": first_of(place, "sheet", "title", "source"),
            "ctx_segment": first_of(segment, "title", "sheet", "source"),
            "budget": (norm.contains("geographical segment") & (norm.contains("unit id") | norm.contains("business segment")))
                      | (norm.rlike(r"\baop\b|annual operating plan|\bbudget\b") & ~F.coalesce("has_actuals", F.lit(False))),
        }).drop("title", "header_text")
    )
    grid = materialise(grid)
    pick = grid.select(GRID, "layout", *[f"o_{r}" for r in V.ROLES], "section_ord", "unit", "ctx_date", "ctx_location")
    located = data.join(pick.drop("layout"), GRID).withColumn("o_location", F.coalesce("o_location", "section_ord"))
    take = lambda r: F.max(F.when(F.col("ord") == F.col(f"o_{r}"), F.col("value")))
    carried = ["date", "location", "segment", "outlet", "business_unit"]
    ids = located.groupBy(GRID, "row_idx").agg(
        *[F.max(F.when(F.col("key").isNull() & (F.col("ord") == F.col(f"o_{r}")), F.col("value"))).alias(r) for r in carried],
        *[F.max(F.when(F.col("key").isNull() & (F.col("ord") == F.col(f"o_{m}")), F.col("value"))).alias(m) for m in V.METRICS],
    )
    ids = fill_down(ids, [GRID], "row_idx", ["location", "segment"])
    values = located.where("key is not null").groupBy(GRID, "row_idx", "key").agg(*[take(m).alias(m) for m in V.METRICS])
    wide_grids = key_cols.select(GRID)
    long_rows = ids.join(wide_grids, GRID, "left_anti").withColumn("key", F.lit(None).cast("string"))
    wide_rows = values.join(ids.drop(*V.METRICS), [GRID, "row_idx"])
    stacked = materialise(long_rows.unionByName(wide_rows, allowMissingColumns=True))
    merged = stacked.join(grid.select(
        GRID, "layout", "unit", "ctx_date", "ctx_location", "ctx_segment", "o_location", "section_ord", "o_segment", "o_outlet", "o_date"), GRID)
    by_keyword = L.keyword_class("outlet", vocab.outlet_keywords)
    hit_rate = merged.where(F.col("o_segment").isNull()).groupBy(GRID).agg(F.avg(by_keyword.isNotNull().cast("int")).alias("keyword_rate"))
    merged = merged.join(hit_rate, GRID, "left")
    from_keyword = F.coalesce("keyword_rate", F.lit(0.0)) >= 0.5
    raw_date = F.when((F.col("layout") == "date_wide") & (F.col("o_date") == KEY_ORD), F.col("key").try_cast("date")).when(
        F.col("o_date").isNotNull(), D.text_date("date", vocab.years)).otherwise(F.col("ctx_date"))
    raw_location = F.when((F.col("layout") == "location_wide") & (F.col("o_location") == KEY_ORD), F.col("key")).when(
        F.coalesce("o_location", "section_ord").isNotNull(), F.coalesce(place(F.col("location")), F.trim("location"))).otherwise(F.col("ctx_location"))
    raw_segment = F.when(F.col("o_segment").isNotNull(), F.coalesce(segment(F.col("segment")), F.trim("segment"))).when(
        from_keyword, F.coalesce(by_keyword, F.lit(vocab.default_segment))).otherwise(F.col("ctx_segment"))
    rows = materialise(merged.select(
        GRID, "row_idx", raw_date.alias("date"), raw_segment.alias("segment"), F.trim("outlet").alias("outlet"), raw_location.alias("location"),
        NB.messy_number("pax").alias("pax"), (NB.messy_number("revenue") * F.col("unit")).alias("revenue"),
        (NB.messy_number("aop") * F.col("unit")).alias("aop"), NB.messy_number("traffic").alias("traffic"),
    ).withColumn("outlet", F.coalesce("outlet", F.concat_ws(" - ", "location", "segment"))))

    grid = grid.join(hit_rate, GRID, "left")
    recovered = {
        "date": F.when(F.col("ctx_date").isNotNull(), 0.6),
        "location": F.when(F.col("section_ord").isNotNull(), 0.7).when(F.col("ctx_location").isNotNull(), 0.6),
        "segment": F.when(F.coalesce("keyword_rate", F.lit(0.0)) >= 0.5, 0.6).when(F.col("ctx_segment").isNotNull(), 0.55),
        "outlet": F.lit(0.5), "revenue": F.lit(None).cast("double"),
    }
    grid = grid.withColumns({f"c_{r}": F.coalesce(F.col(f"k_{r}"), recovered[r]) for r in V.REQUIRED})
    confs = [F.col(f"c_{r}") for r in V.REQUIRED]
    missing = F.array_compact(F.array(*[F.when(F.col(f"c_{r}").isNull(), F.lit(r)) for r in V.REQUIRED]))
    total = confs[0] + confs[1] + confs[2] + confs[3] + confs[4]
    confidence = F.least(*confs) * 0.7 + total / 5.0 * 0.3
    usable = rows.where("date is not null and location is not null and location <> '' and revenue is not null").groupBy(GRID).agg(F.count(F.lit(1)).alias("n_usable"))
    judged = grid.join(usable, GRID, "left").withColumn("confidence", F.when(F.size(missing) == 0, confidence))
    reason = (
        F.when(F.col("header_row").isNull(), "no header row found")
        .when(F.col("budget"), "budget workbook, load it as targets")
        .when(F.size(missing) > 0, F.concat(F.lit("not identified: "), F.array_join(missing, ", ")))
        .when(F.coalesce("n_usable", F.lit(0)) == 0, "no usable rows")
        .when(F.col("confidence") < accept, "confidence too low")
    )
    judged = materialise(judged.withColumn("reason", reason))
    status = judged.select(
        GRID, "source", "sheet", F.coalesce("layout", F.lit("unknown")).alias("layout"), F.coalesce("unit", F.lit(1.0)).alias("unit"), "confidence",
        F.col("reason").isNull().alias("accepted"), "reason",
    )
    checked = rows.withColumn("reason", row_reason(today, first))
    ok = checked.join(status.where("accepted").select(GRID), GRID, "left_semi")
    method = {r: F.coalesce(F.col(f"m_{r}"), F.lit("recovered")) for r in V.ROLES}
    report = judged.select(GRID, F.explode(F.array_compact(F.array(*[
        F.when((F.col(f"c_{r}") if r in V.REQUIRED else F.col(f"k_{r}")).isNotNull(), F.struct(
            F.lit(r).alias("role"), F.coalesce(F.concat(F.lit("column '"), F.col(f"l_{r}"), F.lit("'")), F.lit("context")).alias("source"), method[r].alias("method"),
            (F.col(f"c_{r}") if r in V.REQUIRED else F.col(f"k_{r}")).alias("confidence"))) for r in V.ROLES
    ]))).alias("m")).select(GRID, "m.*")
    return Inference(ok.where("reason is null").drop("reason"), ok.where("reason is not null"), status, report)


def row_reason(today: dt.date, first: dt.date = FIRST_PLAUSIBLE) -> Column:
    """Why a canonical row is not usable, NULL when it is."""
    return (
        F.when(F.col("date").isNull(), "no date")
        .when(F.col("location").isNull() | (F.trim("location") == ""), "no location")
        .when(F.col("revenue").isNull(), "no revenue")
        .when(~plausible_date("date", today, first), "implausible date")
    )


def plausible_date(day: str, today: dt.date, first: dt.date = FIRST_PLAUSIBLE) -> Column:
    """From 2015 to a year after ``today``."""
    return F.col(day).between(F.lit(first), F.date_add(F.lit(today), 366))


# Component weights and levels of the second confidence measure.
WEIGHTS = {
    "role_coverage": 0.25, "role_confidence": 0.25, "method_quality": 0.15, "validation": 0.15,
    "completeness_revenue": 0.10, "completeness_date": 0.05, "completeness_location": 0.05,
}
METHOD_QUALITY = {"header+content": 0.9, "header": 0.75, "content": 0.6, "recovered": 0.5}
LEVELS = (0.80, 0.55)


def confidence_v2(mapping: DataFrame, rows: DataFrame, validation: DataFrame) -> DataFrame:
    """Weighted confidence per grid from coverage, role confidence, method, validation and completeness.

    ``validation``: grid_id, pass_rate. Completeness is the plain share of filled values, weighted once.
    """
    quality = F.lit(0.5)
    for m, q in METHOD_QUALITY.items():
        quality = F.when(F.col("method") == m, q).otherwise(quality)
    roles = mapping.groupBy(GRID).agg(
        (F.count_if(F.col("role").isin(V.REQUIRED)) / len(V.REQUIRED)).alias("role_coverage"),
        F.avg(F.col("confidence").cast("decimal(18,12)")).cast("double").alias("role_confidence"), F.avg(quality.cast("decimal(18,6)")).cast("double").alias("method_quality"),
    )
    full = rows.groupBy(GRID).agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(f"completeness_{c}") for c in ("revenue", "date", "location")])
    joined = roles.join(full, GRID, "left").join(validation.select(GRID, F.col("pass_rate").alias("validation")), GRID, "left")
    score = F.lit(0.0)
    for k, w in WEIGHTS.items():
        score = score + F.coalesce(F.col(k), F.lit(0.5 if k == "validation" else 0.0)) * w
    level = F.when(F.col("score") >= LEVELS[0], "high").when(F.col("score") >= LEVELS[1], "medium").otherwise("low")
    return joined.withColumn("score", score).withColumn("level", level)
