"""Header texts matched to roles with tolerance for spelling and word order; each distinct text is matched once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemetrics.functions import labels as L
from sitemetrics.functions import vocabulary as V

# What a synonym counts as a whole word or as a part of a header, the least similarity of a misspelt header and its
# share of the weight, and the score under which misspelling is considered at all.
WORD, PART = 0.82, 0.65
LEAST_SIMILAR, MISSPELT, CLEAR = 0.82, 0.9, 0.6
# Headers that name no role whatever they resemble.
NO_ROLE = [
    r"^s\.? ?no\.?$", r"^sr\.? ?no\.?$", r"^sl\.? ?no\.?$", r"^serial", r"^row ?no", r"growth", r"variance", r"var\b", r"ytd", r"mtd", r"cumulative",
    r"avg\b", r"average", r"rate\b", r"penetration", r"achievement", r"\bvs\b", r"previous", r"last year", r"^%$", r"percent",
]


def token_sorted(label: Column) -> Column:
    """The words of a label in alphabetical order."""
    return F.array_join(F.array_sort(F.filter(F.split(label, " "), lambda w: w != "")), " ")


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / length of the longer text."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def _pairs_of_letters(text: Column) -> Column:
    """Distinct pairs of neighbouring letters, with marks at both ends. At a similarity of `LEAST_SIMILAR` an edit per 5.5 letters spoils
    two pairs each, so similar texts always share one.
    """
    marked = F.concat(F.lit("\u0001"), text, F.lit("\u0002"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substring(marked, i, F.lit(2))))


def header_matches(headers: DataFrame, column: str, bank: dict[str, list[tuple[str, float]]] | None = None) -> DataFrame:
    """(column, role, score, method) for each distinct header and role that it may name.

    The best of: the synonym itself (its weight), a whole word (0.82 of it), a part (0.65). Where that is under 0.6, synonyms are compared
    with the words of both in alphabetical order; from a similarity of 0.82 on they count 0.9 of it. Candidates for that come from a join
    on pairs of letters, which loses none. Headers of counters, rates and comparisons match nothing.
    """
    spark = headers.sparkSession
    rows = [(r, p, w) for r, ps in (bank or V.HEADER_SYNONYMS).items() for p, w in ps]
    synonyms = spark.createDataFrame(rows, "role string, pattern string, weight double").withColumn("p", L.norm_label("pattern"))
    texts = headers.select(column).where(F.col(column).isNotNull()).distinct().withColumn("t", L.norm_label(column)).where("t <> ''").where(~F.col("t").rlike("|".join(NO_ROLE)))
    banks = F.array(*[F.struct(F.lit(r).alias("role"), L.norm_label(F.lit(p)).alias("p"), F.lit(w).alias("w")) for r, p, w in rows])
    spaced = F.concat(F.lit(" "), F.regexp_replace("t", r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    word = lambda s: spaced.contains(F.concat(F.lit(" "), F.regexp_replace(s["p"], r"[^\p{L}\p{N}]+", " "), F.lit(" "))) & (F.length(s["p"]) >= 3)
    score = lambda s: F.when(F.col("t") == s["p"], s["w"]).when(word(s), s["w"] * WORD).when(F.col("t").contains(s["p"]) & (F.length(s["p"]) >= 4), s["w"] * PART)
    hits = F.filter(F.transform(banks, lambda s: F.struct(s["role"].alias("role"), score(s).alias("score"))), lambda x: x["score"].isNotNull())
    direct = texts.select(column, F.explode(hits).alias("h")).groupBy(column, F.col("h.role").alias("role")).agg(F.max("h.score").alias("direct"))
    ours = texts.select(column, token_sorted(F.col("t")).alias("s")).withColumn("pair", F.explode(_pairs_of_letters(F.col("s"))))
    theirs = synonyms.select("role", "weight", token_sorted(F.col("p")).alias("q")).withColumn("pair", F.explode(_pairs_of_letters(F.col("q"))))
    # Lengths decide first: a similar text is at most 18 % longer or shorter.
    near = F.least(F.length("s"), F.length("q")) >= LEAST_SIMILAR * F.greatest(F.length("s"), F.length("q")) - 1e-9
    met = ours.join(theirs, "pair").where(near).select(column, "role", "s", "q", "weight").distinct()
    like = met.withColumn("ratio", similarity(F.col("s"), F.col("q"))).where(F.col("ratio") >= LEAST_SIMILAR)
    fuzzy = like.groupBy(column, "role").agg(F.max(F.col("weight") * F.col("ratio") * MISSPELT).alias("fuzzy"))
    both = direct.join(fuzzy, [column, "role"], "full")
    misspelt = (F.coalesce("direct", F.lit(0.0)) < CLEAR) & (F.coalesce("fuzzy", F.lit(0.0)) > F.coalesce("direct", F.lit(0.0)))
    return both.select(column, "role", F.when(misspelt, F.col("fuzzy")).otherwise(F.col("direct")).alias("score"), F.when(misspelt, "similar").otherwise("synonym").alias("method")).where("score is not null")
