"""Dictionary terms in texts: a multi-pattern search as one equi-join.

A text is cut into words at everything that is neither letter nor digit; its runs of one, two, ... words are joined with the terms, so
a term is found only between word borders, and a dictionary of any size is a table instead of a chain of conditions in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def words_of(text: str | Column) -> Column:
    """Lower-case words of a text, in order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def terms_table(spark: SparkSession, vocabulary: dict[str, str]) -> DataFrame:
    """(term, name, priority) of a small vocabulary; earlier entries go first."""
    return spark.createDataFrame([(t, n, i) for i, (t, n) in enumerate(vocabulary.items())], "term string, name string, priority int")


def found_terms(texts: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """(column, name, term, at) for every distinct text that holds a term: the one of most words, then the longest, the first in the text,
    the first of the dictionary. ``terms``: term, name, priority. NULL texts and terms without a word are left out.
    """
    spelled = terms.select(words_of("term").alias("__w"), "name", "priority").where(F.size("__w") > 0).select(
        F.array_join("__w", " ").alias("term"), F.size("__w").alias("__n"), "name", "priority")
    lengths = sorted(r["__n"] for r in spelled.select("__n").distinct().collect())  # word counts of terms: a few small numbers
    distinct = texts.select(column).where(F.col(column).isNotNull()).distinct().withColumn("__w", words_of(column))
    runs = lambda n: F.when(F.size("__w") >= n, F.transform(
        F.sequence(F.lit(0), F.size("__w") - n), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("__w", i + 1, n), " ").alias("term"))))
    empty = F.expr("cast(array() as array<struct<at:int,term:string>>)")
    every = F.flatten(F.array(*[F.coalesce(runs(n), empty) for n in lengths])) if lengths else empty
    hits = distinct.select(column, F.explode(every).alias("__h")).select(column, "__h.at", "__h.term").join(spelled, "term")
    order = F.struct(-F.col("__n"), -F.length("term"), "at", "priority", "name")
    return hits.groupBy(column).agg(F.min_by(F.struct("name", "term", "at"), order).alias("__b")).select(column, "__b.*")


def tag(df: DataFrame, column: str, terms: DataFrame, out: str) -> DataFrame:
    """``df`` with the name of the term that each text holds, NULL without one; texts are searched once however often they occur."""
    found = found_terms(df, column, terms).select(F.col(column).alias("__text"), F.col("name").alias(out))
    return df.join(found, F.col(column) == F.col("__text"), "left").drop("__text")
