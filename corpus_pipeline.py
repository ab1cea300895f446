"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing, token files. Each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemetrics.llm.decontaminate import contamination
from sitemetrics.llm.mixing import replicate
from sitemetrics.llm.near_dedup import near_duplicates
from sitemetrics.llm.ordinal_quality import accepted_documents, fit_ordinal
from sitemetrics.llm.registry import query, ship_package, table
from sitemetrics.llm.token_output import store_tokens
from sitemetrics.operators.reuse import written

END_ID = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are probably below grade 1."""
    ship_package(spark)
    return accepted_documents(docs, fit_ordinal(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each group (five-word shingles, similarity 0.8 or more)."""
    ship_package(spark)
    dropped = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs."""
    ship_package(spark)
    leaks = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("leak_id"), "text_hash")
    same = docs["doc_id"].eqNullSafe(F.col("leak_id")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("text_hash"))
    return docs.join(leaks, same, "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that every source is expected to have the same share."""
    return replicate(docs).drop("mix_rate", "mix_copy", "mix_key")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes bit-packed token files; returns the index read back from them: doc_id, start, n_tokens, ids_crc32."""
    ship_package(spark)
    return store_tokens(spark, docs, public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_files", token_files)]

#: A fitted classifier and a tokenizer can't be written in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
