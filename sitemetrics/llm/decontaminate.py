"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark window (a run of `window` item words) is a set of word shingles that must all occur in a document. For exact containment
the necessary prefix is the window's rarest shingle: shingles are ordered by document frequency over all documents, windows and documents
are joined on that one, the shingle's position in the window bounds the window's place in the document, and the words are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.llm.bitfilter import bit_filter, passes
from sitemetrics.llm.texts import ALNUM, as_signed, shingles, slices, words
from sitemetrics.operators.reuse import written

SHINGLE = 3


def _windows(window: int):
    """Windows of each item with their shingles and the shingles' offsets; an item of fewer words is one window."""

    def run(batches):
        for batch in slices(batches):
            w = words(batch.column("text"), ALNUM)
            item, text, size, key, offset = [], [], [], [], []
            short = {k: shingles(w, k) for k in range(1, SHINGLE)}
            full, at = shingles(w, SHINGLE)
            for i in range(len(batch)):
                a, b = int(w.first[i]), int(w.first[i + 1])
                n = b - a
                if not n:
                    continue
                hashes, starts = (full, at) if n >= SHINGLE else short[n]
                lo, hi = np.searchsorted(starts, [a, b])
                mine = hashes[lo:hi].view(np.int64)
                every = [w.word(k) for k in range(a, b)]
                length = min(n, window)
                inner = length - min(SHINGLE, n) + 1
                for s in range(n - length + 1):
                    item += [batch.column("item")[i].as_py()] * inner
                    text += [" ".join(every[s : s + length])] * inner
                    size += [length] * inner
                    key += mine[s : s + inner].tolist()
                    offset += range(inner)
            yield pa.record_batch([pa.array(item, pa.string()), pa.array(text, pa.string()), pa.array(size, pa.int64()), pa.array(key, pa.int64()), pa.array(offset, pa.int64())], names=["item", "words", "size", "key", "offset"])

    return run


def _candidate_shingles(w, known: np.ndarray):
    """Hash and first word of every document shingle that the filter lets pass; sizes below SHINGLE serve items that short."""
    for size in range(1, SHINGLE + 1):
        hashes, at = shingles(w, size)
        keep = passes(known, hashes.view(np.int64))
        yield hashes[keep], at[keep]


def _frequencies(known: np.ndarray):
    def run(batches):
        for batch in slices(batches):
            w = words(batch.column("text"), ALNUM)
            hashes, at = (np.concatenate(x) for x in zip(*_candidate_shingles(w, known), strict=True))
            order = np.lexsort((w.text[at], hashes))
            h, t = hashes[order], w.text[at][order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]) if len(h) else np.zeros(0, bool)
            value, n = np.unique(h[new], return_counts=True)
            yield pa.record_batch([as_signed(value), pa.array(n)], names=["key", "n"])

    return run


def _places(known: np.ndarray, window: int):
    """For each document its number of words, and for each place of a known shingle the words around it."""

    def run(batches):
        for batch in slices(batches):
            w = words(batch.column("text"), ALNUM)
            count = np.diff(w.first)
            n = len(batch)
            yield pa.record_batch([batch.column("id"), batch.column("mark"), pa.array(count), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=NAMES)
            for hashes, at in _candidate_shingles(w, known):
                if not len(at):
                    continue
                text = w.text[at]
                lo = np.maximum(at - (window - 1), w.first[text])
                hi = np.minimum(at + window, w.first[text + 1])
                around = [" ".join(w.word(k) for k in range(a, b)) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                row = pa.array(text)
                yield pa.record_batch([batch.column("id").take(row), batch.column("mark").take(row), pa.nulls(len(at), pa.int64()), as_signed(hashes), pa.array(at - w.first[text]), pa.array(at - lo), pa.array(around, pa.string())], names=NAMES)

    return run


NAMES = ["id", "mark", "n_words", "key", "place", "before", "around"]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): document words inside an occurrence of a benchmark window.

    Words are runs of 0-9, a-z and all characters from U+0080 on, after lower-casing A-Z. A window is `window` consecutive words of
    an item; an item of fewer words, but not none, is one window. n_items counts items with an occurring window; items_sha256 is over
    their ids, sorted as strings and joined by commas (of the empty string if there is none).

    One row for each distinct (doc_id, text): repeated rows are one document. A null text or an item without text has no words and
    no windows. A null item_id joins its windows as hits, and counts as no item. A null doc_id is a document like any other. An empty
    benchmark finds nothing; empty documents give no rows. Other columns are ignored.

    What reaches every task is a bit filter of fixed size; windows and places meet in joins, whatever the size of the benchmark.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    kind = docs.schema["id"].dataType.simpleString()
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    parts = written(items.mapInArrow(_windows(window), "item string, words string, size long, key long, offset long"), "windows")

    of_window = parts.groupBy("words", "size", "key").agg(F.min("offset").alias("offset"))
    found = docs.select("text").mapInArrow(_frequencies(bit_filter(parts.select("key"), "key")), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rarest = of_window.join(found, "key").groupBy("words", "size").agg(F.min_by(F.struct("key", "offset"), F.struct("n", "offset")).alias("p"), F.count("*").alias("present"))
    every = of_window.groupBy("words", "size").agg(F.count("*").alias("needed"))
    prefix = written(rarest.join(every, ["words", "size"]).where("present = needed").select("words", "size", "p.key", "p.offset"), "prefix")

    places = docs.mapInArrow(_places(bit_filter(prefix, "key"), window), f"id {kind}, mark long, n_words long, key long, place long, before long, around string")
    places = written(places, "places")
    bounds = F.expr("before >= offset AND size(split(around, ' ')) >= before - offset + size")
    same = F.expr("array_join(slice(split(around, ' '), CAST(before - offset + 1 AS INT), CAST(size AS INT)), ' ') = words")
    hits = places.where("key IS NOT NULL").join(prefix, "key").where(bounds).where(same)
    hits = written(hits.select("id", "mark", (F.col("place") - F.col("offset")).alias("start"), "size", "words"), "hits")

    covered = hits.select("id", "mark", F.explode(F.expr("sequence(start, start + size - 1)")).alias("word")).distinct().groupBy("id", "mark").agg(F.count("*").alias("n_hit"))
    owners = parts.where("item IS NOT NULL").select("words", "item").distinct()
    named = hits.select("id", "mark", "words").distinct().join(owners, "words").groupBy("id", "mark").agg(F.collect_set("item").alias("items"))
    parts_of_doc = (
        places.where("n_words IS NOT NULL").select("id", "mark", "n_words", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
        .unionByName(covered, allowMissingColumns=True).unionByName(named, allowMissingColumns=True)
    )
    out = parts_of_doc.groupBy("id", "mark").agg(F.max("n_words").alias("n_words"), F.coalesce(F.max("n_hit"), F.lit(0)).alias("n_hit"), F.sort_array(F.coalesce(F.max("items"), F.array())).alias("items"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.col("mark").alias("text_hash"),
    )
