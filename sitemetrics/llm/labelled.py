"""Bounded samples of labelled documents for fitting, and byte shapes of tokens; shared by the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitemetrics.llm.texts import AS_IS, NOT_SPACE, Words, text_buffer, words

#: Byte classes of a shape: lower and non-ASCII letters a, upper A, digits 0, white space and punctuation as they are.
_CLASS = AS_IS.copy()
_CLASS[[*range(97, 123), *range(128, 256)]] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_CLASS[9:14] = 32


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int, where: Column | None = None) -> DataFrame:
    """(id, text, label) of at most `rows` labelled documents, those of the least id hashes; null ids and labels are left out.

    An id labelled repeatedly takes its greatest label. `where` is a condition on `id` for the rows that may be used.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    marks = marks.where(where) if where is not None else marks
    chosen = marks.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return found.join(F.broadcast(chosen), "id")  # `rows` rows of two numbers at most


def shapes(column: pa.Array) -> Words:
    """Tokens with runs of one byte class made one byte (Word -> Aa, NO!! -> A!), in the order of the tokens themselves."""
    data, offsets = text_buffer(column)
    kind = _CLASS[data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(kind)]] = True
    at = np.concatenate([[0], np.cumsum(new)])[offsets].astype(np.int64)
    return words(pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(at), pa.py_buffer(kind[new])), NOT_SPACE, AS_IS)
