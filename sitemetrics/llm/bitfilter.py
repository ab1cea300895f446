"""A membership filter of fixed size: no false negatives, so a scan can drop most rows before an exact join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.llm.texts import mix

FILTER_BITS = 23


def _places(values: np.ndarray, bits: int) -> np.ndarray:
    return mix(values.astype(np.int64).view(np.uint64) ^ np.uint64(0x51ED270B7F4A7C15)) >> np.uint64(64 - bits)


def bit_filter(values: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """2**bits bits with one set for each value of a bigint column (nulls set none).

    At most 2**(bits - 6) words of 8 bytes come to the driver, whatever the number of values; a fuller filter lets more rows pass
    to the exact step that must follow, and never loses one.
    """

    def partial(batches):
        words = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            place = _places(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(words, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.record_batch([pa.array(at), pa.array(words[at].view(np.int64))], names=["word", "mask"])

    found = values.select(column).mapInArrow(partial, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return out


def passes(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each signed 64-bit value may be in the filter."""
    place = _places(values, int(len(words) * 64).bit_length() - 1)
    return (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
