"""Vectorised word kernels over the UTF-8 buffer of an Arrow string column; used inside `mapInArrow` tasks.

Every delimiter of the word rules here is one ASCII byte, so words are found on bytes without decoding. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
SEGMENT_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 5
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS + np.uint8(32) * ((AS_IS >= 65) & (AS_IS <= 90))
_BYTE_VALUE = np.random.default_rng(20260101).integers(1, 2**63, 256, dtype=np.uint64)
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and n + 1 offsets."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `limit` bytes of text (one row at least), which bounds a task's memory."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(column))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # the worker stays for later tasks


@dataclass
class Words:
    """Words of a batch in order: byte range, hash of the lower-cased word, number of its text; `first[i]:first[i + 1]` are text i's."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray

    def word(self, i: int) -> str:
        return self.low[self.start[i] : self.end[i]].tobytes().decode()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    base[:1] = inverse[:1] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


_POWERS = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def words(column: pa.Array, letters: np.ndarray, case: np.ndarray = LOWER) -> Words:
    """Words of every text: maximal runs of bytes marked in `letters`, after replacing bytes by `case` (A-Z by a-z, unless AS_IS)."""
    data, offsets = text_buffer(column)
    low = case[data]
    starts, ends, hashes, at = [], [], [], 0
    edges = offsets[(offsets > 0) & (offsets < len(low))]
    while at < len(low):
        to = min(at + SEGMENT_BYTES, len(low))
        while to < len(low) and letters[low[to]]:  # end behind a word
            run = letters[low[to : to + SEGMENT_BYTES]]
            stop = int(run.argmin())
            to += stop if not run[stop] else len(run)
        piece = low[at:to]
        inside = letters[piece]
        breaks = edges[np.searchsorted(edges, at, "right") : np.searchsorted(edges, to, "left")] - at
        before = np.concatenate([[False], inside[:-1]])
        before[breaks] = False
        after = np.concatenate([inside[1:], [False]])
        after[breaks - 1] = False
        s, e = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        if len(piece) >= len(_POWERS[0]):
            _POWERS[:] = _powers(max(len(piece) + 1, SEGMENT_BYTES + 4096))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[piece] * _POWERS[0][: len(piece)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * _POWERS[1][s]))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    first = np.searchsorted(start, offsets, "left")
    return Words(low, start, end, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.repeat(np.arange(len(column)), np.diff(first)), first)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words of one text, and the index of each shingle's first word."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.text[:n] == w.text[size - 1 :])
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + w.hash[at + k])
    return out, at


def as_signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the signed Arrow column that Spark reads."""
    return pa.array(x.view(np.int64))
