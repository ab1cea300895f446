"""Improbable-feature fingerprints of documents.

Every window of WINDOW bytes has an entropy class; a class is the rarer, the fewer windows of the whole corpus have it. Within each run of
RUN windows the rarest one (the first of equals) gets a vote; windows with LEAST_VOTES votes or more are the document's features. Where
no window has so many (few runs, or text of a period under LEAST_VOTES bytes), all that have a vote are. Features go into a chain of Bloom filters of FILTER_BITS bits, the next one beginning when a filter has taken FULL features. Two fingerprints are
compared by the bits that their filters share, normalised between what chance gives and what would be full overlap.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.llm.ranges import partitions_of, range_bounds, range_of
from sitemetrics.llm.texts import mix, slices, text_buffer

WINDOW, RUN, LEAST_VOTES = 64, 64, 16
FILTER_BITS, PROBES, FULL = 2048, 5, 160
CLASSES = 1000
#: Share of the overlap above chance that still counts as none.
CUT = 0.05
SLICE = 1 << 20
_SCALE = 1 << 24
_GAIN = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], np.int64)
_MOST = round(WINDOW * np.log2(WINDOW) * _SCALE)


def entropy_classes(data: np.ndarray) -> np.ndarray:
    """Entropy class (0 .. CLASSES - 1) of each window of `data`: its share of the greatest entropy, from exact integer sums.

    A window's sum of c * log2(c) over byte counts c changes by two terms from one window to the next: those of the byte that leaves and
    of the byte that enters. Their counts come from the byte's earlier and later places, found in the places sorted by byte.
    """
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (len(data) + WINDOW) + order
    upto = np.searchsorted(key, key + WINDOW)  # behind the last place of the same byte less than WINDOW further on
    own = np.empty(len(data), np.int64)
    own[order] = upto - np.arange(len(data))  # times in the window that begins here
    since = np.searchsorted(key, key - WINDOW, "right")
    back = np.empty(len(data), np.int64)
    back[order] = np.arange(len(data)) - since  # times in the WINDOW - 1 bytes before
    leaves = own[: n - 1]
    enters = back[WINDOW:]
    total = np.empty(n, np.int64)
    total[0] = _GAIN[np.bincount(data[:WINDOW], minlength=256)].sum()
    total[1:] = total[0] + np.cumsum(_GAIN[leaves - 1] - _GAIN[leaves] + _GAIN[enters + 1] - _GAIN[enters])
    return np.minimum((_MOST - total) * CLASSES // _MOST, CLASSES - 1)


def _inside(offsets: np.ndarray, n: int, size: int) -> np.ndarray:
    """Whether each of n starts of `size` bytes lies in one text."""
    text = np.searchsorted(offsets, np.arange(n), "right") - 1
    return np.arange(n) + size <= offsets[text + 1]


def class_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Windows of each entropy class over all texts; CLASSES numbers come to the driver."""

    def run(batches):
        total = np.zeros(CLASSES, np.int64)
        for batch in slices(batches, limit=SLICE):
            data, offsets = text_buffer(batch.column("text"))
            found = entropy_classes(data)
            if len(found):
                total += np.bincount(found[_inside(offsets, len(found), WINDOW)], minlength=CLASSES)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["kind", "n"])

    out = np.zeros(CLASSES, np.int64)
    for r in docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect():
        out[r["kind"]] = r["n"]
    return out


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each class, 0 the rarest; classes without windows come last in order of class."""
    ranks = np.empty(CLASSES, np.int64)
    ranks[np.lexsort((np.arange(CLASSES), np.where(counts > 0, counts, np.iinfo(np.int64).max)))] = np.arange(CLASSES)
    return ranks


def _feature_places(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Starts of the features of all texts, ascending. A text with fewer windows than a run votes over all its windows at once."""
    found = entropy_classes(data)
    n = len(found)
    if not n:
        return np.zeros(0, np.int64)
    key = ranks[found] * (1 << 40) + np.arange(n)
    m = n - RUN + 1
    votes = np.zeros(n, np.int64)
    if m > 0:
        low, width = key, 1
        while width < RUN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = low[_inside(offsets, m, WINDOW + RUN - 1)]
        votes = np.bincount(low & ((1 << 40) - 1), minlength=n)
    chosen = np.flatnonzero(votes >= LEAST_VOTES)
    length = np.diff(offsets)
    short = [a + int(np.argmin(key[a : a + k - WINDOW + 1])) for a, k in zip(offsets[:-1].tolist(), length.tolist(), strict=True) if WINDOW <= k < WINDOW + RUN - 1]
    none = (np.diff(np.searchsorted(chosen, offsets)) == 0) & (length >= WINDOW + RUN - 1)
    if none.any():
        voted = np.flatnonzero(votes)
        chosen = np.union1d(chosen, voted[none[np.searchsorted(offsets, voted, "right") - 1]])
    return np.union1d(chosen, np.array(short, np.int64)) if short else chosen


def _hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    lanes = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at]
    words = np.ascontiguousarray(lanes).view("<u8")
    out = np.full(len(at), 0x1F83D9ABFB41BD6B, np.uint64)
    for k in range(words.shape[1]):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[:, k])
    return out


def _whole(data: np.ndarray) -> np.ndarray:
    """Hash of a text that is shorter than a window."""
    padded = np.zeros(WINDOW, np.uint8)
    padded[: len(data)] = data
    return _hashes(padded, np.zeros(1, np.int64)) + np.uint64(len(data))


def _chain(hashes: np.ndarray) -> np.ndarray:
    """Filters (one row of bytes each) of one text's features; each distinct feature goes in once, in order of its first place."""
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    bits = np.zeros((-(-len(hashes) // FULL), FILTER_BITS), bool)
    for k in range(PROBES):
        bits[np.arange(len(hashes)) // FULL, ((hashes >> np.uint64(11 * k)) % np.uint64(FILTER_BITS)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def fingerprints(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    """Filter chain of each text; an empty text has no filter."""
    places = _feature_places(data, offsets, ranks)
    hashes = _hashes(data, places) if len(places) else np.zeros(0, np.uint64)
    cut = np.searchsorted(places, offsets)
    out = []
    for k in range(len(offsets) - 1):
        a, b = offsets[k], offsets[k + 1]
        if a == b:
            out.append(np.zeros((0, FILTER_BITS // 8), np.uint8))
        else:
            mine = hashes[cut[k] : cut[k + 1]]
            out.append(_chain(mine if len(mine) else _whole(data[a:b]) + np.uint64(b - a)))
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """0 to 1: each filter of the shorter chain against its best in the other, weighted by its bits.

    Overlap counts from what chance gives (plus CUT of the rest) up to the fewer bits of the two. Two empty chains are alike (1), an
    empty and another aren't (0); equal chains have 1.
    """
    if len(x) == 0 or len(y) == 0:
        return float(len(x) == len(y))
    if x.shape == y.shape and (x == y).all():
        return 1.0
    if len(x) > len(y):
        x, y = y, x
    nx, ny = np.bitwise_count(x).sum(axis=1).astype(float), np.bitwise_count(y).sum(axis=1).astype(float)
    total = 0.0
    for row, bits in zip(x, nx, strict=True):
        both = np.bitwise_count(row[None, :] & y).sum(axis=1)
        most = np.minimum(bits, ny)
        least = bits * ny / FILTER_BITS
        least = least + CUT * (most - least)
        total += bits * max(0.0, float(np.max(np.where(most > least, (both - least) / np.maximum(most - least, 1e-9), 0.0))))
    return min(1.0, total / nx.sum())


def _text(chain: np.ndarray) -> str:
    return f"{len(chain)}:{base64.b64encode(chain.tobytes()).decode()}"


def parse(fingerprint: str) -> np.ndarray:
    """Filter chain of a fingerprint as written by `compare_with_next`."""
    n, _, data = fingerprint.partition(":")
    return np.frombuffer(base64.b64decode(data), np.uint8).reshape(int(n), FILTER_BITS // 8)


def _chains(texts: list[str], ranks: np.ndarray) -> list[np.ndarray]:
    return fingerprints(*text_buffer(pa.array(texts, pa.large_string())), ranks)


def _firsts(bounds: np.ndarray):
    """Least id of each range in the batches; a null id, which comes before all others, is told by `empty`."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id")
            if len(ids):
                place, value = range_of(bounds, ids), ids.fill_null(0).to_numpy(zero_copy_only=False)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                order = np.lexsort((value, ~null, place))
                head = order[np.append(True, place[order][1:] != place[order][:-1])]
                yield pa.record_batch([pa.array(place[head]), pa.array(value[head]), pa.array(null[head])], names=["shard", "id", "empty"])

    return run


def _dealt(bounds: np.ndarray, before: dict[tuple[int, int | None], int]):
    """Rows with their range; the rows of a range's first id go to the range before it as well."""

    def run(batches):
        for batch in slices(batches):
            place = range_of(bounds, batch.column("id"))
            own = pa.record_batch([pa.array(place), pa.array(np.zeros(len(batch), bool)), batch.column("id"), batch.column("text")], names=["shard", "extra", "id", "text"])
            yield own
            again = [(k, before[s, i]) for k, (s, i) in enumerate(zip(place.tolist(), batch.column("id").to_pylist(), strict=True)) if (s, i) in before]
            if again:
                rows = pa.array([k for k, _ in again])
                yield pa.record_batch([pa.array([s for _, s in again], pa.int32()), pa.array(np.ones(len(again), bool)), batch.column("id").take(rows), batch.column("text").take(rows)], names=["shard", "extra", "id", "text"])

    return run


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(ranks: np.ndarray):
    def out(ids: list, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
        """Results for all rows but the last, which is there as the next one."""
        halves = [len(t) // 2 for t in texts[:-1]]
        edited = [t[: len(t) - h] + following[:h] for t, h, following in zip(texts, halves, texts[1:], strict=False)]
        chains, changed = _chains(texts, ranks), _chains(edited, ranks)
        return pa.record_batch([
            pa.array(ids[:-1], kind), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([_text(c) for c in chains[:-1]]), pa.array([_text(c) for c in changed]),
            pa.array([likeness(a, b) for a, b in zip(chains, changed, strict=False)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(chains, chains[1:], strict=False)], pa.float64()),
        ], names=NAMES)

    def run(batches):
        ids, texts, done = [], [], False
        for batch in slices(batches, limit=SLICE):
            if done:
                continue
            extra = batch.column("extra").to_pylist()
            keep = extra.index(True) + 1 if True in extra else len(extra)
            done = True in extra
            ids += batch.column("id").to_pylist()[:keep]
            texts += [t or "" for t in batch.column("text").to_pylist()[:keep]]
            if len(texts) > 1:
                yield out(ids, texts, batch.column("id").type)
                ids, texts = ids[-1:], texts[-1:]

    return run


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every whole text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document in ascending
    doc_id (bigint); after the last comes the first. Rows of one doc_id follow each other by text, a null doc_id comes before all others,
    a null text is empty, and a document alone is its own next. One row for each input row; an empty table gives none; other columns
    are ignored. A text shorter than a window is one feature by itself; an empty text has a fingerprint without filters.

    Texts are moved once, by id range; the first rows of a range are also sent to the range before it.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranks = rarity_ranks(class_counts(docs))
    bounds = range_bounds(docs, "id", partitions_of(docs))
    heads = docs.select("id").mapInArrow(_firsts(bounds), "shard int, id long, empty boolean").groupBy("shard").agg(F.max("empty").alias("empty"), F.min(F.when(~F.col("empty"), F.col("id"))).alias("least"))
    rows = sorted((r["shard"], None if r["empty"] else r["least"]) for r in heads.collect())  # one row for each range
    before = {rows[k]: rows[k - 1][0] for k in range(len(rows))}
    dealt = docs.mapInArrow(_dealt(bounds, before), "shard int, extra boolean, id long, text string")
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "extra", F.asc_nulls_first("id"), "text")
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.drop("shard").mapInArrow(_compared(ranks), kind)
