"""Token-id output: tokenize every text and store the corpus in bit-packed files, in the order of the document ids."""

from __future__ import annotations

import os
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitemetrics.llm.bitpack import Reader, Writer, bits_for, crc32
from sitemetrics.llm.ranges import partitions_of, range_bounds, range_of
from sitemetrics.llm.texts import AS_IS, NOT_SPACE, slices, words
from sitemetrics.operators.reuse import stage_path, written

CACHE_WORDS = 1 << 21
#: Pieces that the tokenizer encodes at once, and bytes of text whose pieces are in memory at once.
ENCODED_AT_ONCE, TEXT_BYTES = 1 << 13, 1 << 20
#: Between pieces that are encoded as one text: a control character, which is one id.
_MARK = " \x01 "
_MARK_BYTES = np.frombuffer(_MARK.encode(), np.uint8)


class WordEncoder:
    """Encodes texts piece by piece, each distinct piece once.

    Pieces are split at ASCII white space. This equals encoding the whole text for tokenizers whose pre-tokenizer drops white space
    and whose tokens never cross it. Pieces reach the tokenizer as they stand: added tokens are told by their case. The cache is found
    by a hash, and every piece of a text is then compared with the cached one byte by byte; it is emptied when it holds CACHE_WORDS pieces.
    New pieces without digits go to the tokenizer as one text with a mark between them, by which its ids are parted again; where marks in
    the pieces themselves make this ambiguous, and with digits, each piece is encoded alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.known, self.start, self.length, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.bytes, self.byte_start, self.byte_length = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _apart(self, w, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast([w.word(i) for i in at.tolist()], add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _together(self, w, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = w.end[at] - w.start[at]
        begin = np.cumsum(size + len(_MARK)) - size - len(_MARK)
        text = np.empty(int(size.sum()) + len(at) * len(_MARK), np.uint8)
        text[_ranges(begin, size)] = w.low[_ranges(w.start[at], size)]
        text[_ranges(begin + size, np.full(len(at), len(_MARK)))] = np.tile(_MARK_BYTES, len(at))
        (found,) = self.tokenizer.encode_batch_fast([text[: -len(_MARK)].tobytes().decode()], add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(at) - 1:  # every mark put in gives one, so a piece holds another
            return self._apart(w, at)
        return np.delete(ids, marks), np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1

    def _encoded(self, w, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces, and where each piece's begin and how many they are."""
        digits = np.concatenate([[0], np.cumsum((w.low >= 48) & (w.low < 58))])
        alone = digits[w.end[at]] > digits[w.start[at]] if self.mark is not None else np.ones(len(at), bool)
        ids, length, order = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], []
        for those, encode in ((np.flatnonzero(~alone), self._together), (np.flatnonzero(alone), self._apart)):
            order.append(those)
            for lo in range(0, len(those), ENCODED_AT_ONCE):
                some_ids, some_length = encode(w, at[those[lo : lo + ENCODED_AT_ONCE]])
                ids.append(some_ids)
                length.append(some_length)
        back = np.argsort(np.concatenate(order))
        count = np.concatenate(length)
        return np.concatenate(ids), (np.cumsum(count) - count)[back], count[back]

    def _learn(self, w, value: np.ndarray, at: np.ndarray) -> None:
        ids, begin, length = self._encoded(w, at)
        size = w.end[at] - w.start[at]
        spelled = w.low[_ranges(w.start[at], size)]
        spelled_at = len(self.bytes) + np.cumsum(size) - size
        to = np.searchsorted(self.known, value)  # both ascend: merged, not sorted anew
        start = len(self.ids) + begin
        self.known, self.start, self.length = (np.insert(x, to, y) for x, y in ((self.known, value), (self.start, start), (self.length, length)))
        self.byte_start, self.byte_length = (np.insert(x, to, y) for x, y in ((self.byte_start, spelled_at), (self.byte_length, size)))
        self.ids, self.bytes = np.concatenate([self.ids, ids]), np.concatenate([self.bytes, spelled])

    def _others(self, w, entry: np.ndarray) -> np.ndarray:
        """Pieces that only share the hash of their cache entry."""
        size = w.end - w.start
        same = size == self.byte_length[entry]
        at = np.flatnonzero(same)
        wrong = w.low[_ranges(w.start[at], size[at])] != self.bytes[_ranges(self.byte_start[entry[at]], size[at])]
        if wrong.any():
            same[at[np.searchsorted(np.cumsum(size[at]), np.flatnonzero(wrong), "right")]] = False
        return np.flatnonzero(~same)

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it, and n + 1 offsets."""
        w = words(column, NOT_SPACE, AS_IS)
        value, at, which = np.unique(w.hash, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, value)
        new = np.ones(len(value), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != value[inside]
        if new.any():
            if len(self.known) + int(new.sum()) > CACHE_WORDS:
                self._clear()
                new[:] = True
            self._learn(w, value[new], at[new])
            place = np.searchsorted(self.known, value)
        start = np.append(self.start[place], len(self.ids))
        length = np.append(self.length[place], 1)
        ids = np.append(self.ids, np.uint32(end))
        others = self._others(w, place[which])
        if len(others):
            which = which.copy()
            which[others] = len(start) + np.arange(len(others))
            own, begin, count = self._encoded(w, others)
            start, length = np.append(start, len(ids) + begin), np.append(length, count)
            ids = np.append(ids, own)
        order = np.insert(which, w.first[1:], len(value))
        n = length[order]
        before = np.cumsum(n) - n
        out = ids[np.repeat(start[order] - before, n) + np.arange(int(n.sum()))]
        return out, np.append(0, (before + n)[w.first[1:] + np.arange(len(column))])


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., start[0] + size[0] - 1, start[1], ..."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _tokens(path: str, end: int, bounds: np.ndarray):
    def run(batches):
        encoder = _encoder(path)
        for batch in slices(batches, limit=TEXT_BYTES):
            ids, offsets = encoder.encode(batch.column("text"), end)
            blob = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.record_batch([pa.array(range_of(bounds, batch.column("id"))), batch.column("id"), blob], names=["shard", "id", "ids"])

    return run


def _vocabulary(path: str):
    """Number of ids, told by a task: a tokenizer that the driver loads takes its memory for good."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([_encoder(path).tokenizer.get_vocab_size(with_added_tokens=True)] * len(batch), pa.int64())], names=["size"])

    return run


def _write(folder: str, bits: int):
    """One file for each shard of the partition. Its name is new in every attempt; only files that a row names belong to the output."""

    def run(batches):
        writer = shard = None

        def closed():
            writer.close()
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([path]), pa.array([writer.starts[-1]], pa.int64()), pa.array([len(writer.keys)], pa.int64())], names=["shard", "path", "n_tokens", "n_docs"])

        for batch in batches:
            for k, key, blob in zip(*(batch.column(c) for c in ("shard", "id", "ids")), strict=True):
                if k.as_py() != shard:
                    if writer:
                        yield closed()
                    shard = k.as_py()
                    path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tokens"
                    writer = Writer(path, bits)
                writer.add(key.as_py(), np.frombuffer(blob.as_buffer(), "<u4"))
        if writer:
            yield closed()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token files in `folder`; returns the manifest (shard, path, n_tokens, n_docs, start), stored as a table beside them.

    `tokenizer` is a file of the tokenizers library whose tokens never cross white space.
    Files follow each other in ascending doc_id (bigint); rows of equal doc_id are ordered by their ids' bytes; a null doc_id comes
    first. A null or empty text is the end id alone. An empty table gives an empty manifest. Other columns are ignored.

    Texts are tokenized where they are read; one shuffle by id range moves the ids. `start` counts the ids of all files before.
    """
    bits = bits_for(docs.sparkSession.range(0, 1, 1, 1).mapInArrow(_vocabulary(tokenizer), "size long").first()["size"])
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = partitions_of(docs)
    bounds = range_bounds(docs, "id", n)
    tokens = docs.mapInArrow(_tokens(tokenizer, end_id, bounds), "shard int, id long, ids binary")
    ordered = tokens.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "id", "ids")
    files = written(ordered.mapInArrow(_write(folder, bits), "shard int, path string, n_tokens long, n_docs long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read(batches):
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            reader = Reader(path)
            for a, b, ids in reader.spans():
                starts = reader.starts[a : b + 1]
                inner = starts - starts[0]
                crc = [crc32(ids[x:y]) for x, y in zip(inner[:-1].tolist(), inner[1:].tolist(), strict=True)]
                keys = pa.array(reader.keys[a:b], mask=~reader.valid[a:b])
                yield pa.record_batch([keys, pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_index(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, read back from the files; one row for each."""
    files = manifest.select("shard", "path", "start")
    n = partitions_of(files)
    return files.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes `docs` to token files (in a new folder of the shared one, if none is given) and returns the index read back."""
    return token_index(write_tokens(docs, folder or stage_path(spark, "tokens"), tokenizer, end_id))
