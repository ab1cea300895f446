"""Hierarchical Pitman-Yor language model over words, with Chinese-restaurant seating resampled in Gibbs sweeps.

Every word of the training rows (and the start of a text) is a context with a restaurant of its own; all of them share one parent
restaurant, whose base is uniform over the vocabulary and an unknown word. A context that training rows don't have falls back to the parent.

Words are spread by hash over parts. A rare word's customers in all restaurants lie together in its part. Frequent words (1 / FREQUENT of
the training tokens or more, so their number has a bound) would overfill one: their customers lie in the part of the context's word if that
is rare, and their own parent customers and mutual counts on the driver.

Stages: (1) count words; (2) tokenize once more into a store with one row for each part (its words, and who says them in what context) and
one for each block of documents (frequent words behind frequent words); (3) sweeps over the parts: every word's customers are seated anew,
given the number of tables of each restaurant. Totals of frequent contexts and of the parent pass through the driver. Those of rare contexts
are added up in the part that owns the context, and each part is sent back those that it has customers of, as a file in the shared folder;
(4) each part scores its words for the documents, averaged over the samples.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.llm.bitpack import open_folder
from sitemetrics.llm.ranges import partitions_of
from sitemetrics.llm.texts import NOT_SPACE, as_signed, slices, words
from sitemetrics.operators.reuse import stage_path, written

FREQUENT = 1000
STRENGTH, PARENT_STRENGTH = 1.0, 1.0
BURN_IN, SAMPLES = 1, 3
SEED = 11
END = np.uint64(0x0E0D0C0B0A090807)
BLOCK_BYTES, BLOCK_DOCS = 12 << 20, 60000
#: Customers of one dish that are seated one by one; later ones in groups of a sixteenth of those present.
ONE_BY_ONE = 64
SCORED_AT_ONCE = 1 << 18
#: Rare contexts that a letter between parts holds on average, where there are as many.
LETTER = 4096


def _is_training(ids: pa.Array) -> np.ndarray:
    """Whether crc32 of the id as text, modulo 10, isn't 0."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0 for i in ids.to_pylist()], bool)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's END behind its words; number of the text; and whether a token is a text's first."""
    w = words(column, NOT_SPACE)
    at = w.first[1:]
    n = np.diff(w.first) + 1
    text = np.repeat(np.arange(len(column)), n)
    first = np.zeros(len(text), bool)
    first[np.cumsum(n) - n] = True
    return np.insert(w.hash, at, END), text, first


def _count(batches):
    for batch in slices(batches, limit=BLOCK_BYTES):
        train = _is_training(batch.column("id"))
        value, n = np.unique(_tokens(batch.column("text").filter(pa.array(train)))[0], return_counts=True)
        yield pa.record_batch([as_signed(value), pa.array(n)], names=["word", "n"])


def seat(customers: np.ndarray, new_table: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating each dish's customers anew: a customer opens one with a weight of `new_table`, else joins another's.

    With n customers at t tables the latter weighs n - discount * t, so table sizes needn't be kept. The first customer always opens one.
    """
    order = np.argsort(-customers, kind="stable")
    c, weight = customers[order], new_table[order]
    tables = np.minimum(c, 1)
    n = 1
    while True:
        live = int(np.searchsorted(-c, -n, "left"))  # dishes with more than n customers
        if not live:
            break
        size = 1 if n < ONE_BY_ONE else n // 16
        group = np.minimum(size, c[:live] - n)
        chance = weight[:live] / (weight[:live] + n - discount * tables[:live])
        tables[:live] += rng.binomial(group, chance) if size > 1 else rng.random(live) < chance
        n += size
    out = np.empty_like(tables)
    out[order] = tables
    return out


class Restaurants:
    """Totals of each context (customers, tables) and of the parent, the discounts, and the parent's probability of each frequent word."""

    def __init__(self, customers: np.ndarray, vocabulary: int, discount: float, parent_discount: float):
        self.customers, self.vocabulary, self.discount, self.parent_discount = customers, vocabulary, discount, parent_discount
        self.tables, self.parent_customers, self.parent_tables, self.frequent = customers * 0, 0, 0, np.zeros(0)

    def after(self, tables: np.ndarray, parent_customers: int, parent_tables: int) -> Restaurants:
        out = Restaurants(self.customers, self.vocabulary, self.discount, self.parent_discount)
        out.tables, out.parent_customers, out.parent_tables = tables, parent_customers, parent_tables
        return out

    def joined(self, customers: np.ndarray, tables: np.ndarray) -> Restaurants:
        """With a part's rare contexts behind the frequent ones."""
        out = Restaurants(np.append(self.customers, customers), self.vocabulary, self.discount, self.parent_discount)
        out = out.after(np.append(self.tables, tables), self.parent_customers, self.parent_tables)
        out.frequent = self.frequent
        return out

    def weight(self) -> np.ndarray:
        """Weight of the parent in each context; context 0 is the parent itself."""
        out = (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers)
        out[0] = 1.0
        return out

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Predictive probability of words in the parent."""
        base = (PARENT_STRENGTH + self.parent_discount * self.parent_tables) / (self.vocabulary + 1)
        return (customers - self.parent_discount * tables + base) / (PARENT_STRENGTH + self.parent_customers)

    def inner(self, context: np.ndarray, customers: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Predictive probability in a context's restaurant; context 0 is the parent itself."""
        rest = (STRENGTH + self.discount * self.tables[context]) * parent
        return np.where(context == 0, parent, (customers - self.discount * tables + rest) / (STRENGTH + self.customers[context]))


class Dishes:
    """Cells (word, context, customers) of one set of words and their seating; context 0 has no restaurant, so its customers go to the parent.

    `lent` has for each word its place among the frequent ones, or -1. Frequent words sit in the parent elsewhere (on the driver).
    """

    def __init__(self, n: int, word: np.ndarray, context: np.ndarray, customers: np.ndarray, seed: int, lent: np.ndarray | None = None):
        self.lent = np.full(n, -1) if lent is None else lent
        self.away = self.lent >= 0
        self.n, self.word, self.context, self.customers = n, word, context, customers
        self.direct = np.bincount(word[context == 0], customers[context == 0], n).astype(np.int64)
        self.own = np.flatnonzero(context > 0)
        self.tables = np.zeros(len(word), np.int64)
        self.tables[self.own] = 1
        self.seed, self.sweeps = seed, 0
        self._parents(None)

    def _parents(self, parent_tables: np.ndarray | None) -> None:
        self.sent = self.direct + np.bincount(self.word[self.own], self.tables[self.own], self.n).astype(np.int64)
        self.parent_customers = np.where(self.away, 0, self.sent)
        self.parent_tables = np.minimum(self.parent_customers, 1) if parent_tables is None else parent_tables

    def resume(self, sweeps: int, tables: np.ndarray | None = None, parent_tables: np.ndarray | None = None, direct: np.ndarray | None = None) -> None:
        """Takes up the state behind a sweep; None for a table's first state."""
        self.sweeps = sweeps
        if tables is not None:
            self.tables[self.own] = tables
        if direct is not None:
            self.direct = direct
        self._parents(parent_tables)

    def parent(self, shared: Restaurants) -> np.ndarray:
        out = shared.parent(self.parent_customers, self.parent_tables)
        out[self.away] = shared.frequent[self.lent[self.away]]
        return out

    def sweep(self, shared: Restaurants, direct: np.ndarray | None = None) -> None:
        """Seats all customers anew in the contexts, then their tables in the parent, given everyone's totals of the last sweep.

        `direct` are new numbers of customers that come to the parent from elsewhere.
        """
        self.sweeps += 1
        rng = np.random.default_rng([SEED, self.seed, self.sweeps])
        parent = self.parent(shared)
        u, w = self.context[self.own], self.word[self.own]
        self.tables[self.own] = seat(self.customers[self.own], (STRENGTH + shared.discount * shared.tables[u]) * parent[w], shared.discount, rng)
        self.direct = self.direct if direct is None else direct
        self._parents(None)
        base = (PARENT_STRENGTH + shared.parent_discount * shared.parent_tables) / (shared.vocabulary + 1)
        self._parents(seat(self.parent_customers, np.full(self.n, base), shared.parent_discount, rng))

    def by_context(self, contexts: int) -> np.ndarray:
        return np.bincount(self.context[self.own], self.tables[self.own], contexts).astype(np.int64)

    def totals(self, contexts: int) -> np.ndarray:
        """Tables by context, then the parent's customers and tables."""
        by_context = self.by_context(contexts)
        return np.append(by_context, [self.parent_customers.sum(), self.parent_tables.sum()])

    def predict(self, shared: Restaurants) -> tuple[np.ndarray, np.ndarray]:
        """Predictive probability of each word in the parent, and of each cell."""
        parent = self.parent(shared)
        return parent, shared.inner(self.context, self.customers, self.tables, parent[self.word])


def _bytes(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


STORE = "kind int, number long, part int, words binary, sizes binary, docs binary, flags binary, said binary, context binary, near binary"
FIELDS = ["kind", "number", "part", "words", "sizes", "docs", "flags", "said", "context", "near"]
PART, BLOCK = 0, 1
PIECE = {"words": np.uint64, "sizes": np.uint32, "flags": np.uint8, "said": np.uint16, "context": np.uint32, "near": np.uint64}


def _packed(*arrays: np.ndarray) -> list[bytes]:
    """Each array's size and its byte planes, compressed; ascending 64-bit values as differences."""
    out = []
    for a in arrays:
        a = np.diff(a, prepend=a.dtype.type(0)) if a.dtype == np.uint64 else a
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        out.append(np.int64(len(planes)).tobytes() + pa.compress(planes, codec="zstd", asbytes=True))
    return out


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size, n = int(np.frombuffer(data[:8], np.int64)[0]), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    out = np.ascontiguousarray(planes.reshape(n, -1).T).view(kind).ravel()
    return np.cumsum(out, dtype=np.uint64) if kind is np.uint64 else out


def _row(kind: int, number: int, part: int, *arrays: np.ndarray, form=_bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([kind], pa.int32()), pa.array([number], pa.int64()), pa.array([part], pa.int32()), *[pa.array([b], pa.binary()) for b in form(*arrays)]], names=FIELDS)


def _home(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of a rare word."""
    return ((hashes >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _places(frequent: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each word among the frequent ones, or -1."""
    place = np.searchsorted(frequent, hashes)
    return np.where(frequent[np.minimum(place, len(frequent) - 1)] == hashes, place, -1)


def _pieces(frequent: np.ndarray, parts: int):
    """One row for each block and part with its words, and one for each block with its documents and frequent words behind frequent ones.

    A context is 1 + its place among the frequent words or, from 1 + their number on, the place of a rare word in `near`.

    A block's number is a hash of its documents' places in this task, so it is made once and travels with all its rows.
    """

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        for batch in slices(batches, limit=BLOCK_BYTES):
            for lo in range(0, len(batch), BLOCK_DOCS):
                part_of = batch.slice(lo, BLOCK_DOCS)
                ids = part_of.column("id")
                flags = _is_training(ids) + 2 * ids.is_null().to_numpy(zero_copy_only=False)
                docs = ids.fill_null(0).to_numpy(zero_copy_only=False)
                token, text, first = _tokens(part_of.column("text"))
                number = _places(frequent, token) + 1
                context, before = np.append(0, number[:-1]), np.append(END, token[:-1])
                context[first] = int(np.searchsorted(frequent, END)) + 1
                hot = (number > 0) & (context > 0)
                block = (task << 32) + made
                made += 1
                yield _row(BLOCK, block, block % parts, np.bincount(text, minlength=len(docs)).astype(np.uint32), np.bincount(text[hot], minlength=len(docs)).astype(np.uint32), docs, flags.astype(np.uint8), number[hot].astype(np.uint16), context[hot].astype(np.uint16), np.zeros(0, np.uint64))
                rare = np.flatnonzero(~hot)
                part = _home(np.where(number > 0, before, token)[rare], parts)
                order = np.lexsort((text[rare], token[rare], part))
                rare, part = rare[order], part[order]
                cut = np.searchsorted(part, np.arange(parts + 1))
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    mine = rare[cut[k] : cut[k + 1]]
                    value, size = np.unique(token[mine], return_counts=True)
                    own = context[mine].astype(np.uint32)
                    near, own_near = np.unique(before[mine][own == 0], return_inverse=True)
                    own[own == 0] = len(frequent) + 1 + own_near
                    yield _row(PART, block, k, value, size.astype(np.uint32), np.zeros(0, np.int64), flags.astype(np.uint8), text[mine].astype(np.uint16), own, near, form=_packed)

    return run


def _gathered(contexts: int, parts: int):
    """Rows of blocks as they are; rows of one part become one, sorted by word. `docs` then has the block of each run of `said`.

    `near` becomes one list of the part, ordered by the parts that own its words.
    """

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for k in range(len(batch)):
                if batch.column("kind")[k].as_py() == BLOCK:
                    yield batch.slice(k, 1)
                else:
                    row = {f: batch.column(f)[k].as_py() for f in FIELDS}
                    found.setdefault(row["part"], []).append(row)
        for part, rows in found.items():
            rows.sort(key=lambda r: r["number"])
            for r in rows:
                r |= {f: _unpacked(r[f], kind) for f, kind in PIECE.items()}
            value = np.concatenate([np.repeat(r["words"], r["sizes"]) for r in rows])
            block = np.concatenate([np.full(len(r["said"]), k, np.uint32) for k, r in enumerate(rows)])
            said = np.concatenate([r["said"] for r in rows])
            near = np.unique(np.concatenate([r["near"] for r in rows]))
            by_home = np.argsort(_home(near, parts), kind="stable")
            place = np.empty(len(near), np.uint32)
            place[by_home] = contexts + np.arange(len(near))
            numbers = (np.append(np.arange(contexts, dtype=np.uint32), place[np.searchsorted(near, r["near"])]) for r in rows)
            context = np.concatenate([of[r["context"]] for of, r in zip(numbers, rows, strict=True)])
            train = np.concatenate([r["flags"][r["said"]] & 1 for r in rows])
            order = np.argsort(value, kind="stable")
            distinct, size = np.unique(value, return_counts=True)
            docs = np.array([r["number"] for r in rows], np.int64)
            both = (block[order].astype(np.uint32) << np.uint32(1)) | train[order]
            yield _row(PART, 0, part, distinct, size.astype(np.uint32), docs, both, said[order], context[order], near[by_home])

    return run


class Folder:
    """Arrays of uint32 in files of the shared folder. What a name holds is the same in every attempt of a task."""

    def __init__(self, path: str):
        self.path = path

    def save(self, name: str, values: np.ndarray) -> None:
        system, inner = open_folder(self.path)
        system.create_dir(inner, recursive=True)
        data = np.ascontiguousarray(values, np.uint32)
        own = f"{inner}/{name}-{uuid.uuid4().hex}"
        with system.open_output_stream(own, compression=None) as out:
            out.write(np.array([len(data)], np.int64).tobytes())
            out.write(pa.compress(data.tobytes(), codec="lz4", asbytes=True))
        system.move(own, f"{inner}/{name}")

    def load(self, name: str) -> np.ndarray:
        system, inner = open_folder(self.path)
        with system.open_input_stream(f"{inner}/{name}", compression=None) as file:
            data = file.read()
        n = int(np.frombuffer(data[:8], np.int64)[0])
        return np.frombuffer(pa.decompress(data[8:], decompressed_size=4 * n, codec="lz4", asbytes=True), np.uint32).astype(np.int64)


class Part:
    """A part's words, sayings and dishes."""

    def __init__(self, batch: pa.RecordBatch, k: int, frequent: np.ndarray):
        def field(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(batch.column(name)[k].as_buffer(), kind)

        self.number, self.near = int(batch.column("part")[k].as_py()), field("near", np.uint64)
        self.n = len(field("words", np.uint64))
        self.word = np.repeat(np.arange(self.n, dtype=np.int32), field("sizes", np.uint32))
        both = field("flags", np.uint32)
        self.block, self.blocks, self.said = both >> 1, field("docs", np.int64), field("said", np.uint16)
        self.context = field("context", np.uint32)
        train = (both & 1).astype(bool)
        self.shared = len(frequent) + 1
        self.contexts = self.shared + len(self.near)
        cell, count = np.unique(self.word[train].astype(np.int64) * self.contexts + self.context[train], return_counts=True)
        self.cell = cell
        self.count = np.bincount(self.word[train], minlength=self.n)
        self.dishes = Dishes(self.n, cell // self.contexts, cell % self.contexts, count.astype(np.int64), self.number + 1, _places(frequent, field("words", np.uint64)))

    def keep(self, folder: Folder, step: int) -> None:
        folder.save(f"state-{step}-{self.number}", np.append(self.dishes.tables[self.dishes.own], self.dishes.parent_tables))

    def resume(self, folder: Folder, step: int) -> None:
        state, n = folder.load(f"state-{step}-{self.number}"), len(self.dishes.own)
        self.dishes.resume(step, state[:n], state[n:])

    def restaurants(self, shared: Restaurants, folder: Folder, step: int) -> Restaurants:
        """All restaurants of this part's cells, with everyone's totals behind a sweep."""
        if not len(self.near):
            return shared
        return shared.joined(folder.load(f"customers-{self.number}"), folder.load(f"tables-{step}-{self.number}"))


def _parts(batches, frequent: np.ndarray):
    for batch in batches:
        for k in range(len(batch)):
            yield Part(batch, k, frequent)


LETTERS = "owner int, part int, keys binary, customers binary, tables binary, place long, n long"
ANSWERS = "part int, owner int, customers binary, tables binary"


def _offices(near: int, parts: int) -> int:
    """How many owners share the rare contexts: so many that the letters, one from each part to each owner, grow in number with `near` only.

    `near` is how many rare contexts the parts have customers of, a context counted once for each part.
    """
    return max(1, min(parts, near // (parts * LETTER)))


def _sweep(step: int, shared: Restaurants | None, frequent: np.ndarray, parts: int, offices: int, folder: Folder):
    """State behind a sweep (0: the first one). Gives the totals of frequent contexts, the parent and frequent words (`place`; below 0 counts
    of counts) and, to each owner, a letter on its rare contexts; what doesn't change is in the first letter only."""
    contexts = len(frequent) + 1
    names = [f.split()[0] for f in LETTERS.split(", ")]

    def rows(size: int, **columns) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(columns[f], kind) if f in columns else pa.nulls(size, kind) for f, kind in zip(names, kinds, strict=True)], names=names)

    def run(batches):
        total = np.zeros(contexts + 2 + len(frequent), np.int64)
        ones = np.zeros(4, np.int64)
        for part in _parts(batches, frequent):
            dishes = part.dishes
            if step:
                part.resume(folder, step - 1)
                dishes.sweep(part.restaurants(shared, folder, step - 1))
            part.keep(folder, step)
            tables = dishes.by_context(part.contexts)
            sent = np.zeros(len(frequent), np.int64)
            sent[dishes.lent[dishes.away]] = dishes.sent[dishes.away]
            total += np.concatenate([tables[:contexts], [dishes.parent_customers.sum(), dishes.parent_tables.sum()], sent])
            c, p = dishes.customers[dishes.own], part.count[~dishes.away]
            ones += [np.count_nonzero(c == 1), np.count_nonzero(c == 2), np.count_nonzero(p == 1), np.count_nonzero(p == 2)]
            tables = tables[contexts:].astype(np.uint32)
            customers = np.bincount(dishes.context, dishes.customers, part.contexts)[contexts:].astype(np.uint32)
            cut = np.searchsorted(_home(part.near, parts) * offices // parts, np.arange(offices + 1)).tolist()
            for owner in np.flatnonzero(np.diff(cut)).tolist():
                a, b = cut[owner], cut[owner + 1]
                letter = {"owner": [owner], "part": [part.number], "tables": _bytes(tables[a:b])}
                yield rows(1, **letter) if step else rows(1, **letter, keys=_bytes(part.near[a:b]), customers=_bytes(customers[a:b]))
            del part, dishes, c, p
        at = np.append(np.arange(len(total)), -1 - np.arange(4))
        yield rows(len(at), place=at, n=np.append(total, ones))

    return run


def _by(batches, key: str):
    """Rows by a key."""
    found: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            found.setdefault(row[key], []).append(row)
    return found.items()


def _answers(step: int, folder: Folder):
    """Adds up the letters on each rare context and answers each with the sums."""

    def run(batches):
        for owner, letters in _by(batches, "owner"):
            letters.sort(key=lambda r: r["part"])
            if not step:
                which = np.unique(np.frombuffer(b"".join(r["keys"] for r in letters), np.uint64), return_inverse=True)[1]
                folder.save(f"contexts-{owner}", which)
            else:
                which = folder.load(f"contexts-{owner}")
            cut = np.append(0, np.cumsum([len(r["tables"]) // 4 for r in letters])).tolist()
            sums = {f: np.bincount(which, np.frombuffer(b"".join(r[f] for r in letters), np.uint32))[which].astype(np.uint32) for f in (("tables",) if step else ("tables", "customers"))}
            for k, r in enumerate(letters):
                said = [pa.array(_bytes(sums[f][cut[k] : cut[k + 1]]), pa.binary()) if f in sums else pa.nulls(1, pa.binary()) for f in ("customers", "tables")]
                yield pa.record_batch([pa.array([r["part"]], pa.int32()), pa.array([owner], pa.int32()), *said], names=["part", "owner", "customers", "tables"])

    return run


def _delivered(step: int, folder: Folder):
    """Puts each part's answers, which follow the order of its contexts, into its file."""

    def run(batches):
        for part, answers in _by(batches, "part"):
            answers.sort(key=lambda r: r["owner"])
            folder.save(f"tables-{step}-{part}", np.frombuffer(b"".join(r["tables"] for r in answers), np.uint32))
            if not step:
                folder.save(f"customers-{part}", np.frombuffer(b"".join(r["customers"] for r in answers), np.uint32))
            yield pa.record_batch([pa.array([part], pa.int32())], names=["part"])

    return run


def _hot_cells(contexts: int):
    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                said, context = (np.frombuffer(batch.column(f)[k].as_buffer(), np.uint16).astype(np.int64) for f in ("said", "context"))
                train = np.repeat(np.frombuffer(batch.column("flags")[k].as_buffer(), np.uint8) & 1, np.frombuffer(batch.column("sizes")[k].as_buffer(), np.uint32)).astype(bool)
                cell, n = np.unique(said[train] * contexts + context[train], return_counts=True)
                yield pa.record_batch([pa.array(cell), pa.array(n)], names=["cell", "n"])

    return run


def _scored(history: list[Restaurants], frequent: np.ndarray, count: np.ndarray, folder: Folder, total: float, vocabulary: int):
    """For each block that a part has words of: its documents, the scores of these words and how many are known."""

    def run(batches):
        for part in _parts(batches, frequent):
            chance = np.zeros(len(part.word))
            for step in range(BURN_IN + 1, len(history)):
                part.resume(folder, step)
                shared = part.restaurants(history[step], folder, step)
                (parent, cell), weight = part.dishes.predict(shared), shared.weight()
                for lo in range(0, len(chance), SCORED_AT_ONCE):
                    here = slice(lo, lo + SCORED_AT_ONCE)
                    word, context = part.word[here], part.context[here]
                    key = word.astype(np.int64) * part.contexts + context
                    at = np.minimum(np.searchsorted(part.cell, key), max(len(part.cell) - 1, 0))
                    known = part.cell[at] == key if len(part.cell) else np.zeros(len(key), bool)
                    chance[here] += np.where(known, cell[at] if len(cell) else 0.0, weight[context] * parent[word]) / (len(history) - 1 - BURN_IN)
            times = part.count.copy()
            times[part.dishes.away] = count[part.dishes.lent[part.dishes.away]]
            part.dishes = part.cell = shared = parent = cell = weight = None  # room for the sums
            yield from _by_block(part, np.log10(chance, out=chance), times[part.word], total, vocabulary)
            del part

    return run


def _by_block(part: Part, score: np.ndarray, c: np.ndarray, total: float, vocabulary: int):
    """Sums over each document's tokens in the part; c has how often the training rows say each token."""
    base = np.log10((c + 0.1) / (total + 0.1 * (vocabulary + 1)))
    place = part.block.astype(np.int64) << 16 | part.said
    value, which = np.unique(place, return_inverse=True)
    sums = [np.bincount(which, x, len(value)) for x in (score, base, c > 0)]
    cut = np.searchsorted(value >> 16, np.arange(len(part.blocks) + 1))
    for k, number in enumerate(part.blocks.tolist()):
        a, b = cut[k], cut[k + 1]
        fields = _bytes((value[a:b] & 0xFFFF).astype(np.uint16), sums[0][a:b].astype(np.float32), sums[1][a:b], sums[2][a:b].astype(np.uint32))
        yield pa.record_batch([pa.array([PART], pa.int32()), pa.array([number]), *[pa.array([f], pa.binary()) for f in fields]], names=["kind", "number", "said", "score", "base", "known"])


def _of_blocks(matrix: np.ndarray, count: np.ndarray, total: float, vocabulary: int):
    """The same for a block's frequent words, with its documents' ids and numbers of tokens."""
    base = np.log10((count + 0.1) / (total + 0.1 * (vocabulary + 1)))

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                tokens, sizes, docs, flags = (np.frombuffer(batch.column(f)[k].as_buffer(), t) for f, t in (("words", np.uint32), ("sizes", np.uint32), ("docs", np.int64), ("flags", np.uint8)))
                said, context = (np.frombuffer(batch.column(f)[k].as_buffer(), np.uint16).astype(np.int64) - d for f, d in (("said", 1), ("context", 0)))
                text = np.repeat(np.arange(len(docs)), sizes)
                score, plain = np.bincount(text, matrix[said, context], len(docs)), np.bincount(text, base[said], len(docs))
                known = np.bincount(text, count[said] > 0, len(docs))
                fields = _bytes(docs, flags, tokens, score, plain, known.astype(np.uint32))
                yield pa.record_batch([pa.array([BLOCK], pa.int32()), batch.column("number").slice(k, 1), *[pa.array([f], pa.binary()) for f in fields]], names=["kind", "number", "docs", "flags", "tokens", "score", "base", "known"])

    return run


SCORED = "kind int, number long, said binary, score binary, base binary, known binary"
OF_BLOCK = "kind int, number long, docs binary, flags binary, tokens binary, score binary, base binary, known binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _together(batches):
    """Adds what the parts say about each block to the block's own row; rows come sorted by block, its own first."""
    now: dict = {}

    def done():
        return pa.record_batch([
            pa.array(now["docs"], mask=now["null"]), pa.array(now["held"]), pa.array(now["tokens"]), pa.array(now["known"].astype(np.int64)), pa.array(now["base"]), pa.array(now["score"]),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    for batch in batches:
        for k in range(len(batch)):
            row = {f: batch.column(f)[k].as_py() for f in batch.schema.names}
            if row["docs"] is not None:
                if now:
                    yield done()
                flags = np.frombuffer(row["flags"], np.uint8)
                now = {"docs": np.frombuffer(row["docs"], np.int64), "null": (flags & 2) > 0, "held": (flags & 1) == 0, "known": np.frombuffer(row["known"], np.uint32).astype(float)}
                now |= {"score": np.frombuffer(row["score"]).copy(), "base": np.frombuffer(row["base"]).copy(), "tokens": np.frombuffer(row["tokens"], np.uint32).astype(np.int64)}
            else:
                at = np.frombuffer(row["said"], np.uint16)
                now["score"][at] += np.frombuffer(row["score"], np.float32)
                now["base"][at] += np.frombuffer(row["base"])
                now["known"][at] += np.frombuffer(row["known"], np.uint32)
    if now:
        yield done()


def _discount(once: int, twice: int) -> float:
    """Estimate from the numbers of dishes with one and with two customers."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.05


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Tokens are the words of the text (A-Z lower-cased, split at ASCII white space) and one end. The model and the base learn from rows
    whose crc32 of the id as text, modulo 10, isn't 0; the others are held out. base_score is the sum over tokens of log10 of their
    smoothed frequency, score that of the model's predictive probability, averaged over the samples of the seating.

    One row for each input row, repeated rows included. A null or empty text is the end alone; a null id counts as the empty text;
    other columns are ignored. With no training rows every word is unknown. An empty table gives no rows. Seating is drawn from seeded
    generators by part, so scores differ a little (not base_score) with the number of shuffle partitions.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = partitions_of(docs)
    counts = written(docs.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    size = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, vocabulary = size["n"] or 0, size["v"]
    end = int(END.astype(np.int64))
    top = {r["word"]: r["n"] for r in counts.where((F.col("n") * FREQUENT >= total) | (F.col("word") == end)).collect()}  # FREQUENT + 1 at most
    top.setdefault(end, 0)
    frequent = np.sort(np.array(list(top), np.int64).view(np.uint64))
    count = np.array([top[w] for w in frequent.view(np.int64).tolist()], np.int64)
    contexts = len(frequent) + 1

    pieces = docs.mapInArrow(_pieces(frequent, parts), STORE).repartitionById(parts, F.col("part"))
    store = written(pieces.mapInArrow(_gathered(contexts, parts), STORE), "sayings")
    of_parts, of_blocks = store.where(F.col("kind") == PART), store.where(F.col("kind") == BLOCK)
    cells = of_blocks.mapInArrow(_hot_cells(contexts), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()  # contexts ** 2 at most
    cell, n = cells.column("cell").to_numpy(), cells.column("n").to_numpy()

    hot = Dishes(len(frequent), cell // contexts - 1, cell % contexts, n.astype(np.int64), 0)
    folder = Folder(stage_path(docs.sparkSession, "seating"))
    offices = _offices((of_parts.agg(F.sum(F.octet_length("near"))).first()[0] or 0) // 8, parts)

    def swept(step: int, shared: Restaurants | None) -> dict[int, int]:
        letters = written(of_parts.mapInArrow(_sweep(step, shared, frequent, parts, offices, folder), LETTERS), "letters")
        mail = letters.where("owner IS NOT NULL").select("owner", "part", "keys", "customers", "tables")
        answers = mail.repartitionById(offices, F.col("owner")).mapInArrow(_answers(step, folder), ANSWERS)
        answers.repartitionById(parts, F.col("part")).mapInArrow(_delivered(step, folder), "part int").agg(F.max("part")).collect()
        return {r["place"]: r["n"] for r in letters.where("place IS NOT NULL").groupBy("place").agg(F.sum("n").alias("n")).collect()}

    def places(found: dict[int, int], start: int, n: int) -> np.ndarray:
        return np.array([found.get(start + k, 0) for k in range(n)], np.int64)

    found = swept(0, None)
    hot.resume(0, direct=places(found, contexts + 2, len(frequent)))
    inner = hot.customers[hot.own]
    once, twice = (found.get(-1 - k, 0) + int(np.count_nonzero(inner == k + 1)) for k in (0, 1))
    first = Restaurants(np.append(0, count), vocabulary, _discount(once, twice), _discount(found.get(-3, 0), found.get(-4, 0)))
    history: list[Restaurants] = []
    matrix = np.zeros((len(frequent), contexts))
    for step in range(BURN_IN + SAMPLES + 1):
        if step:
            found = swept(step, history[-1])
            hot.sweep(history[-1], places(found, contexts + 2, len(frequent)))
        now = places(found, 0, contexts + 2) + hot.totals(contexts)
        history.append(first.after(now[:contexts], int(now[-2]), int(now[-1])))
        history[-1].frequent, chance = hot.predict(history[-1])
        if step > BURN_IN:
            sample = history[-1].weight()[None, :] * history[-1].frequent[:, None]
            sample[hot.word, hot.context] = chance
            matrix += sample / SAMPLES
    matrix = np.log10(matrix)
    own = of_blocks.mapInArrow(_of_blocks(matrix, count, total, vocabulary), OF_BLOCK)
    said = of_parts.mapInArrow(_scored(history, frequent, count, folder, total, vocabulary), SCORED)
    rows = own.unionByName(said, allowMissingColumns=True).repartition(parts, "number").sortWithinPartitions("number", F.desc("kind"))
    return rows.mapInArrow(_together, RESULT).withColumn("train_tokens", F.lit(total).cast("long"))
