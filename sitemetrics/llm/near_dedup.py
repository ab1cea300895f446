"""MinHash near-duplicate detection with tensored banding.

Two small collections of minhash tuples are drawn: `PAIRS` tuples of two and `SINGLES` of one. Every pair of a tuple of the first and
one of the second is a table key, so 60 tables of three minhashes take 26 minhashes instead of 180. Two sets of similarity s meet
in a table with probability (1 - (1 - s**2)**10) * (1 - (1 - s)**6): 0.9999 at 0.8, more above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitemetrics.llm.bitfilter import bit_filter, passes
from sitemetrics.llm.components import components
from sitemetrics.llm.texts import NOT_SPACE, as_signed, mix, shingles, slices, words
from sitemetrics.operators.reuse import written

PAIRS, SINGLES = 10, 6
HASHES = 2 * PAIRS + SINGLES
#: Below this agreement of signatures a pair isn't verified; a pair of similarity 0.8 falls below it with a probability of 3e-5.
LEAST_AGREEMENT = 12
#: Classes of a bucket that all its others are compared with first.
PIVOTS = 4
#: Up to so many classes of a bucket all meet each other; that is no more pairs than pivots would make.
SMALL = 2 * PIVOTS + 1
KEY_FILTER_BITS = 25
#: Bytes of text whose words are in memory at once.
TEXT_BYTES = 1 << 20
#: Words of 64 bits in a parity sketch.
SKETCH = 8
_RANDOM = np.random.default_rng(71).integers(1, 2**63, (2, HASHES), dtype=np.uint64)
_XOR, _FACTOR = _RANDOM[0], _RANDOM[1] * np.uint64(2) + np.uint64(1)


def _sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, one text after the other; n + 1 offsets."""
    w = words(column, NOT_SPACE)
    hashes, at = shingles(w, size)
    text = w.text[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.full(len(short), 1, np.uint64) + count[short].astype(np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            whole[has] = mix(whole[has] * np.uint64(0xD6E8FEB86659FD93) + w.hash[w.first[short[has]] + k])
        hashes, text = np.concatenate([hashes, whole]), np.concatenate([text, short])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])
        hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(column) + 1))


def _features(size: int):
    def run(batches):
        for batch in slices(batches, limit=TEXT_BYTES):
            values, offsets = _sets(batch.column("text"), size)
            count = np.diff(offsets)
            full = np.flatnonzero(count)
            at, n = offsets[:-1][full], len(batch)
            signature, digest = np.zeros((n, HASHES), np.uint64), np.zeros((2, n), np.uint64)
            if len(full):
                for k in range(HASHES):
                    signature[full, k] = np.minimum.reduceat((values ^ _XOR[k]) * _FACTOR[k], at)
                digest[0, full] = np.add.reduceat(_digest_a(values), at)
                digest[1, full] = np.add.reduceat(mix(values + np.uint64(0x1234567)), at)
            lists = pa.ListArray.from_arrays(np.arange(0, n * HASHES + 1, HASHES, dtype=np.int32), as_signed(signature.ravel()))
            yield pa.record_batch([batch.column("id"), pa.array(count.astype(np.int64)), as_signed(digest[0]), as_signed(digest[1]), lists], names=["id", "n_shingles", "set_a", "set_b", "signature"])

    return run


def _members(size: int, known: np.ndarray):
    def run(batches):
        for batch in slices(batches, limit=TEXT_BYTES):
            batch = batch.filter(batch.column("id").is_valid())
            batch = batch.filter(pa.array(passes(known, batch.column("id").to_numpy(zero_copy_only=False))))
            if not len(batch):
                continue
            values, offsets = _sets(batch.column("text"), size)
            blobs = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch([batch.column("id"), pa.array(blobs, pa.binary())], names=["id", "members"])

    return run


def _elements(size: int, known: np.ndarray):
    """(set_a, element) of the texts whose ids may be among the known ones."""

    def run(batches):
        for batch in slices(batches, limit=TEXT_BYTES):
            batch = batch.filter(batch.column("id").is_valid())
            batch = batch.filter(pa.array(passes(known, batch.column("id").to_numpy(zero_copy_only=False))))
            if not len(batch):
                continue
            values, offsets = _sets(batch.column("text"), size)
            count = np.diff(offsets)
            digest = np.zeros(len(batch), np.uint64)
            if len(values):
                digest[count > 0] = np.add.reduceat(_digest_a(values), offsets[:-1][count > 0])
            yield pa.record_batch([batch.column("id").take(pa.array(np.repeat(np.arange(len(batch)), count))), as_signed(np.repeat(digest, count)), as_signed(values)], names=["id", "set_a", "element"])

    return run


def _sketches(size: int, known: np.ndarray):
    """(id, set_a, sketch) of the texts whose ids may be among the known ones: how often, modulo 2, a set's shingles hash to each bit.

    Two sketches differ in no more bits than their sets differ in shingles.
    """

    def run(batches):
        for batch in slices(batches, limit=TEXT_BYTES):
            batch = batch.filter(batch.column("id").is_valid())
            batch = batch.filter(pa.array(passes(known, batch.column("id").to_numpy(zero_copy_only=False))))
            if not len(batch):
                continue
            values, offsets = _sets(batch.column("text"), size)
            full = np.flatnonzero(np.diff(offsets))
            at, n = offsets[:-1][full], len(batch)
            sketch, digest = np.zeros((n, SKETCH), np.uint64), np.zeros(n, np.uint64)
            if len(full):
                digest[full] = np.add.reduceat(_digest_a(values), at)
                place = mix(values ^ np.uint64(0x3C3C))
                bit = np.uint64(1) << (place & np.uint64(63))
                for k in range(SKETCH):
                    sketch[full, k] = np.bitwise_xor.reduceat(np.where(place >> np.uint64(6) & np.uint64(SKETCH - 1) == k, bit, np.uint64(0)), at)
            lists = pa.ListArray.from_arrays(np.arange(0, n * SKETCH + 1, SKETCH, dtype=np.int32), as_signed(sketch.ravel()))
            yield pa.record_batch([batch.column("id"), as_signed(digest), lists], names=["id", "set_a", "sketch"])

    return run


def _digest_a(values: np.ndarray) -> np.ndarray:
    return mix(values ^ np.uint64(0xA5A5))


def _similar(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _keys(known: np.ndarray | None = None):
    """The key of every table; the table's number is in the key's last six bits. `known`: (node, n, key) of those that this filter lets pass."""

    def run(batches):
        for batch in batches:
            h = batch.column("signature").flatten().to_numpy().view(np.uint64).reshape(-1, HASHES)
            pairs = mix(h[:, 0 : 2 * PAIRS : 2] + mix(h[:, 1 : 2 * PAIRS : 2]))
            key = mix(pairs[:, :, None] ^ (h[:, None, 2 * PAIRS :] * np.uint64(0x9E3779B97F4A7C15)))
            table = np.arange(PAIRS * SINGLES, dtype=np.uint64).reshape(1, PAIRS, SINGLES)
            key = ((key & ~np.uint64(63)) | table).reshape(-1).view(np.int64)
            if known is None:
                yield pa.record_batch([pa.array(key)], names=["key"])
                continue
            keep = passes(known, key)
            node, n = (np.repeat(batch.column(c).to_numpy(), PAIRS * SINGLES)[keep] for c in ("node", "n"))
            yield pa.record_batch([pa.array(node), pa.array(n), pa.array(key[keep])], names=["node", "n", "key"])

    return run


def _agreement(a: str, b: str) -> str:
    return f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), x -> x))"


def _meeting(met: DataFrame, percent: int) -> DataFrame:
    """(u, v): classes of one bucket whose numbers of shingles allow a link; in a bucket of up to SMALL classes all pairs, in a larger one those with a pivot."""
    near = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    met = met.select("key", "held", F.struct("node", "n").alias("x"))
    small, large = met.where(F.col("held") <= SMALL), met.where(F.col("held") > SMALL)
    first = [F.struct(*[F.min_by(c, F.xxhash64(F.lit(k), "x.node")).alias(c[2:]) for c in ("x.node", "x.n")]) for k in range(PIVOTS)]
    pivots = large.groupBy("key").agg(F.array(*first).alias("pivots"))
    pairs = large.join(pivots, "key").select(F.expr(f"inline(transform(filter(pivots, y -> x.node <> y.node AND {near}), y -> struct(x.node, y.node)))").alias("u", "v"))
    every = F.expr(f"inline(flatten(transform(xs, (x, i) -> transform(filter(slice(xs, 1, i), y -> {near}), y -> struct(x.node, y.node)))))")
    return pairs.unionByName(small.groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("xs")).select(every.alias("u", "v"))).distinct()


def _sharing(placed: DataFrame, elements: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(u, v, bits): pairs of classes of different components that share a shingle early enough for a link, and in how many bits their sketches differ.

    Shingles are put in one order: those that one component alone holds, then the others, the rarest first. `left` is how many of a class's
    shingles come from one on, itself included. Two classes share at most as many as the lesser `left` of the first shingle that they share, so
    a link's is large on both sides. Nor do they differ in fewer shingles than their sketches do in bits.
    For each shingle, all its classes meet only those outside the component that most of them are in.
    """
    elements = elements.join(placed, "set_a")
    times = elements.groupBy("element").agg(F.count("*").alias("times"), F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").drop("a", "b")
    rarest_last = Window.partitionBy("node").orderBy(F.desc("times"), F.desc("element"))
    ranked = elements.join(times, "element").withColumn("left", F.dense_rank().over(rarest_last))
    early = ranked.where(f"100 * left >= {percent} * n").select("set_a", "node", "component", "element", "n", "left")
    early = written(early.join(sketches, ["node", "set_a"]).drop("set_a"), "early")
    held = early.groupBy("element", "component").agg(F.count("*").alias("held"))
    held = held.groupBy("element").agg(F.max_by("component", F.struct("held", "component")).alias("most"), F.count("*").alias("components")).where("components > 1")
    early = early.join(held.drop("components"), "element")
    x, y = early.alias("x"), early.where("component <> most").alias("y")
    bits = "aggregate(zip_with(x.sketch, y.sketch, (a, b) -> bit_count(a ^ b)), 0, (s, b) -> s + b)"
    meet = F.expr(
        f"x.element = y.element AND (x.component = x.most OR x.component < y.component) AND x.component <> y.component"
        f" AND {100 + percent} * least(x.left, y.left) >= {percent} * (x.n + y.n)"
        f" AND {100 + percent} * (x.n + y.n - {bits}) >= {2 * percent} * (x.n + y.n)"
    )
    return x.join(y, meet).select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v"), F.expr(bits).alias("bits")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents linked by 100 * |A & B| >= percent * |A | B| on shingle sets.

    A-Z are lower-cased and words split at ASCII white space. A text with fewer words than a shingle has its whole sequence as one.
    Equal sets are one class with one row in all joins. Links between classes are found in three steps, each on what is not yet in
    one component: a class is verified against the one most like it among a few pivots of its buckets (in a bucket of up to SMALL classes,
    all of them); then against its other pivots; then, of the classes in larger buckets that still hold several components, pairs of
    different components that share one of their rarest
    shingles are verified, each class's nearest first and then those still apart: a class of n shingles lacks at most n - percent * n / 100
    of a linked one's, so two linked classes share one of the first that many and one. Pairs inside one component change nothing and are
    never verified. Classes whose numbers of shingles rule out a link are no pair. Verification is on full sets.

    component_id is the least doc_id reachable, itself included; kept is doc_id = component_id. One row for each input row. A null
    or empty text has n_shingles 0 and is linked with nothing. Rows that repeat a doc_id are one node of the links. A row without
    doc_id is linked with nothing: component_id is null, kept true. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = written(docs.mapInArrow(_features(words_per_shingle), "id long, n_shingles long, set_a long, set_b long, signature array<long>"), "features")
    classes = rows.where("n_shingles > 0 AND id IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = written(classes, "classes")
    sized = classes.select("node", "n", "signature")
    shared = written(sized.mapInArrow(_keys(), "key long").groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "shared")
    keys = sized.mapInArrow(_keys(bit_filter(shared, "key", KEY_FILTER_BITS)), "node long, n long, key long")
    met = written(keys.join(shared, "key"), "buckets")

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
        sets = docs.mapInArrow(_members(words_per_shingle, bit_filter(ids, "id")), "id long, members binary")
        sets = sets.join(ids, "id", "left_semi").distinct()
        return pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(_similar(percent), "u long, v long")

    def apart(pairs: DataFrame, group: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        ends = pairs.join(group.toDF("u", "cu"), "u", "left").join(group.toDF("v", "cv"), "v", "left")
        return ends.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).drop("cu", "cv")

    about = classes.select("node", "signature")
    pairs = _meeting(met, percent).join(about.toDF("u", "su"), "u").join(about.toDF("v", "sv"), "v").withColumn("same", F.expr(_agreement("su", "sv")))
    pairs = written(pairs.where(f"same >= {LEAST_AGREEMENT}").select("u", "v", "same"), "pairs")
    closest = written(pairs.groupBy("u").agg(F.max_by("v", F.struct("same", "v")).alias("v")), "closest")
    links = written(verified(closest), "links")
    group = components(links)
    others = written(apart(pairs.select("u", "v"), group), "others")
    if not others.isEmpty():
        links = links.unionByName(written(verified(others), "links"))
        group = components(links)

    placed = met.where(F.col("held") > SMALL).join(group, "node", "left").select("node", "key", F.coalesce("component", "node").alias("component"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    placed = placed.join(open_keys, "key", "left_semi").select("node", "component").distinct().join(classes.select("node", "set_a", "n"), "node")
    placed = written(placed, "placed")
    if not placed.isEmpty():  # else no larger bucket holds several components, and every pair is known
        # A shingle that only one of these classes has can't be shared: a class with too many of them has no link to find.
        ids = placed.select(F.col("node").alias("id")).distinct()
        elements = docs.mapInArrow(_elements(words_per_shingle, bit_filter(ids, "id")), "id long, set_a long, element long")
        elements = written(elements.join(ids, "id", "left_semi").select("set_a", "element"), "elements")
        alone = elements.groupBy("element").agg(F.count("*").alias("times"), F.min("set_a").alias("set_a")).where("times = 1").groupBy("set_a").agg(F.count("*").alias("own"))
        placed = placed.join(alone, "set_a", "left").where(f"100 * (n - coalesce(own, 0)) >= {percent} * n").drop("own")
        placed = written(placed, "open")
        ids = placed.select(F.col("node").alias("id")).distinct()
        sketches = docs.mapInArrow(_sketches(words_per_shingle, bit_filter(ids, "id")), "id long, set_a long, sketch array<long>")
        rest = _sharing(placed, elements, sketches.withColumnRenamed("id", "node").dropDuplicates(["node", "set_a"]), percent)
        known = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rest = written(rest.join(known, ["u", "v"], "left_anti"), "rest")
        if not rest.isEmpty():  # most of a large group's pairs are inside one component as soon as each class is linked with its nearest
            ways = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v"), "bits"))
            nearest = ways.groupBy("u").agg(F.min_by("v", F.struct("bits", "v")).alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
            nearest = written(nearest, "nearest")
            links = links.unionByName(written(verified(nearest), "links"))
            group = components(links)
            last = written(apart(rest.select("u", "v").join(nearest, ["u", "v"], "left_anti"), group), "last")
            if not last.isEmpty():
                group = components(links.unionByName(verified(last)))

    of_class = classes.select("set_a", "set_b", "node").join(group, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    linked = F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component", "id")).otherwise(F.col("id"))
    out = rows.drop("signature").join(of_class, ["set_a", "set_b"], "left").select(F.col("id").alias("doc_id"), "n_shingles", linked.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
