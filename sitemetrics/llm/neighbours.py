"""Nearest vectors by inner product with collision-counting hashing.

Rows and queries are laid on the unit sphere: a row is divided by the greatest norm of its band and gets one more coordinate that
fills it up to length 1; a query is divided by its own norm and gets 0. The distance d there falls as the inner product rises:
d * d = 2 - 2 * product / (norm of the query * greatest norm). `PROJECTIONS` random directions give every row as many numbers, each
kept as one sorted array. Around a query's own number on each array a window opens with half-width R; a row inside it collides. Two
points at a distance d collide with probability P(|N(0, 1)| <= R / d), so rows within R reach `least_collisions` collisions but for one
in `MISSED`. Radii grow from one virtual rehashing to the next (`RADII`), up to the distance at which the verified rows would be
enough, and no array is ever built again. All rows that reach the threshold are verified by their distance; a query is done as soon as
enough verified rows lie within R.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitemetrics.llm.vectors import matrix, vectors
from sitemetrics.operators.reuse import written

PROJECTIONS = 128
#: Share of the rows within R that may stay under the threshold of collisions.
MISSED = 0.2
#: On the unit sphere no distance is above 2, so the last radius verifies every row.
RADII = np.append(0.1 * 1.06 ** np.arange(51), 2.0).astype(np.float32)
#: Rows of a shard (positions fit 16 bits) and queries of a block: what one task holds at a time.
SHARD_ROWS, BLOCK_ROWS = 8192, 2048
#: A norm band ends at this share of its greatest norm.
BAND = 0.8
#: Rows of a band on which a query's first radius is looked up, and queries counted at once.
PROBE_ROWS, TILE = 512, 32
#: The first radius should verify this many times the rows wanted: the distances of more rows set the next radius better.
AHEAD = 16


def least_collisions() -> int:
    """Collisions that a row within R reaches with probability 1 - MISSED."""
    near = 2 * NormalDist().cdf(1) - 1
    return math.floor(PROJECTIONS * near + NormalDist().inv_cdf(MISSED) * math.sqrt(PROJECTIONS * near * (1 - near)))


class Band:
    """Rows of similar norms: unit vectors, sorted arrays of their projections, and each row's position on every array."""

    def __init__(self, rows: np.ndarray, norms: np.ndarray):
        self.norm = norms.max()
        scaled = rows / self.norm
        filled = np.sqrt(np.clip(1 - (scaled * scaled).sum(axis=1), 0, None))
        self.unit = np.hstack([scaled, filled[:, None]]).astype(np.float32)
        self.directions = np.random.default_rng(rows.shape[1]).standard_normal((rows.shape[1] + 1, PROJECTIONS)).astype(np.float32)
        projected = np.ascontiguousarray((self.unit @ self.directions).T)
        order = np.argsort(projected, axis=1, kind="stable")
        self.arrays = np.take_along_axis(projected, order, axis=1)
        self.position = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.position, order, np.arange(len(rows), dtype=np.uint16)[None, :], axis=1)
        self.least = least_collisions()

    def collisions(self, at: np.ndarray, radius: np.ndarray, rows: slice) -> np.ndarray:
        """Number of collisions of every query (its numbers: a row of `at`) with every row, each query at its own radius."""
        position = self.position[:, rows]
        count = np.zeros((len(at), position.shape[1]), np.uint8)
        offset, inside = np.empty(count.shape, np.uint16), np.empty(count.shape, bool)
        for k, array in enumerate(self.arrays):
            low = np.searchsorted(array, at[:, k] - radius, "left")
            width = np.searchsorted(array, at[:, k] + radius, "right") - low
            np.subtract(position[k], low.astype(np.uint16)[:, None], out=offset)  # wraps below the window
            np.less(offset, width[:, None].astype(np.uint16) if len(array) < 65536 else width[:, None], out=inside)
            np.add(count, inside.view(np.uint8), out=count)
        return count

    def search(self, queries: np.ndarray, enough: int):
        """(query's number, rows verified, their cosines on the sphere) for every query of a unit matrix."""
        last, n = len(RADII) - 1, self.position.shape[1]
        enough = min(enough, n)
        at = queries @ self.directions
        for a in range(0, len(queries), TILE):
            tile = np.arange(a, min(a + TILE, len(queries)))
            step = self.first_step(at[tile], enough) if n > 2 * PROBE_ROWS else np.zeros(len(tile), np.int64)
            while len(tile):
                count = self.collisions(at[tile], RADII[step], slice(None))
                open_ = np.zeros(len(tile), bool)
                for i, q in enumerate(tile):
                    rows = np.arange(n) if step[i] == last else np.flatnonzero(count[i] >= self.least)
                    cosine = self.unit[rows] @ queries[q]
                    if step[i] < last and np.count_nonzero(cosine >= 1 - RADII[step[i]] ** 2 / 2) < enough:
                        # At the distance of the last row wanted these rows, whose windows only grow, are enough.
                        wanted = math.sqrt(max(0.0, 2 - 2 * float(np.partition(cosine, -enough)[-enough]))) if len(rows) >= enough else 0.0
                        step[i], open_[i] = max(step[i] + 1, min(last, np.searchsorted(RADII, wanted))), True
                    else:
                        yield q, rows, cosine
                tile, step = tile[open_], step[open_]

    def first_step(self, at: np.ndarray, enough: int) -> np.ndarray:
        """The first radius at which `AHEAD` times enough rows should reach the threshold, by the share of the first `PROBE_ROWS` rows that do."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(RADII) - 1)
        n = self.position.shape[1]
        while (low < high).any():
            middle = (low + high) // 2
            found = (self.collisions(at, RADII[middle], slice(0, PROBE_ROWS)) >= self.least).sum(axis=1) * n >= AHEAD * enough * PROBE_ROWS
            low, high = np.where(found, low, np.minimum(middle + 1, high)), np.where(found, middle, high)
        return low


def search_shard(rows: np.ndarray, queries: np.ndarray, keep: int, enough: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the numbers and inner products (in double precision) of at least the `keep` best rows that were verified."""
    norms = np.sqrt((rows * rows).sum(axis=1))
    lengths = np.sqrt((queries * queries).sum(axis=1))
    units = np.hstack([queries / lengths[:, None], np.zeros((len(queries), 1))]).astype(np.float32)
    order = np.argsort(-norms, kind="stable")
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
    bound = np.full(len(queries), -np.inf)
    a = 0
    while a < len(order):
        b = a + np.searchsorted(-norms[order[a:]], -norms[order[a]] * BAND, "right")
        some = order[a:b]
        open_ = np.flatnonzero(lengths * norms[some[0]] >= bound)  # no product is above the product of the norms
        band = Band(rows[some], norms[some]) if len(open_) else None
        for q, found, cosine in band.search(units[open_], enough) if band else ():
            q = open_[q]
            if len(found) > keep:
                found = found[cosine >= np.partition(cosine, len(cosine) - keep)[-keep] - 1e-4]
            numbers = np.concatenate([best[q][0], some[found]])
            products = np.concatenate([best[q][1], (rows[some[found]] * queries[q]).sum(axis=1)])
            if len(numbers) > keep:
                bound[q] = np.partition(products, len(products) - keep)[-keep]
                numbers, products = numbers[products >= bound[q]], products[products >= bound[q]]
            best[q] = (numbers, products)
        a = b
    return best


def _search(keep: int, shards: int):
    share = keep / shards
    enough = min(keep, math.ceil(share + 3 * math.sqrt(share)) + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "score": [], "found": []}
        if len(left) and len(right):
            ids = left.column("ids").to_pylist()
            names = right.column("query").to_numpy()
            for name, (numbers, products) in zip(names, search_shard(matrix(left.column("vector")), matrix(right.column("vector")), keep, enough), strict=True):
                pairs = sorted((-p, i) for n, p in zip(numbers.tolist(), products.tolist(), strict=True) for i in ids[n])[:keep]
                out["query"] += [name] * len(pairs)
                out["score"] += [-p for p, _ in pairs]
                out["found"] += [i for _, i in pairs]
        return pa.table({"query": pa.array(out["query"], pa.int64()), "score": pa.array(out["score"], pa.float64()), "found": pa.array(out["found"], pa.int64())})

    return run


def nearest(df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets `queries` its k nearest other rows by inner product, ties to smaller ids.

    `queries` is a condition on a bigint column `id`. Equal vectors are one row of the index with their k + 1 least ids, which are all
    that any query can need, and one query. Rows are dealt by hash over shards of some `SHARD_ROWS`, queries over blocks of
    `BLOCK_ROWS`; a task searches one shard for one block, and the best of all shards are merged by a limited window. A shard's search
    ends when it has its expected share of the k nearest, and three standard deviations more, within the radius.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take no part. Rows that repeat id
    and vector count once. An id with several vectors is a query, and a candidate for others, with each of them. Vectors are compared
    with those of the same length. Fewer than k candidates are all returned. An empty table gives no rows; other columns are ignored.
    Approximate: `MISSED` bounds the expected share of lost neighbours; scores are exact.
    """
    spark = df.sparkSession
    rows = vectors(df, id_col, vector_col).where("id IS NOT NULL").where(F.exists("vector", lambda x: x != 0)).distinct()
    rows = written(rows, "vectors")
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    index = written(least.groupBy("vector").agg(F.collect_list("id").alias("ids")), "index")
    asked = rows.where(queries)
    names = written(asked.select("vector").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
    shards, blocks = (max(1, math.ceil(t.count() / size)) for t, size in ((index, SHARD_ROWS), (names, BLOCK_ROWS)))

    def dealt(table: DataFrame, own: str, n: int, other: str, times: int) -> DataFrame:
        return table.withColumn("width", F.size("vector")).withColumn(own, F.pmod(F.xxhash64("vector"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))

    left, right = dealt(index, "shard", shards, "block", blocks), dealt(names, "block", blocks, "shard", shards)
    keys = ["width", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k + 1, shards), "query long, score double, found long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    top = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    answers = top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "found", "score"))).alias("answers"))
    own = asked.join(names, "vector").select("id", "query").join(answers, "query")
    others = F.slice(F.filter("answers", lambda a: a["found"] != F.col("id")), 1, k)
    out = own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "a"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("a.found").alias("vec_id"), F.col("a.score").alias("score"))
