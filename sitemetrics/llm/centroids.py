"""Exact integer clustering over subvector dictionaries.

A chunk of vectors is encoded once, as a columnar file encodes a row group: the dimensions are cut into blocks of `BLOCK`, each block
has a dictionary of its distinct subvectors, and a vector becomes one code for each block. Nothing is lost. In a round a chunk computes
the distances of each distinct subvector to the centroids' parts once and sums them by code, so that no vector is ever decoded. The new
centroids come from counts of (cluster, code). Only centroids travel to the tasks and only their sums come back.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.llm.vectors import matrix, vectors
from sitemetrics.operators.reuse import written

#: Dimensions of a block, and vectors of a chunk (the last of a task has fewer).
BLOCK, CHUNK_ROWS = 2, 8192
#: Integers are held within this magnitude, so that sums of squares fit 38 digits.
MOST = 2**58
#: Up to this magnitude distances are computed in 64 bits, beyond it with unlimited integers.
NARROW = 2**27
ENCODED = "ids array<long>, values array<binary>, codes array<binary>"


def _floors(column: pa.Array, factor: int) -> np.ndarray:
    return np.clip(np.floor(factor * matrix(column)), -MOST, MOST).astype(np.int64)


def encode(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, the row's number for each row) of an integer matrix."""
    code = np.zeros(len(block), np.int64)
    for k in range(block.shape[1]):
        values, own = np.unique(block[:, k], return_inverse=True)
        code = np.unique(code * len(values) + own, return_inverse=True)[1]
    first = np.unique(code, return_index=True)[1]
    return block[first], code


def _encoded(factor: int):
    def chunk(ids: list, parts: list) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        blocks = [encode(rows[:, a : a + BLOCK]) for a in range(0, rows.shape[1], BLOCK)]
        lists = [[v.astype("<i8").tobytes() for v, _ in blocks], [c.astype("<u2").tobytes() for _, c in blocks]]
        return pa.record_batch([pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.list_(pa.binary())) for x in lists)], names=["ids", "values", "codes"])

    def run(batches):
        ids, parts = [], []
        for batch in batches:
            for a in range(0, len(batch), CHUNK_ROWS):
                some = batch.slice(a, CHUNK_ROWS)
                if len(ids) + len(some) > CHUNK_ROWS:
                    yield chunk(ids, parts)
                    ids, parts = [], []
                ids = ids + some.column("id").to_pylist()
                parts.append(_floors(some.column("vector"), factor))
        if ids:
            yield chunk(ids, parts)

    return run


def _chunks(batches):
    for batch in batches:
        for ids, values, codes in zip(*(batch.column(c) for c in ("ids", "values", "codes")), strict=True):
            yield ids.values, [(np.frombuffer(v.as_buffer(), "<i8"), np.frombuffer(c.as_buffer(), "<u2")) for v, c in zip(values.values, codes.values, strict=True)]


def assign(blocks: list, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """(nearest centroid, squared distance) of each vector, ties to the smaller number; the blocks' dictionaries as matrices."""
    wide = np.abs(centroids).max() > NARROW or any(len(v) and np.abs(v).max() > NARROW for v, _ in blocks)
    kind, at, total, dictionaries = (object if wide else np.int64), 0, 0, []
    for values, codes in blocks:
        width = min(BLOCK, centroids.shape[1] - at)
        values = values.reshape(-1, width).astype(kind)
        apart = values[:, None, :] - centroids[None, :, at : at + width].astype(kind)
        total = total + (apart * apart).sum(axis=2)[codes]
        dictionaries.append(values)
        at += width
    nearest = np.argmin(total, axis=1)
    return nearest, total[np.arange(len(nearest)), nearest], dictionaries


def _sums(centroids: np.ndarray):
    """(cluster, dim, n, total) of what this task's vectors add to each cluster."""

    def run(batches):
        k, dims = centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for _, blocks in _chunks(batches):
            nearest, _, dictionaries = assign(blocks, centroids)
            count += np.bincount(nearest, minlength=k)
            parts = []
            for (_, codes), values in zip(blocks, dictionaries, strict=True):
                met = np.bincount(nearest * len(values) + codes, minlength=k * len(values)).reshape(k, -1)
                parts.append(met.astype(object) @ values.astype(object) if values.dtype == object else met @ values)
            total = total + np.hstack(parts).astype(object)
        cluster, dim = np.divmod(np.arange(k * dims), dims)
        columns = [pa.array(cluster), pa.array(dim), pa.array(count[cluster]), pa.array([Decimal(int(x)) for x in total.ravel()], pa.decimal128(38, 0))]
        yield pa.record_batch(columns, names=["cluster", "dim", "n", "total"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for ids, blocks in _chunks(batches):
            nearest, distance, _ = assign(blocks, centroids)
            exact = pa.array([Decimal(int(x)) for x in distance], pa.decimal128(38, 0))
            yield pa.record_batch([ids, pa.array(nearest.astype(np.int32)), exact], names=["vec_id", "cluster", "distance"])

    return run


def _unassigned(batches):
    for ids, _ in _chunks(batches):
        yield pa.record_batch([ids, pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.decimal128(38, 0))], names=["vec_id", "cluster", "distance"])


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, clusters: int = 16, rounds: int = 3, factor: int = 64, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each row whose vector has `dims` finite components.

    Components become floor(factor * x). The first centroids are the rows with the least sha256 of `seed:id`; a round assigns every
    vector to the nearest centroid (squared distance, ties to the smaller number) and moves each centroid that has vectors to their
    componentwise floor(sum / count). All of it is exact, so the result does not depend on partitions or retries.

    Vectors that are null, of another length or hold null or non-finite components are left out. A row without id is clustered but
    starts no centroid; rows that repeat an id each count, ordered by vector where the hash ties; fewer rows than clusters give fewer
    clusters, and rows without any id have null in the other columns. Integers beyond 2**58 are held there; distances and sums that no
    longer fit 64 bits are null. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    rows = vectors(df, id_col, vector_col).where(F.size("vector") == dims)
    first = rows.where("id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "vector").limit(clusters)
    centroids = np.array([np.clip(np.floor(factor * np.array(r["vector"])), -MOST, MOST).astype(np.int64) for r in first.collect()]).reshape(-1, dims)
    encoded = written(rows.mapInArrow(_encoded(factor), ENCODED), "encoded")
    out = "vec_id long, cluster int, distance decimal(38,0)"
    if not len(centroids):
        found = encoded.mapInArrow(_unassigned, out)
    else:
        for _ in range(rounds):
            sums = encoded.mapInArrow(_sums(centroids), "cluster long, dim long, n long, total decimal(38,0)")
            moved = centroids.copy()
            for r in sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0").collect():
                moved[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
            centroids = moved
        found = encoded.mapInArrow(_assigned(centroids), out)
    found = written(found, "assigned")
    total = F.expr("try_sum(distance)").alias("sum")
    by_cluster = {r["cluster"]: r["sum"] for r in found.groupBy("cluster").agg(total).collect()}
    everything = found.agg(total).first()["sum"]
    names = [digest(c) for c in centroids]
    per_cluster = spark.createDataFrame([(c, by_cluster.get(c), n) for c, n in enumerate(names)], "cluster int, cluster_sum decimal(38,0), centroid_sha256 string")
    long_or_null = lambda c: F.col(c).try_cast("long")
    return found.join(F.broadcast(per_cluster), "cluster", "left").select(
        "vec_id", "cluster", long_or_null("distance").alias("distance"), long_or_null("cluster_sum").alias("cluster_inertia"),
        F.lit(everything).cast("decimal(38,0)").try_cast("long").alias("inertia"), "centroid_sha256",
    )
