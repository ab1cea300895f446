"""Embedding whitening with a covariance from bit-sliced scatter sums.

Of a batch of rows every dimension is shifted to start at 0 and cut into bit planes; each plane is packed along the rows into 64-bit
words. The sum of y_i * y_j over the rows is the sum over pairs of planes (a, b) of 2**(a + b) times the number of rows that have both
bits: AND and popcount on whole words. The shift is taken out again in integers, so all sums are exact and the covariance is centred
before anything is rounded.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemetrics.llm.vectors import matrix, vectors
from sitemetrics.operators.reuse import written

#: x = floor(SCALE * c) + OFFSET, held within MOST.
SCALE, OFFSET, MOST = 1024, 100_000, 2**50
#: Rows whose planes are packed at once: their words stay in the processor's cache.
SLICE_ROWS = 4096
#: A direction with less than this share of the variance is no component: it can't be scaled to 1.
LEAST_SHARE = 1e-12


def integers(column: pa.Array) -> np.ndarray:
    return np.clip(np.floor(SCALE * matrix(column)) + OFFSET, -MOST, MOST).astype(np.int64)


def planes(y: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of a non-negative matrix, (dimension, bit, word): rows are packed 64 to a word."""
    rows, dims = y.shape
    flags = np.zeros((dims, bits, -(-rows // 64) * 64), bool)
    for b in range(bits):
        flags[:, b, :rows] = ((y >> b) & 1).T
    return np.packbits(flags, axis=2).view(np.uint64)


def products(y: np.ndarray) -> np.ndarray:
    """The sums over all rows of y_i * y_j, as unlimited integers."""
    dims, bits = y.shape[1], max(1, int(y.max()).bit_length())
    packed = planes(y, bits).reshape(dims * bits, -1)
    both = np.zeros((len(packed), len(packed)), np.int64)
    for p in range(len(packed)):
        both[p, p:] = np.bitwise_count(packed[p] & packed[p:]).sum(axis=1, dtype=np.int64)
    both = (both + np.triu(both, 1).T).reshape(dims, bits, dims, bits)
    narrow = 2 * bits + len(y).bit_length() < 62
    total = np.zeros((dims, dims), np.int64 if narrow else object)
    for a in range(bits):
        for b in range(bits):
            part = both[:, a, :, b]
            total = total + ((part << (a + b)) if narrow else part.astype(object) * (1 << (a + b)))
    return total.astype(object)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of x_i and of x_i * x_j over the rows of an integer matrix."""
    shift = x.min(axis=0)
    y = x - shift
    sums, shift = y.astype(object).sum(axis=0), shift.astype(object)
    crossed = products(y) + np.outer(shift, sums) + np.outer(sums, shift) + len(x) * np.outer(shift, shift)
    return sums + len(x) * shift, crossed


def _scatter(batches):
    """(i, j, total) with i <= j for cross-products and (i, -1, total) for sums, over all rows of the task."""
    sums, crossed = 0, 0
    for batch in batches:
        for a in range(0, len(batch), SLICE_ROWS):
            s, c = scatter(integers(batch.column("vector").slice(a, SLICE_ROWS)))
            sums, crossed = sums + s, crossed + c
    if isinstance(sums, np.ndarray):
        i, j = np.triu_indices(len(sums))
        i, j = np.append(i, np.arange(len(sums))), np.append(j, np.full(len(sums), -1))
        total = [*crossed[np.triu_indices(len(sums))], *sums]
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["i", "j", "total"])


def covariance(n: int, sums: list[int], crossed: list[list[int]]) -> np.ndarray:
    """n * (sum of products) - (product of sums) in integers, divided by n * n at the end."""
    return np.array([[(n * c - a * b) / (n * n) for c, b in zip(row, sums, strict=True)] for row, a in zip(crossed, sums, strict=True)])


def _whitened(n: int, sums: np.ndarray, scaled: np.ndarray):
    def run(batches):
        for batch in batches:
            x = integers(batch.column("vector"))
            exact = x.astype(object) * n - sums if (np.abs(x).max(initial=0) + OFFSET) * n >= 2**62 else x * n - sums.astype(np.int64)
            small = not len(x) or exact.dtype != object and float(np.abs(exact).max()) ** 2 * x.shape[1] < 2**62
            squares = (exact * exact if small else exact.astype(object) ** 2).sum(axis=1)
            deviation = pa.array([int(s) if s < 2**63 else None for s in squares], pa.int64())
            projected = (exact / n).astype(np.float64) @ scaled
            lists = pa.ListArray.from_arrays(np.arange(0, projected.size + 1, scaled.shape[1], dtype=np.int32), pa.array(projected.ravel()))
            yield pa.record_batch([batch.column("id"), deviation, lists], names=["vec_id", "deviation", "z"])

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component up to `most`.

    A component is turned into floor(1024 * c) + 100000; the covariance of these is exact up to its last division. Components are its
    unit eigenvectors by falling eigenvalue, each with its largest entry positive. A task sends back one number for each pair of
    dimensions, so the driver holds dims * (dims + 1) / 2 exact sums whatever the rows.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped, and rows whose vectors are not of the most frequent
    length (ties: the shorter), since they have no covariance with the others. Repeated rows each count and a row without id is kept.
    Components with a share of the variance under 1e-12 are left out: equal vectors alone give no rows, nor does an empty table.
    Values beyond 2**50 are held there, and a deviation that does not fit 64 bits is null. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = vectors(df, id_col, vector_col)
    widths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    empty = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not widths:
        return empty
    dims, n = widths[0]["width"], widths[0]["count"]
    rows = rows.where(F.size("vector") == dims)
    totals = rows.mapInArrow(_scatter, "i long, j long, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total"))
    sums, crossed = [0] * dims, [[0] * dims for _ in range(dims)]
    for r in totals.collect():
        if r["j"] < 0:
            sums[r["i"]] = int(r["total"])
        else:
            crossed[r["i"]][r["j"]] = crossed[r["j"]][r["i"]] = int(r["total"])
    values, directions = np.linalg.eigh(covariance(n, sums, crossed))
    values, directions = values[::-1], directions[:, ::-1]
    trace = float(values.sum())
    count = min(most, int(np.count_nonzero(values > LEAST_SHARE * trace))) if trace > 0 else 0
    if not count:
        return empty
    directions = directions[:, :count] * np.sign(directions[np.abs(directions[:, :count]).argmax(axis=0), np.arange(count)])
    scaled = directions / np.sqrt(values[:count])
    z = written(rows.mapInArrow(_whitened(n, np.array(sums, object), scaled), "vec_id long, deviation long, z array<double>"), "whitened")
    means = z.agg(*[F.avg(F.col("z")[k]).alias(f"m{k}") for k in range(count)]).first()
    centred = [F.col("z")[k] - F.lit(means[k]) for k in range(count)]
    pairs = [(a, b) for a in range(count) for b in range(a, count)]
    found = z.agg(*[F.avg(centred[a] * centred[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    error = max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs, strict=True))
    shares = F.array(*[F.lit(float(v / trace)) for v in values[:count]])
    long = z.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
