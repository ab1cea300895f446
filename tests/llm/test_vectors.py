"""The vector operators against brute force, on odd rows and on empty tables."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitemetrics.llm import centroids, neighbours, whitening
from sitemetrics.llm.queries import QUERIES
from tests.conftest import SMALL

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"
CLASHING = ["id", "vector", "ids", "query", "score", "found", "shard", "block", "width", "n", "cluster", "distance", "component", "z", "i", "j", "total"]


def table(spark, rows):
    """The rows with extra columns that are named like ones inside the operators."""
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})


def normal(seed: int, n: int, dims: int, norm: float = 0.0) -> list[list[float]]:
    pick = np.random.default_rng(seed)
    x = pick.normal(size=(n, dims)).astype(np.float32)
    return (x * np.exp(pick.normal(scale=norm, size=(n, 1)))).astype(np.float32).tolist()


def odd(dims: int) -> list[tuple]:
    """Nulls, empty, short, zero and non-finite vectors, a missing id, repeated rows, copies of one vector, ties."""
    a, b, *rest = normal(3, 40, dims)
    holes = [None, [], [None] * dims, [NAN] + a[1:], [INF] + a[1:], [-INF] + a[1:], a[:-1] + [None], [0.0] * dims]
    rows = [(1000 + k, v) for k, v in enumerate(holes)] + [(None, a), (7, a[:-1]), (-40, b[:-1]), (20, a), (20, a), (20, b), (60, b)]
    return rows + [(k, v) for k, v in enumerate(rest, 100)] + [(k, a) for k in range(200, 260)]


# -- nearest neighbours ---------------------------------------------------------------------------------------------------------------


def brute_nearest(rows, step, k):
    use = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = set()
    for q, v in use:
        if q % step == 0:
            scored = {(-math.fsum(x * y for x, y in zip(v, w, strict=True)), i) for i, w in use if i != q and len(w) == len(v)}
            out |= {(q, rank, i, round(-s, 9)) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def rounded(df):
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect()}


def test_nearest_on_odd_rows(spark):
    """Few rows: the windows open until all are verified, so the result is exact, copies, ties and negative ids included."""
    rows = odd(6)
    got = neighbours.nearest(table(spark, rows), F.col("id") % 20 == 0, k=20)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert rounded(got) == brute_nearest(rows, 20, 20)
    assert neighbours.nearest(table(spark, []), F.col("id") % 20 == 0).count() == 0
    assert neighbours.nearest(table(spark, [(20, [1.0, 2.0])]), F.col("id") % 20 == 0).count() == 0


def test_hot_vector_keeps_the_least_ids(spark):
    rows = [(k, [0.5, 0.75]) for k in range(400)] + [(1000 + k, v) for k, v in enumerate(normal(9, 50, 2))]
    assert rounded(neighbours.nearest(table(spark, rows), F.col("id") % 20 == 0, k=20)) == brute_nearest(rows, 20, 20)


@pytest.mark.parametrize("norm", [0.0, 0.7])
def test_recall_of_the_kernel(norm):
    """Shards of thousands of rows, equal and very unequal norms: rows outside the windows are left out, few neighbours are lost."""
    rows, queries = np.array(normal(1, 6000, 32, norm), float), np.array(normal(2, 40, 32), float)
    rows[:3000] += 2 * queries[np.arange(3000) % 40]
    kept = neighbours.search_shard(rows, queries, 21, 21)
    lost = 0
    for (numbers, products), q in zip(kept, queries, strict=True):
        want = np.argsort(-(rows @ q))[:21]
        assert np.allclose(products, rows[numbers] @ q)
        lost += len(set(want.tolist()) - set(numbers.tolist()))
    assert lost <= 0.1 * 21 * 40


def test_windows_count_collisions():
    """Counts by positions on the sorted arrays against plain differences of the projections."""
    rows = np.array(normal(5, 300, 8), float)
    band = neighbours.Band(rows, np.sqrt((rows * rows).sum(axis=1)))
    at = band.unit[:5] @ band.directions
    radius = np.array([0.05, 0.3, 0.7, 1.2, 2.0], np.float32)
    plain = (np.abs((band.unit @ band.directions)[None] - at[:, None]) <= radius[:, None, None]).sum(axis=2)
    got = band.collisions(at, radius, slice(None))
    assert np.abs(got.astype(int) - plain).max() <= 1 and (got == plain).mean() > 0.999  # one bit of single precision at a border


def test_recall_of_the_query(spark):
    got = defaultdict(set)
    for r in QUERIES["op11_collision_neighbours"](spark, SMALL).collect():
        got[r["query_id"]].add(r["vec_id"])
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want = defaultdict(set)
    for q, _, i, _ in brute_nearest(rows, 20, 20):
        want[q].add(i)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * sum(map(len, want.values()))


# -- centroid clustering --------------------------------------------------------------------------------------------------------------


def brute_clusters(rows, dims, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def best(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[best(v)[1]].append(v)
        centres = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centres)]
    found = [(i, *best(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in found:
        inertia[n] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    least = lambda x: x if x < 2**63 else None
    return Counter((i, n, least(d), least(inertia[n]), least(sum(inertia.values())), names[n]) for i, d, n in found)


def clustered(df):
    return Counter(tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect())


@pytest.mark.parametrize("dims", [5, 64])
def test_clusters_on_odd_rows(spark, dims):
    rows = odd(dims) + [(3000 + k, v) for k, v in enumerate(normal(8, 100, dims))]
    got = centroids.cluster_vectors(table(spark, rows), dims=dims, clusters=16, rounds=3)
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    assert clustered(got) == brute_clusters(rows, dims, 16, 3)


def test_clusters_of_few_and_of_huge_numbers(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, -4.5]), (None, [0.0, 1.0])]
    assert clustered(centroids.cluster_vectors(table(spark, rows), dims=2, clusters=4, rounds=2)) == brute_clusters(rows, 2, 4, 2)
    huge = [(k, [float(2 ** (k % 34)), float(-k)]) for k in range(60)]
    assert clustered(centroids.cluster_vectors(table(spark, huge), dims=2, clusters=4, rounds=3)) == brute_clusters(huge, 2, 4, 3)
    nobody = centroids.cluster_vectors(table(spark, [(None, [1.0, 2.0])]), dims=2).collect()
    assert [tuple(r) for r in nobody] == [(None,) * 6]
    assert centroids.cluster_vectors(table(spark, []), dims=2).count() == 0


def test_dictionaries_are_lossless():
    rows = np.random.default_rng(2).integers(-40, 40, (2000, 3))
    values, codes = centroids.encode(rows)
    assert (values[codes] == rows).all() and len(np.unique(values, axis=0)) == len(values) < 2000


# -- whitening ------------------------------------------------------------------------------------------------------------------------


def exact(rows):
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in rows]
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    v = [[(n * sum(r[a] * r[b] for r in x) - sums[a] * sums[b]) / n**2 for b in range(dims)] for a in range(dims)]
    return np.array(x, float), sums, np.array(v), [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]


@pytest.mark.parametrize("seed, rows, dims, top", [(1, 1, 3, 1), (2, 63, 4, 5), (3, 64, 2, 1 << 20), (4, 200, 5, 1 << 40)])
def test_scatter_by_popcount_is_exact(seed, rows, dims, top):
    x = np.random.default_rng(seed).integers(-top, top, (rows, dims))
    sums, crossed = whitening.scatter(x)
    assert sums.tolist() == [sum(map(int, x[:, d])) for d in range(dims)]
    assert crossed.tolist() == [[sum(int(r[a]) * int(r[b]) for r in x) for b in range(dims)] for a in range(dims)]


def test_whitening_on_odd_rows(spark):
    rows = [r for r in odd(12) if r[1] != [0.0] * 12] + [(500 + k, v) for k, v in enumerate(normal(4, 90, 12, 0.3))]
    kept = [(i, v) for i, v in rows if v and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v)]
    x, sums, v, deviation = exact([v for _, v in kept])
    values, vectors = np.linalg.eigh(v)
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 8 * len(kept) and {r["n"] for r in got} == {len(kept)}
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 3) == Counter((i, d) for (i, _), d in zip(kept, deviation, strict=True))
    for c in range(1, 9):
        e, direction = values[-c], vectors[:, -c]
        z = (x - np.array(sums) / len(kept)) @ direction / math.sqrt(e)
        mine = sorted(r["whitened"] for r in got if r["component"] == c)
        assert np.allclose(mine, sorted(z), atol=1e-8) or np.allclose(mine, sorted(-z), atol=1e-8)
        assert {round(r["explained"], 9) for r in got if r["component"] == c} == {round(e / np.trace(v), 9)}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [NAN])])).count() == 0
    assert whitening.whiten(table(spark, [(k, [1.0, 2.0]) for k in range(5)])).count() == 0
    line = whitening.whiten(table(spark, [(k, [float(k), 1.0]) for k in range(5)])).collect()
    assert {r["component"] for r in line} == {1} and all(r["identity_error"] < 1e-9 for r in line)
