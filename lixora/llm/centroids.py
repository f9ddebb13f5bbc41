"""k-means over integer vectors with Ptolemaic pivots.

Ptolemy's inequality holds in Euclidean space: for points x, c and a pair of pivots p, s,
``d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s)``. The distances of every vector to the fixed pivots are
computed once and kept beside it; those of a few centroids are computed in each round. The largest bound over the
pivot pairs rules centroids out; those that it leaves are compared exactly, in integers. Bounds are rounded so that
error can only make them smaller: results equal those of comparing every vector with every centroid.

Kept are vectors of exactly ``dims`` components, none null, NaN or infinite; a component x becomes floor(64 x). Rows
that repeat, and rows with a null vec_id, are vectors of their own; a null id is never a first centroid while others
are left. Ties go to the smaller centroid. Fewer than k vectors give as many centroids; an empty table gives no rows.
Extra columns are ignored. Components beyond 2^27 raise an error, as their distances don't fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lixora.llm.common import saved

DIMS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Pivot pairs at most; the pivots are the first centroids.
PAIRS = 8
#: Largest size of a scaled component: the squared distance of 64 such components is less than 2^63.
MOST = 2**27
#: Vectors compared at a time.
BLOCK = 4096
#: More than the relative error of a few roundings of 64-bit floats.
SLACK = 2.0**-48
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept_vectors(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, v): vectors that count, as arrays of scaled integers."""
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    within = F.when(F.forall("e", lambda x: F.abs(x * SCALE) <= MOST), F.transform("e", lambda x: F.floor(x * SCALE)))
    whole = F.coalesce(within, F.raise_error(F.lit(f"a component is beyond {MOST // SCALE}")).cast("array<long>"))
    return rows.where((F.size("e") == dims) & sound).select("vec_id", whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors whose ids hash lowest; k rows reach the driver."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    got = vectors.select(name.alias("name"), "v").orderBy(F.asc_nulls_last("name"), "v").limit(k).collect()
    return np.asarray([r["v"] for r in got], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to the same rows of c."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of every row to every pivot, as floats."""
    return np.sqrt(np.stack([squared(x, p) for p in pivots], axis=1).astype(np.float64))


def pivot_pairs(pivots: np.ndarray, most: int = PAIRS) -> list[tuple[int, int]]:
    """Pairs of different pivots, each used once, the farthest pair first."""
    far = sorted(((-int(squared(pivots[i : i + 1], pivots[j : j + 1])[0]), i, j) for i in range(len(pivots)) for j in range(i)))
    pairs: list[tuple[int, int]] = []
    for d, i, j in far:
        if d < 0 and len(pairs) < most and not {i, j} & {p for pair in pairs for p in pair}:
            pairs.append((i, j))
    return pairs


def lower_bounds(near: np.ndarray, centres: np.ndarray, pivots: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """A distance that each centroid (column) has at least from each vector (row).

    near, centres: their distances to the pivots.
    """
    least = np.zeros((len(near), len(centres)))
    for p, s in pairs:
        a, b = np.outer(near[:, p], centres[:, s]), np.outer(near[:, s], centres[:, p])
        between = np.sqrt(float(squared(pivots[p : p + 1], pivots[s : s + 1])[0]))
        np.maximum(least, (np.abs(a - b) - (a + b) * SLACK) / (between * (1 + SLACK)), out=least)
    return least * (1 - SLACK)


def nearest(x: np.ndarray, near: np.ndarray, centroids: np.ndarray, pivots: np.ndarray, pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each row of x, and how many exact distances that took."""
    least = lower_bounds(near, to_pivots(centroids, pivots), pivots, pairs)
    rows = np.arange(len(x))
    guess = least.argmin(axis=1)
    best = squared(x, centroids[guess])
    open_ = least <= (np.sqrt(best.astype(np.float64)) * (1 + SLACK))[:, None]
    open_[rows, guess] = False
    exact = len(x) + int(open_.sum())
    for k in range(len(centroids)):  # in order of centroids
        at = np.flatnonzero(open_[:, k])
        d = squared(x[at], centroids[k])
        nearer = (d < best[at]) | ((d == best[at]) & (k < guess[at]))
        best[at[nearer]], guess[at[nearer]] = d[nearer], k
    return guess, best, exact


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, near): components and cached pivot distances as bytes."""

    def fn(batches):
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            near = to_pivots(x, pivots)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()), pa.array([r.tobytes() for r in near], pa.binary())], names=["vec_id", "v", "near"])

    return vectors.mapInArrow(fn, "vec_id long, v binary, near binary")


def blocks(batch: pa.RecordBatch):
    """(ids, vectors, pivot distances) of a batch, BLOCK rows at a time."""
    for at in range(0, batch.num_rows, BLOCK):
        b = batch.slice(at, BLOCK)
        read = lambda name, kind: np.frombuffer(b"".join(b.column(name).to_pylist()), kind).reshape(b.num_rows, -1)
        yield b.column("vec_id"), read("v", "<i4").astype(np.int64), read("near", np.float64)


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """The centroids after one round. Each task adds up its vectors; k * dims sums reach the driver."""
    k, dims = centroids.shape

    def fn(batches):
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x, near in blocks(batch):
                own, _, _ = nearest(x, near, centroids, pivots, pairs)
                for c in np.unique(own):
                    sums[c] += x[own == c].sum(axis=0)
                counts += np.bincount(own, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), dims)), pa.array(np.tile(np.arange(dims), k)), pa.array(sums.ravel()), pa.array(np.repeat(counts, dims))], names=["c", "d", "s", "n"])

    parts = table.mapInArrow(fn, "c long, d long, s long, n long").groupBy("c", "d")
    after = centroids.copy()
    for r in parts.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
        if r["n"]:
            after[r["c"], r["d"]] = int(r["s"]) // r["n"]
    return after


def clustered(rows: DataFrame, dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """Each kept vector's cluster and squared distance after ``rounds`` rounds, with the inertia of its cluster and of all."""
    spark = rows.sparkSession
    vectors = kept_vectors(rows, dims)
    centroids = pivots = first_centroids(vectors, k)
    if not len(pivots):
        return spark.createDataFrame([], SCHEMA)
    pairs = pivot_pairs(pivots)
    table = saved(with_pivots(vectors, pivots), "vectors")
    for _ in range(rounds):
        centroids = moved(table, centroids, pivots, pairs)

    def fn(batches):
        for batch in batches:
            for ids, x, near in blocks(batch):
                own, best, _ = nearest(x, near, centroids, pivots, pairs)
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    placed = saved(table.mapInArrow(fn, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: int(r["total"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(c, n, sum(inertia.values()), names[c]) for c, n in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows are broadcast
