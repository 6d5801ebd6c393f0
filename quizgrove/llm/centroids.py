"""Clustering around centroids with Ptolemaic pivots (operator 12).

For four points, Ptolemy's inequality bounds a distance from below by those to a pair of pivots p and s:
d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s). The distances of all vectors to a few fixed pivots are worked out
once and stored beside them. A round works out the few distances between centroids and pivots, bounds every
vector's distance to every centroid, looks at the centroid with the least bound exactly and then only at those
whose bound doesn't exceed the best distance found. Bounds are rounded down, so that no centroid that is as near is lost;
what is compared in the end are whole numbers.

Tasks read their share of the stored vectors and return one row of sums per centroid: rows aren't shuffled by cluster, so
a cluster may hold any share of them. The centroids are a parameter's worth of rows and pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizgrove.session import saved

COMPONENTS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Pivots: the initial centroids that lie farthest apart. All their pairs give bounds.
PIVOTS = 8
#: Components from here on could bring a squared distance beyond 64 bits.
LARGEST = 1 << 26
#: More than the rounding errors of a bound add up to, as a share of its largest part.
SLACK = 2.0**-46


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v (integers floor(64 * x)) of the rows with ``COMPONENTS`` components, none null or non-finite."""
    value = F.col("embedding")
    fits = (F.size(value) == COMPONENTS) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(fits).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(value, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    small = F.forall("v", lambda x: F.abs(x) < LARGEST)
    return rows.select("vec_id", F.when(small, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).cast("array<int>").alias("v"))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one row each or to the same row."""
    apart = v - c
    return np.einsum("ij,ij->i", apart, apart)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def spread_out(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different points, each the one farthest from those before it."""
    chosen, nearest = [0], squared(points, points[0])
    while len(chosen) < count and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(points, points[chosen[-1]]))
    return points[chosen]


def to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(v, p) for p in pivots], axis=1).astype(np.float64))


def lower_bounds(own: np.ndarray, others: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Squared distances, bounded from below, from the pivot distances of vectors (rows) and centroids (columns).

    Each pivot distance is off by less than its last bit, each product by three; ``SLACK`` is taken off for all.
    """
    found = np.zeros((len(own), len(others)))
    for p in range(len(between)):
        for s in range(p):
            a, b = own[:, p, None] * others[:, s], own[:, s, None] * others[:, p]
            np.maximum(found, (np.abs(a - b) - (a + b) * SLACK) / between[p, s], out=found)
    return found * found * (1 - SLACK)


def assign(v: np.ndarray, own: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (the first of equals), squared distance, and how many distances were worked out exactly."""
    bounds = lower_bounds(own, to_pivots(centroids, pivots), to_pivots(pivots, pivots))
    label = bounds.argmin(axis=1)
    started, best, looked = label.copy(), squared(v, centroids[label]), len(v)
    for j, centroid in enumerate(centroids):
        rows = np.flatnonzero((bounds[:, j] <= best) & (started != j))
        distance = squared(v[rows], centroid)
        nearer = (distance < best[rows]) | ((distance == best[rows]) & (j < label[rows]))
        best[rows[nearer]], label[rows[nearer]] = distance[nearer], j
        looked += len(rows)
    return label, best, looked


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The vectors with ``reach``, their distances to the pivots."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = to_pivots(matrix(batch.column("v")), pivots)
            lists = pa.ListArray.from_arrays(np.arange(0, reach.size + 1, len(pivots), dtype=np.int32), reach.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], ["vec_id", "v", "reach"])

    return vectors.mapInArrow(measure, "vec_id long, v array<int>, reach array<double>")


def nearest(batch: pa.RecordBatch, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = matrix(batch.column("v"))
    own = batch.column("reach").flatten().to_numpy().reshape(len(v), -1)
    return v, *assign(v, own, centroids, pivots)[:2]


def moved(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means; one without vectors stays."""
    size = centroids.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            v, label, _ = nearest(batch, centroids, pivots)
            for j in np.unique(label):
                own = v[label == j]
                total[j] += own.sum(axis=0)
                count[j] += len(own)
        for j in np.flatnonzero(count):
            yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([count[j]], pa.int64()), pa.array([total[j]], pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = stored.mapInArrow(sums, "cluster int, n long, sums array<long>")
    added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size)]
    after = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect():  # one row a centroid
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(size)]
    return after


def clusters(vectors: DataFrame, count: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of each kept vector, and the final centroids.

    Kept are the vectors with ``COMPONENTS`` components, none of them null or non-finite. The initial centroids are the
    ``count`` kept rows with the least hashes of their ids (a null id counts as an empty one; rows that share an id in
    order of their components; repeated rows count each); with fewer rows there are fewer centroids, and with none no
    rows. Ties go to the smaller number. Components of 2**20 or more in magnitude are an error: their squared
    distances would need more than 64 bits. Other columns are not read.
    """
    whole = saved(whole_vectors(vectors), "vectors")
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = whole.orderBy(hashed, "v").limit(count).collect()
    if not first:
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, COMPONENTS), dtype=np.int64)
    centroids = np.array([row["v"] for row in first], dtype=np.int64)
    pivots = spread_out(centroids, PIVOTS)
    stored = saved(with_pivots(whole, pivots), "pivot-distances")
    for _ in range(rounds):
        centroids = moved(stored, centroids, pivots)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, found, distance = nearest(batch, centroids, pivots)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return saved(stored.mapInArrow(label, "vec_id long, cluster int, distance long"), "clusters"), centroids


def cluster_table(vectors: DataFrame, count: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector."""
    rows, centroids = clusters(vectors, count, rounds)
    sums = {row["cluster"]: row["s"] for row in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a centroid
    digests = [hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest() for centroid in centroids]
    each = [(j, sums.get(j, 0), sum(sums.values()), digest) for j, digest in enumerate(digests)]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(each, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
