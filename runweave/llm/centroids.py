"""Clusters around centroids in whole numbers, with Ptolemaic bounds in place of most distances.

Components become integers, so every sum and distance is exact and results do not
depend on how rows are dealt. For points x, c and pivots p, q Ptolemy's inequality
gives d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q). The distances of all
vectors to the fixed pivots are computed once and kept beside them; a round adds those
of its centroids. Bounds are rounded down by more than their error, so a centroid is
left out only where it is certainly farther than the best one so far; the rest is
decided by exact squared distances. A round moves one row of sums per cluster and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Components of a vector, factor before they are cut to integers, clusters, rounds, what is hashed to choose the first centroids.
DIMS, FACTOR, CLUSTERS, ROUNDS, SALT = 64, 1024, 8, 10, "3:"
#: Pivots, chosen among the first centroids. Integers beyond this have squares that sum past a long.
PIVOTS, MOST = 4, 1 << 27
#: Relative error that bounds allow for, far over that of the few operations on doubles.
SLACK = 2.0**-44


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (integers floor(FACTOR * x)) of the vectors with DIMS components, none null or not finite.

    A vector with an integer beyond MOST is left out too, as its squares do not fit.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double") * FACTOR)
    fits = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < MOST), F.lit(False)))
    usable = (F.size(vector_col) == DIMS) & fits
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, F.transform(x, lambda c: F.floor(c).cast("int"))).alias("v")).filter("v is not null")


def first_centroids(whole: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors of the smallest hashes of their identifiers, in that order; of one identifier, the smaller vector first."""
    rank = F.sha2(F.concat(F.lit(SALT), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = whole.select(rank.alias("rank"), "v").orderBy("rank", "v").limit(clusters).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), DIMS)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([_squared(x, p[None]) for p in pivots], axis=1).astype(np.float64))


def choose_pivots(centroids: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Some of the first centroids, each the one farthest from those chosen; no two are equal."""
    chosen = [0]
    while len(chosen) < min(most, len(centroids)):
        far = _to_pivots(centroids, centroids[chosen]).min(axis=1)
        if not far.max():
            break
        chosen.append(int(far.argmax()))
    return centroids[chosen]


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(kind)


def lower_bounds(near: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each vector (row of distances to the pivots) and centroid, a distance that the true one is never under."""
    own, between = _to_pivots(centroids, pivots), _to_pivots(pivots, pivots)
    out = np.zeros((len(near), len(centroids)))
    for p, q in combinations(range(len(pivots)), 2):
        one, two = near[:, p, None] * own[None, :, q], near[:, q, None] * own[None, :, p]
        np.maximum(out, (np.abs(one - two) - SLACK * (one + two)) / between[p, q], out=out)
    return out * (1 - SLACK)


def nearest(x: np.ndarray, near: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector the nearest centroid (of equally near ones the smaller number) and the squared distance.

    The centroid of the smallest bound is measured first. Another is measured only where its
    bound is not over the best distance so far.
    """
    bound = lower_bounds(near, centroids, pivots)
    cluster = bound.argmin(axis=1)
    best = _squared(x, centroids[cluster])
    for k in range(len(centroids)):
        rows = np.flatnonzero((cluster != k) & (bound[:, k] * bound[:, k] * (1 - SLACK) <= best))
        if len(rows):
            d = _squared(x[rows], centroids[k][None])
            better = (d < best[rows]) | ((d == best[rows]) & (k < cluster[rows]))
            cluster[rows[better]], best[rows[better]] = k, d[better]
    return cluster, best


def _with_pivots(pivots: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _to_pivots(_matrix(batch.column(1), DIMS, np.int64), pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, len(pivots)), pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "v", "near"])

    return task


def _sums(centroids: np.ndarray, pivots: np.ndarray):
    """Of each cluster the sum of each component over a task's vectors, and at place DIMS how many there are."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), DIMS + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), DIMS, np.int64)
            cluster, _ = nearest(x, _matrix(batch.column(1), len(pivots), np.float64), centroids, pivots)
            for k in np.unique(cluster):
                own = x[cluster == k]
                sums[k] += np.r_[own.sum(axis=0), len(own)]
        rows = np.flatnonzero(sums[:, DIMS])
        columns = np.repeat(rows, DIMS + 1), np.tile(np.arange(DIMS + 1), len(rows)), sums[rows].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "place", "total"])

    return task


def _assigner(centroids: np.ndarray, pivots: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_matrix(batch.column(1), DIMS, np.int64), _matrix(batch.column(2), len(pivots), np.float64), centroids, pivots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return task


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of their vectors' means; those without vectors stay."""
    parts = table.select("v", "near").mapInArrow(_sums(centroids, pivots), "cluster int, place int, total long")
    rows = parts.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()  # DIMS + 1 rows a cluster
    total = {(r.cluster, r.place): r.total for r in rows}
    out = centroids.copy()
    for k in {r.cluster for r in rows}:
        out[k] = [total[k, i] // total[k, DIMS] for i in range(DIMS)]
    return out


def clustered(vectors: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable vector, and the final centroids.

    Unusable are null vectors and those with a number of components other than DIMS, or
    with one that is null, not finite or, as an integer, beyond MOST. Fewer usable
    vectors than ``clusters`` make as many centroids; none make an empty table. Equal
    vectors may become equal centroids, of which the first gets all. Repeated rows count
    each time, a null identifier hashes as an empty one; other columns are not read.
    """
    whole = written(whole_vectors(vectors, id_col, vector_col), "whole")
    centroids = first_centroids(whole, clusters)
    if not len(centroids):
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    pivots = choose_pivots(centroids)
    table = written(whole.mapInArrow(_with_pivots(pivots), "vec_id long, v array<int>, near array<double>"), "vectors")
    for _ in range(rounds):
        centroids = moved(table, centroids, pivots)
    return table.mapInArrow(_assigner(centroids, pivots), "vec_id long, cluster int, distance long"), centroids


def clusters_digest(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    rows, centroids = clustered(vectors, **settings)
    rows = written(rows, "assigned")
    spark = rows.sparkSession
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    facts = [(k, sums.get(k, 0), sum(sums.values()), ",".join(map(str, c.tolist()))) for k, c in enumerate(centroids)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid string")
    out = rows.join(F.broadcast(facts), "cluster")  # as many rows as clusters
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))
