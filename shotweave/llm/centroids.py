"""Centroid clustering of integer vectors with geometric drift tightening.

Every vector keeps its cluster and a lower bound on its distance to all other centroids. When centroids move, the bound must
be loosened. Instead of by the largest drift, it is loosened by what a move can take from any point of the cluster's sphere:
for a centroid that moves from p to q and a point x, |x - p| - |x - q| = 2 y.(q - p) / (|x - p| + |x - q|), with y the vector
from the middle of p and q to x. The denominator is at least 2 |y|, so this is at most |q - p| times the cosine of the angle
between y and q - p. In the plane of p, q and the sphere's centre, the sphere seen from the middle covers a known angle to
both sides of its centre, so the cosine over the whole sphere is bounded, and is 0 where the sphere lies behind. Vectors whose
own distance is not below the bound, or half the way to the next centroid, are scanned exactly. The bounds are in double
precision with a margin; distances, ties and centroids are exact integers, so the result does not depend on the bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.sources.scratch import stored

#: Components beyond this have squared distances that may not fit a long.
LARGEST = 1 << 27
#: Products and sums of integers up to this are exact in double precision.
EXACT = 1 << 22
MARGIN = 1e-9
STATE = "vec_id {}, v array<int>, cluster int, distance bigint, lower double, scanned boolean"


def integers(df: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of `dims` components as floor(scale * x), all finite and within +-LARGEST."""
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST))
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias(vector)).where((F.size(vector) == dims) & fine)
    return rows.select("vec_id", F.transform(whole, lambda x: x.cast("int")).alias("v"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x from all rows of c, as int64."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Per cluster, the most that the distance of a vector in its old sphere to another centroid can have shrunk."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    move = new - old
    drift = np.sqrt((move * move).sum(axis=1))
    out = np.zeros(len(old))
    for i, (centre, r) in enumerate(zip(old, radius, strict=True)):
        y = centre[None, :] - (old + new) / 2
        far = np.sqrt((y * y).sum(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            angle = np.arccos(np.clip((y * move).sum(axis=1) / (far * drift), -1, 1))
            covered = np.arcsin(np.clip(r / far, 0, 1))
        share = np.where((r < far) & (drift > 0), np.maximum(0, np.cos(np.maximum(0, angle - covered))), 1.0)
        most = drift * np.minimum(1, share + MARGIN)
        most[i] = 0
        out[i] = most.max(initial=0)
    return out


def assigned(x: np.ndarray, cluster: np.ndarray, lower: np.ndarray, c: np.ndarray, loose: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cluster, distance, lower, scanned) after the centroids `c`; a cluster of -1 means not yet assigned."""
    cluster, own = cluster.copy(), np.full(len(x), np.iinfo(np.int64).max)
    known = np.flatnonzero(cluster >= 0)
    diff = x[known] - c[cluster[known]]
    own[known] = (diff * diff).sum(axis=1)
    away = np.sqrt(own.astype(np.float64)) * (1 + MARGIN) + MARGIN
    # by the triangle inequality, the next centroid is at least its distance from the own one less `away`
    bound = np.where(cluster >= 0, np.maximum(lower - loose[cluster], 2 * half[cluster] - away), -np.inf) - MARGIN
    scan = np.flatnonzero(~(away < bound))
    if len(scan):
        d = squared(x[scan], c)
        best = d.argmin(axis=1)  # the first of equals
        cluster[scan], own[scan] = best, d[np.arange(len(scan)), best]
        d[np.arange(len(scan)), best] = np.iinfo(np.int64).max
        bound[scan] = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - MARGIN)
    scanned = np.zeros(len(x), dtype=bool)
    scanned[scan] = True
    return cluster, own, bound, scanned


def _rows(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _step(c: np.ndarray, loose: np.ndarray, half: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, lower = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            got = assigned(_rows(batch.column(1), c.shape[1]), cluster, lower, c, loose, half)
            kinds = [pa.int32(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, k) for x, k in zip(got, kinds, strict=True)]], names=["vec_id", "v", "cluster", "distance", "lower", "scanned"])

    return run


def _sums(k: int, dims: int):
    """A row per cluster that a task has met: count, largest distance, and sums of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, far = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster = batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(cluster, kind="stable")
            ids, first = np.unique(cluster[order], return_index=True)
            total[ids] += np.add.reduceat(_rows(batch.column(0), dims)[order], first, axis=0)
            n += np.bincount(cluster, minlength=k)
            far[ids] = np.maximum(far[ids], np.maximum.reduceat(batch.column(2).to_numpy(zero_copy_only=False)[order], first))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n[met]), pa.array(far[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], names=["cluster", "n", "far", "total"])

    return run


def moved(state: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, radii): the floored means of the clusters, and the spheres about the old centroids. One row per cluster and
    component reaches the driver."""
    part = state.select("v", "cluster", "distance").mapInArrow(_sums(*c.shape), "cluster int, n bigint, far bigint, total array<bigint>")
    whole = part.select("cluster", "n", "far", F.posexplode("total").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    new, radius = c.copy(), np.zeros(len(c))
    for r in whole.collect():
        new[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
        radius[r["cluster"]] = np.sqrt(float(r["far"])) * (1 + MARGIN)
    return new, radius


def half_gaps(c: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the next one."""
    d = squared(c, c).astype(np.float64)
    np.fill_diagonal(d, np.inf)
    return np.sqrt(d.min(axis=1)) / 2 * (1 - MARGIN)


def cluster_vectors(spark: SparkSession, df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per kept vector; distances are squared.

    Kept are vectors of `dims` components, none null, not finite, or beyond 2**27 as an integer, since squared distances of
    larger ones do not fit a long. The k kept vectors with the smallest sha256 of 'seed:vec_id' start, repeated and null ids
    (an empty text) in the order of their components; fewer vectors make fewer centroids. Ties go to the smaller number, and
    empty clusters stay where they are. Repeated rows count each. A sum of distances beyond a long is given as the largest long.
    No vectors, no rows. Other columns are not read.
    """
    kept = stored(integers(df, vec_id, vector, dims, scale))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = kept.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()  # k vectors
    kind = dict(kept.dtypes)["vec_id"]
    state = kept.withColumns({"cluster": F.lit(-1), "lower": F.lit(0.0)})
    if not starts:
        return state.select("vec_id", "cluster", F.lit(0).cast("bigint").alias("distance"), F.lit(0).cast("bigint").alias("cluster_inertia"), F.lit(0).cast("bigint").alias("inertia"), F.lit("").alias("centroid_sha256"))
    c = np.array([r["v"] for r in starts], dtype=np.int64)
    loose, held = np.zeros(len(c)), kept
    for turn in range(rounds + 1):
        state = held = stored(state.select("vec_id", "v", "cluster", "lower").mapInArrow(_step(c, loose, half_gaps(c)), STATE.format(kind)), instead=held)
        if turn < rounds:
            new, radius = moved(state, c)
            c, loose = new, loosening(c, new, radius)
    sums = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    most = np.iinfo(np.int64).max
    final = spark.createDataFrame([(i, min(s, most), min(sum(sums.values()), most), names[i]) for i, s in sums.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(final), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
