"""Centroid clustering on integer vectors with bounds kept over the centroid history (ns-bounds).

Every vector keeps, for each centroid, the last distance that was worked out and the round it is from. A bound is that
distance less the norm of the centroid's whole displacement since then, which the history of centroids gives: drifts of
single rounds are never added up, so a centroid that comes back loosens nothing. Only centroids whose bound doesn't
clear the vector's own distance are measured again, in whole numbers; so labels, ties and sums are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage

__all__ = ["integer_vectors", "cluster_vectors", "nearest_by_bounds"]

SLACK = 1e-9   # relative, far above the rounding of a distance


def integer_vectors(vectors: DataFrame, scale: int, largest: int, vector_col: str, size: int | None = None) -> DataFrame:
    """vectors with ``v``, the whole numbers floor(scale * x). Rows whose vector is null, holds a null, a component that
    is not finite or one whose whole number reaches ``largest`` in magnitude (sums of squares then outgrow a long), or
    has another length than ``size`` are left out."""
    limit = float(largest) / scale
    fine = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < limit))
    if size is not None:
        fine = fine & (F.size(vector_col) == size)
    return vectors.where(fine).withColumn("v", F.transform(vector_col, lambda x: F.floor(x.cast("double") * float(scale)).cast("int")))


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """The lists of a column, all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of x to every row of c."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 2 ** 53:   # whole numbers stay exact in doubles
        a, b = x.astype(float), c.astype(float)
        return ((a ** 2).sum(1)[:, None] - 2 * a @ b.T + (b ** 2).sum(1)[None]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def nearest_by_bounds(x: np.ndarray, history: list[np.ndarray], cluster: np.ndarray, near: np.ndarray, at: np.ndarray,
                      bounds: np.ndarray, times: np.ndarray) -> int:
    """Move every row of x to its nearest of the last centroids of history (ties: smaller number).

    ``cluster``, ``near`` (exact squared distance to it, from round ``at``), ``bounds`` (n x k distances, rounded down,
    from round ``times``) are brought up to date in place. Returns how many distances were measured.
    """
    now, centres = len(history) - 1, history[-1]
    rows = np.arange(len(x))
    moved = np.sqrt(np.stack([((h - centres).astype(float) ** 2).sum(1) for h in history])) * (1 + SLACK)
    upper = np.sqrt(near.astype(float)) + moved[at, cluster]
    lower = bounds - moved[times, np.arange(len(centres))[None]]
    open_ = lower <= upper[:, None] * (1 + SLACK)
    open_[rows, cluster] = False
    doubt = np.flatnonzero(open_.any(axis=1))
    if not len(doubt):
        return 0

    def measure(r: np.ndarray, j) -> np.ndarray:
        d = ((x[r] - centres[j]) ** 2).sum(axis=1)
        bounds[r, j] = np.nextafter(np.sqrt(d.astype(float)).astype(np.float32), np.float32(-np.inf))
        times[r, j] = now
        return d

    near[doubt], at[doubt] = measure(doubt, cluster[doubt]), now
    still = lower[doubt] <= np.sqrt(near[doubt].astype(float))[:, None] * (1 + SLACK)
    still[np.arange(len(doubt)), cluster[doubt]] = False
    exact = np.full(still.shape, np.iinfo(np.int64).max)
    exact[np.arange(len(doubt)), cluster[doubt]] = near[doubt]
    for j in range(len(centres)):
        r = np.flatnonzero(still[:, j])
        if len(r):
            exact[r, j] = measure(doubt[r], j)
    cluster[doubt] = exact.argmin(axis=1)
    near[doubt] = exact.min(axis=1)
    return len(doubt) + int(still.sum())


def _first(history: list[np.ndarray]):
    centres = history[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"))
            d = squared(x, centres)
            own = d.argmin(axis=1)
            low = np.nextafter(np.sqrt(d.astype(float)).astype(np.float32), np.float32(-np.inf))
            n = len(x)
            yield pa.record_batch([b.column("vec_id"), b.column("v"), pa.array(own.astype(np.int32)), pa.array(d[np.arange(n), own]),
                                   pa.array(np.zeros(n, np.int16)), lists(low), lists(np.zeros(d.shape, np.int16))], NAMES)
    return run


def _next(history: list[np.ndarray], last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"))
            cluster, near, at = (b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "near", "at"))
            bounds, times = matrix(b.column("bounds"), np.float32).copy(), matrix(b.column("times"), np.int16).copy()
            nearest_by_bounds(x, history, cluster, near, at, bounds, times)
            if last:
                exact = ((x - history[-1][cluster]) ** 2).sum(axis=1)
                yield pa.record_batch([b.column("vec_id"), pa.array(cluster), pa.array(exact)], ["vec_id", "cluster", "distance"])
            else:
                yield pa.record_batch([b.column("vec_id"), b.column("v"), pa.array(cluster), pa.array(near), pa.array(at), lists(bounds), lists(times)], NAMES)
    return run


NAMES = ["vec_id", "v", "cluster", "near", "at", "bounds", "times"]
STATE = "v array<int>, cluster int, near long, at smallint, bounds array<float>, times array<smallint>"


def _means(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) per cluster; a cluster without vectors stays. Sums are longs within a partition,
    where they can't overflow, and decimals over all of them; k rows come back."""
    size = centres.shape[1]
    part = (state.select("cluster", F.spark_partition_id().alias("part"), *[F.col("v")[j].alias(f"s{j}") for j in range(size)])
            .groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(size)]))
    sums = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{j}").cast("decimal(20,0)")).alias(f"s{j}") for j in range(size)])
    new = centres.copy()
    for r in sums.collect():
        new[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(size)]
    return new


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, size: int = 64,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector after ``rounds`` rounds.

    Kept are vectors of ``size`` components, none null or non-finite; a component of 2**19 or more in magnitude counts as
    non-finite at the default scale, since squared distances would outgrow a long. The first centroids are the k kept
    rows with the least sha256 of ``2:<id>``; rows of one id are ordered by their vectors, rows without an id come last.
    Repeated rows count each, and equal rows among the first give equal centroids of which the smaller number takes all.
    Fewer kept rows than k make as many centroids; an empty table gives an empty result. Sums of distances beyond a long
    are null. Other columns are not carried.

    One pass a round over stored rows; what leaves the tasks are sums per cluster, so a cluster with most rows is spread
    like any other. Only the k centroids of each round are on the driver.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("_e"))
    kept = integer_vectors(named, scale, 2 ** 27, "_e", size).select("vec_id", "v")
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    seeds = kept.select(order.alias("o"), "v").orderBy(F.col("o").asc_nulls_last(), "v").limit(k).collect()
    history = [np.array([r["v"] for r in seeds], dtype=np.int64).reshape(-1, size)]
    id_type = kept.schema["vec_id"].dataType.simpleString()
    if not seeds:
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    state = stage(kept.mapInArrow(_first(history), f"vec_id {id_type}, {STATE}"))
    for step in range(rounds):
        history.append(_means(state, history[-1]))
        last = step == rounds - 1
        out = "cluster int, distance long" if last else STATE
        before, state = state, stage(state.mapInArrow(_next(list(history), last), f"vec_id {id_type}, {out}"))
        release(before)
    inertia = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    held = lambda n: n if n < 2 ** 63 else None
    per_cluster = [(j, held(d), held(sum(inertia.values())), hashlib.sha256(",".join(map(str, history[-1][j].tolist())).encode()).hexdigest()) for j, d in inertia.items()]
    sums = spark.createDataFrame(per_cluster, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")   # k rows
    return state.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
