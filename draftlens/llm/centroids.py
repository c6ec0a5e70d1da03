"""Exact centroid clustering with the threshold algorithm, in integers.

Each dimension keeps its centroids sorted by value. A vector walks every list outward
from its own value; a centroid seen for the first time gets its exact distance. No
centroid still unseen is nearer in any dimension than the list's frontier, so the walk
stops once the sum of squared frontier distances strictly exceeds the best distance
(at equality an unseen centroid with a smaller number could still win).
Vectors stay distributed; a round sends the centroids out and brings back one row of
sums for each cluster.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.llm import vectors as V
from draftlens.llm.common import save

#: Largest size of a scaled component; larger ones count as that, so that distances fit 64 bits.
LARGEST = 1 << 27
#: Vectors that walk together.
BLOCK = 2048


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the squared distance."""
    n, dims = x.shape
    k = len(centers)
    order = np.argsort(centers, axis=0, kind="stable")  # of each dimension: centroids by value
    value = np.take_along_axis(centers, order, 0)
    best, far = np.full(n, k, np.int64), np.full(n, np.iinfo(np.int64).max)
    dim = np.arange(dims)
    for at in range(0, n, BLOCK):
        own = x[at:at + BLOCK]
        rows = np.arange(len(own))
        right = np.zeros(own.shape, np.int64)
        for row in value:
            right += row < own  # the first centroid at or above the value
        left = right - 1
        seen = np.zeros((len(own), k), bool)
        while len(rows):
            v = own[rows]
            down = np.where(left >= 0, v - value[np.maximum(left, 0), dim], np.iinfo(np.int64).max)
            up = np.where(right < k, value[np.minimum(right, k - 1), dim] - v, np.iinfo(np.int64).max)
            lower = down <= up
            there = order[np.where(lower, np.maximum(left, 0), np.minimum(right, k - 1)), dim]
            frontier = np.minimum(down, up)
            new = np.zeros((len(rows), k), bool)
            new[np.arange(len(rows))[:, None], there] = True
            new &= ~seen[rows]
            seen[rows] |= new
            for c in range(k):
                who = rows[new[:, c]]
                step = own[who] - centers[c]
                d = np.einsum("nd,nd->n", step, step)
                nearer = (d < far[at + who]) | ((d == far[at + who]) & (c < best[at + who]))
                best[at + who[nearer]], far[at + who[nearer]] = c, d[nearer]
            left, right = left - lower, right + ~lower
            on = ~seen[rows].all(axis=1) & (np.einsum("nd,nd->n", frontier, frontier) <= far[at + rows])
            rows, left, right = rows[on], left[on], right[on]
    return best, far


def seeds(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose salted ids hash lowest; rows without an id come last."""
    first = rows.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "vec_id", "vec").limit(k)
    return np.array([r["vec"] for r in first.select("vec").collect()], np.int64)  # k rows


def sums(rows: DataFrame, centers: np.ndarray) -> list:
    """Of each cluster: size, summed components and distances. As many rows as centroids."""
    dims = centers.shape[1]

    def partial(batches):
        count, total, spread = np.zeros(len(centers), np.int64), np.zeros(centers.shape, np.int64), [0] * len(centers)
        for b in batches:
            x = V.integers(b.column(0), dims)
            best, far = nearest(x, centers)
            count += np.bincount(best, minlength=len(centers))
            for c in np.unique(best):  # a batch is small, so its sums fit 64 bits
                total[c] += x[best == c].sum(axis=0)
                spread[c] += int(far[best == c].sum(dtype=object)) if (best == c).any() else 0
        on = np.flatnonzero(count)
        cols = [pa.array(on, pa.int32()), pa.array(count[on]), pa.array([str(spread[c]) for c in on], pa.string()),
                pa.array(total[on].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["cluster", "n", "spread", "total"])

    found = rows.select("vec").mapInArrow(partial, "cluster int, n long, spread string, total array<long>")
    whole = [F.sum(F.get("total", F.lit(d)).cast("decimal(38,0)")).alias(f"t{d}") for d in range(dims)]
    return found.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("spread").cast("decimal(38,0)")).alias("spread"), *whole).collect()


def cluster(vectors: DataFrame, k: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, salt: str = "3:",
            id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Assign every vector to a centroid: (rows, final centroids).

    Rows: vec_id, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256. Vectors that are null, hold null or non-finite components or do
    not have ``dims`` components are left out. Components become floor(scale * x);
    one of more than 2**27 in size counts as 2**27. Centroids start as the k rows
    whose salted ids hash lowest (fewer, if there are fewer), then move ``rounds``
    times to the floor of their mean; an empty one stays. Repeated rows and ids are
    rows of their own; rows without an id are clustered, but start a centroid only
    where others are too few. No row, no result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clip = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, F.lit(2.0 ** 40)), F.lit(-(2.0 ** 40)))), F.lit(LARGEST)), F.lit(-LARGEST))
    rows = save(rows.where(F.col("vec").isNotNull() & (F.size("vec") == dims) & finite).select("vec_id", F.transform("vec", clip).cast("array<long>").alias("vec")))
    schema = "vec_id long, cluster int, distance long, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string"
    centers = seeds(rows, k, salt)
    if not len(centers):
        return spark.createDataFrame([], schema), centers
    for _ in range(rounds):
        for r in sums(rows, centers):
            centers[r["cluster"]] = [int(r[f"t{d}"]) // r["n"] for d in range(dims)]
    spread = {r["cluster"]: int(r["spread"]) for r in sums(rows, centers)}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers.tolist()]

    def label(batches):
        for b in batches:
            best, far = nearest(V.integers(b.column(1), dims), centers)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])

    done = rows.mapInArrow(label, "vec_id long, cluster int, distance long")
    of = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster")).cast(kind)
    done = done.withColumn("cluster_inertia", of([str(spread.get(c, 0)) for c in range(len(centers))], "decimal(38,0)"))
    done = done.withColumn("inertia", F.lit(str(sum(spread.values()))).cast("decimal(38,0)"))
    return done.withColumn("centroid_sha256", of(names, "string")), centers
