"""Centroid clustering over integer vectors with lookup tables of squared differences.

Components become integers, so a dimension takes few different values. Each round ships the
centroids to the tasks (``clusters`` vectors, a bound of their own). For every dimension of a batch a task tabulates
the squared difference of each occurring value to each centroid; the distances of the batch are gathers from these tables and their sums. A
table has at most as many rows as the batch has vectors. Sums and counts per cluster and dimension are added up by Spark as exact decimals; only
``clusters`` x ``dimensions`` of them reach the driver, whatever the number of vectors.

Defined results: vectors that are null, of another dimension, or hold a null or non-finite component are left out.
Integers beyond ``LARGEST`` either way count as ``LARGEST``, since 64 bits hold no longer squared distance;
sums of distances that pass 64 bits are null. Ties go to the smaller centroid number. A null id hashes as
an empty one. Equal ids are placed row by row, in the order of their vectors. With fewer vectors than clusters
there are fewer centroids; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import stage

#: 64 squares of twice this number still fit in 63 bits.
LARGEST = 1 << 27


def scalars(embeddings: DataFrame, dimensions: int, scale: int, id: str, vector: str) -> DataFrame:
    """``vec`` and ``v``, the vector as integers, of every usable row."""
    given = embeddings.select(F.col(id).alias("vec"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("e"))
    whole = F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))

    def scalar(x: Column) -> Column:
        return F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(1e9)), F.lit(-1e9)) * scale), F.lit(LARGEST)), F.lit(-LARGEST))

    return given.where((F.size("e") == dimensions) & whole).select("vec", F.transform("e", lambda x: scalar(x).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes of seed and id."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec").cast("string"), F.lit(""))), 256)
    first = vectors.select(name.alias("name"), "v").orderBy("name", "v").limit(clusters).collect()
    return np.array([r.v for r in first], np.int64)


def distances(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to all centroids, gathered from one table per dimension."""
    total = np.zeros((len(values), len(centroids)), np.int64)
    for d in range(values.shape[1]):
        occurring, at = np.unique(values[:, d], return_inverse=True)
        table = (occurring.astype(np.int64)[:, None] - centroids[None, :, d]) ** 2
        total += table[at]
    return total


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            far = distances(_rows(batch), centroids)
            near = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec"), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])], ["vec", "cluster", "distance"]
            )


def _partial_sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Count and sums per cluster of each batch; a batch's sums fit in 64 bits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = _rows(batch)
        near = distances(values, centroids).argmin(axis=1)
        sums = np.zeros(centroids.shape, np.int64)
        np.add.at(sums, near, values)
        counts = np.bincount(near, minlength=len(centroids))
        used = np.flatnonzero(counts)
        width = centroids.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used.astype(np.int32)), pa.array(counts[used].astype(np.int64)),
                pa.ListArray.from_arrays(np.arange(0, len(used) * width + 1, width, dtype=np.int32), pa.array(sums[used].reshape(-1))),
            ],
            ["cluster", "n", "sums"],
        )


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of their vectors; empty ones stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    partial = vectors.mapInArrow(lambda b: _partial_sums(b, shared.value), "cluster int, n long, sums array<long>")
    exact = "decimal(38,0)"
    per_cell = partial.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(
        F.sum(F.col("n").cast(exact)).alias("n"), F.sum(F.col("s").cast(exact)).alias("s")
    )
    out = centroids.copy()
    for r in per_cell.collect():  # clusters x dimensions
        out[r.cluster, r.d] = int(r.s) // int(r.n)
    return out


def cluster(
    embeddings: DataFrame, clusters: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: int = 2,
    id: str = "vec_id", vector: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """``id``, ``cluster`` and ``distance`` of every usable vector, and the final centroids."""
    vectors = stage(scalars(embeddings, dimensions, scale, id, vector))
    centroids = first_centroids(vectors, clusters, seed)
    kind = embeddings.schema[id].dataType.simpleString()
    if not len(centroids):
        return vectors.select(F.col("vec").alias(id), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    shared = embeddings.sparkSession.sparkContext.broadcast(centroids)
    placed = vectors.mapInArrow(lambda b: _assigned(b, shared.value), f"vec {kind}, cluster int, distance long")
    return placed.withColumnRenamed("vec", id), centroids


def summary(placed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Per cluster that has vectors: ``cluster_inertia``, ``inertia`` (of all clusters) and ``centroid_sha256``; one row per cluster."""
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    whole = sum(int(r.inertia) for r in sums)

    def held(n: int) -> int | None:
        return n if n < 1 << 63 else None

    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(r.cluster, held(int(r.inertia)), held(whole), names[r.cluster]) for r in sums]
    return placed.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
