"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Vectors are compared only under equal labels. In each table a vector falls
into the bucket of its signs against random hyperplanes; vectors that share a bucket in
some table are compared by cosine in double precision. The number of signs follows the
logarithm of the distinct vectors of the largest label, and the number of tables follows the signs so that the recall stays:
tables grow with about the power 0.18 of the rows at 0.93, so work grows with a power of 1.2 and more where unlike vectors
are not far apart, and with the pairs that are near each other. Equal vectors form a class that is
hashed and compared once, so a vector that a third of all rows repeat costs
one row. Hyperplanes are drawn from a fixed seed per dimension, so every task has the same.

Defined results: a vector without label, null, empty, of length zero, or with a null or non-finite
component links with nothing and is its own component. Vectors of different
dimension never link. Repeated rows link with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.buckets import linked_items
from threadloom.llm.text import mixed
from threadloom.session import stage

#: Signs on top of the logarithm of the vectors of a label: 2 ** -SPARE unlike vectors share a bucket with a vector, on average.
SPARE = 8
MISS = 1e-4
#: Products with hyperplanes held at once by a task.
CELLS = 1 << 21


def signs_for(count: int) -> int:
    """Signs per table for ``count`` distinct vectors under one label, so that buckets of unlike vectors do not grow with it."""
    return max(1, math.ceil(math.log2(max(count, 1)))) + SPARE


def tables_for(threshold: float, signs: int, miss: float = MISS) -> int:
    """Tables after which a pair at the threshold is missed with probability ``miss``.

    Two vectors at angle a agree in one sign with probability 1 - a / pi.
    """
    agree = (1 - math.acos(threshold) / math.pi) ** signs
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def usable(vector: str) -> F.Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by powers of two first, so that no square over- or underflows."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    scaled = np.ldexp(vectors, -exponent)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _hashed(batches: Iterator[pa.RecordBatch], tables: int, signs: int, seed: int) -> Iterator[pa.RecordBatch]:
    powers = 1 << np.arange(signs, dtype=np.int64)
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        lists, label = batch.column("vector"), batch.column("label").to_numpy()
        sizes = pc.list_value_length(lists).to_numpy()
        keys = np.zeros((batch.num_rows, tables), np.uint64)
        units: list = [None] * batch.num_rows
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            x = unit_rows(lists.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), d))
            if d not in planes:
                planes = {d: np.random.default_rng([seed, d]).standard_normal((d, tables * signs))}
            code = np.empty((len(rows), tables), np.int64)
            many = max(1, CELLS // (tables * signs))
            for at in range(0, len(rows), many):
                bits = x[at : at + many] @ planes[d] > 0
                code[at : at + many] = bits.reshape(-1, tables, signs) @ powers
            with np.errstate(over="ignore"):
                keys[rows] = mixed(code.astype(np.uint64) + mixed(label[rows].view(np.uint64) ^ np.uint64(d << 40))[:, None])
            for r, v in zip(rows.tolist(), x):
                units[r] = label[r].tobytes() + v.tobytes()
        flat = pa.array(keys.reshape(-1).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"), batch.column("weight"), batch.column("first"), pa.array(sizes.astype(np.int64)),
                pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), flat), pa.array(units, pa.binary()),
            ],
            ["id", "weight", "first", "size", "keys", "data"],
        )


def load_vectors(data: pa.ChunkedArray) -> list[bytes]:
    return data.to_pylist()


def cosine_links(left: list[bytes], right: list[bytes], candidates: np.ndarray, threshold: float) -> np.ndarray:
    """Candidates of equal label and dimension whose cosine reaches the threshold."""
    out = np.zeros_like(candidates)
    for kind in {(len(x), x[:8]) for x in left} & {(len(x), x[:8]) for x in right}:
        a, b = ([i for i, x in enumerate(side) if (len(x), x[:8]) == kind] for side in (left, right))
        x, y = (np.stack([np.frombuffer(side[i], np.float64, offset=8) for i in at]) for side, at in ((left, a), (right, b)))
        out[np.ix_(a, b)] = x @ y.T >= threshold
    return out & candidates


def near_vectors(
    embeddings: DataFrame, threshold: float = 0.93, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    signs: int | None = None, miss: float = MISS, block: int = 256, seed: int = 7,
) -> DataFrame:
    """``id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``embeddings``."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    given = embeddings.select(F.col(id).alias("vec"), F.col(label).cast("long").alias("label"), doubles.alias("vector"))
    given = given.withColumn("id", F.when(usable("vector") & F.col("label").isNotNull(), F.xxhash64("label", "vector")))
    if signs is None:
        sizes = given.where("id is not null").groupBy("label").agg(F.approx_count_distinct("id").alias("n"))
        signs = signs_for(sizes.agg(F.max("n")).first()[0] or 1)
    tables = tables_for(threshold, signs, miss)
    classes = given.where("id is not null").groupBy("id").agg(
        F.count("*").alias("weight"), F.min("vec").alias("first"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    kind = given.schema["vec"].dataType.simpleString()
    items = stage(
        classes.mapInArrow(
            lambda b: _hashed(b, tables, signs, seed), f"id long, weight long, first {kind}, size long, keys array<long>, data binary"
        )
    )
    found = stage(
        linked_items(
            items.drop("data"), lambda needed: items.select("id", "data").join(needed, "id", "left_semi"), load_vectors,
            lambda a, b, c: cosine_links(a, b, c, threshold), block, 16_000_000,
        )
    )
    linked = items.select("id", "first", "weight").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stage(
        linked.join(names, "component")
        .select("id", "component_id", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    )
    out = given.select("vec", "id").join(named, "id", "left").select(
        F.col("vec").alias(id), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))
