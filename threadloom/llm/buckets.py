"""Exact links inside hash buckets, without listing pairs.

Items carry one hash per band (or table). Items that share a hash in a
band meet in a bucket; a pair is compared in the first band it
shares and nowhere else, so its link counts once. Buckets with the same members as
another are dropped but the first. A bucket larger than a block is dealt out as pairs of
blocks, so no task ever holds more than two blocks, whatever the bucket's size. A
group gives back one row per linked item: the weight of the items it
links to, and the least item it is connected to inside the group. The pairs themselves never
become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.components import connected_components
from threadloom.session import stage

GROUP = ["band", "key", "low", "high"]

#: (payloads left, payloads right, candidate matrix) to the matrix of links among the candidates.
Verify = Callable[[list, list, np.ndarray], np.ndarray]


def bucket_members(items: DataFrame, block: int, block_size: int) -> DataFrame:
    """``(band, key, low, high, id)``: for every pair of blocks of a bucket, the items of both."""
    keyed = items.select("id", "size", F.posexplode("keys").alias("band", "key"))
    buckets = keyed.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"),
        F.bit_xor(F.xxhash64("id")).alias("_x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("_y"),
    ).where("n > 1")
    kept = buckets.groupBy("n", "_x", "_y").agg(F.min(F.struct("band", "key")).alias("_first"), F.first("total").alias("total"))
    kept = kept.select(
        "_first.band", "_first.key", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / block_size)).cast("int").alias("blocks")
    )
    members = keyed.select("band", "key", "id").join(kept, ["band", "key"])
    own = F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int")
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return members.select("band", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal group columns in sorted batches, whole across batches."""
    held: list[pa.RecordBatch] = []

    def head(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(c)[at].as_py() for c in GROUP)

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for c in GROUP:
            x = batch.column(c).to_numpy()
            change |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if held and (start or head(held[-1], 0) != head(batch, 0)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def _roots(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least position each position is connected to; positions are in the order of ids."""
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[left], root[right])
        after = root.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        np.minimum.at(after, root[left], low)
        np.minimum.at(after, root[right], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def group_links(group: pa.Table, load: Callable[[pa.ChunkedArray], list], verify: Verify) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Linked ids of one pair of blocks, the weight each links to, the least id each is connected to."""
    ids = group["id"].to_numpy()
    order = np.argsort(ids)
    ids, group = ids[order], group.take(pa.array(order))
    band, low, high = (group[c][0].as_py() for c in ("band", "low", "high"))
    own, weight = group["own"].to_numpy(), group["weight"].to_numpy()
    keys = pc.list_flatten(group["keys"]).to_numpy().reshape(len(ids), -1)
    a, b = (np.flatnonzero(own == x) for x in (low, high))
    if not len(a) or not len(b):
        return None
    candidates = np.ones((len(a), len(b)), bool) if low != high else np.triu(np.ones((len(a), len(a)), bool), 1)
    for earlier in range(band):
        candidates &= keys[a, earlier][:, None] != keys[b, earlier][None, :]
    if not candidates.any():
        return None
    data = load(group["data"])
    found_a, found_b = np.nonzero(verify([data[i] for i in a], [data[i] for i in b], candidates))
    if not len(found_a):
        return None
    left, right = a[found_a], b[found_b]
    linked = np.bincount(left, weights=weight[right], minlength=len(ids)) + np.bincount(right, weights=weight[left], minlength=len(ids))
    at = np.flatnonzero(linked)
    return ids[at], linked[at].astype(np.int64), ids[_roots(ids, left, right)[at]]


def linked_items(
    items: DataFrame, payload: Callable[[DataFrame], DataFrame], load: Callable[[pa.ChunkedArray], list], verify: Verify,
    block: int, block_size: int,
) -> DataFrame:
    """``(id, linked, component)`` of every item with a link.

    ``items``: a written table of ``id``, ``weight``, ``size`` and ``keys``, ids without repeats. ``payload`` takes the items
    that stand in some bucket, a table of ``id``, and gives ``id`` and ``data``, which ``load`` and ``verify`` understand.
    """
    members = stage(bucket_members(items, block, block_size))
    needed = members.select("id").distinct()
    rich = members.join(items.select("id", "weight", "keys").join(payload(needed), "id"), "id")
    spread = rich.repartition(*GROUP).sortWithinPartitions(*GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            found = group_links(group, load, verify)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["id", "linked", "root"])

    links = stage(spread.mapInArrow(run, "id long, linked long, root long"))
    counts = links.groupBy("id").agg(F.sum("linked").alias("linked"))
    components = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    return counts.join(components.withColumnRenamed("node", "id"), "id")
