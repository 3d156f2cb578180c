"""N-gram Jaccard join: MinHash banding, with exact verification on full n-gram sets.

Texts with equal sets of word n-grams form a class; only one text per class is
compared. A class has a signature of minimum hashes cut into bands, whose number and height follow
from the threshold and the wanted recall. Classes that share a band are candidates,
and a candidate counts when the Jaccard similarity of the two full sets reaches the
threshold. The sets of classes without a candidate are never moved.

Words are runs of characters between white space, compared as they are. A text with fewer words
than ``width`` has one n-gram, all its words.

Defined results: a null or empty text has no n-grams and links with nothing.
Repeated rows, also with equal ids, are documents of their own that link with
each other. A null id never names a class unless it is the only one there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.buckets import linked_items
from threadloom.llm.text import coded_words, mixed, slices, texts_of
from threadloom.session import stage

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128


def choose_bands(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows per band: the tallest bands that find a pair at the threshold with the wanted recall.

    A pair of similarity s shares a band of r rows with probability s**r, so b bands miss it with
    (1 - s**r)**b. Taller bands let fewer unlike pairs through.
    """
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows > max_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no banding of so few hashes reaches this recall")
    return best


def text_grams(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words = coded_words(texts)
    if not len(words.code):
        return [np.zeros(0, np.uint64)] * len(texts)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.distinct.to_pylist()), np.uint64, len(words.distinct))[words.code]
    factors = mixed(np.arange(1, width + 1)) | np.uint64(1)
    grams = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for k in range(width):
            grams += hashes[k : k + len(grams)] * factors[k]
        grams = mixed(grams)
        for n in words.counts.tolist():
            if n >= width:
                out.append(np.unique(grams[at : at + n - width + 1]))
            elif n:
                out.append(mixed(np.array([np.sum(hashes[at : at + n] * factors[:n]) + np.uint64(n)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def set_prints(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets, and a 64-bit fingerprint of each; the empty set has 0."""
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    full = np.flatnonzero(sizes)
    prints = np.zeros(len(grams), np.uint64)
    if len(full):
        starts = np.cumsum(sizes[full]) - sizes[full]
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mixed(np.concatenate([grams[i] for i in full]) ^ np.uint64(0xABCD)), starts)
        prints[full] = mixed(sums ^ mixed(sizes[full]))
    return sizes, prints


def _signatures(batches: Iterator[pa.RecordBatch], others: list[str], text: str, width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20240229)
    factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    for part in slices(batches, text):
        grams = text_grams(texts_of(part, text), width)
        sizes, prints = set_prints(grams)
        full = np.flatnonzero(sizes)
        keys = np.zeros((len(grams), bands), np.uint64)
        if len(full):
            flat, starts = np.concatenate([grams[i] for i in full]), np.cumsum(sizes[full]) - sizes[full]
            with np.errstate(over="ignore"):
                for band in range(bands):
                    key = np.zeros(len(full), np.uint64)
                    for p in range(band * rows, (band + 1) * rows):
                        key = mixed(key) + np.minimum.reduceat(flat * factors[p] + shifts[p], starts)
                    keys[full, band] = mixed(key)
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in others), pa.array(prints.view(np.int64), mask=sizes == 0), pa.array(sizes), lists], [*others, "id", "size", "keys"]
        )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        grams = text_grams(texts_of(part), width)
        _, prints = set_prints(grams)
        yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array([g.tobytes() for g in grams], pa.binary())], ["id", "data"])


def load_sets(data: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in data.to_pylist()]


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one side with all of the other, by blocks of a sparse 0/1 product."""
    sizes = np.fromiter(map(len, [*left, *right]), np.int64)
    _, column, uses = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = uses[column] > 1
    renumbered = np.cumsum(uses > 1) - 1
    row, column = row[shared], renumbered[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    step, total = 4096, int((uses > 1).sum())
    for start in range(0, total, step):
        lo, hi = np.searchsorted(column, [start, start + step])
        dense = np.zeros((len(sizes), min(step, total - start)), np.float32)
        dense[row[lo:hi], column[lo:hi] - start] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def jaccard_links(left: list[np.ndarray], right: list[np.ndarray], candidates: np.ndarray, threshold: float) -> np.ndarray:
    rows, columns = np.flatnonzero(candidates.any(axis=1)), np.flatnonzero(candidates.any(axis=0))
    a, b = [left[i] for i in rows], [right[i] for i in columns]
    if len(a) * len(b) == 1:
        common = np.array([[len(np.intersect1d(a[0], b[0], assume_unique=True))]], np.float64)
    else:
        common = common_counts(a, b).astype(np.float64)
    union = np.fromiter(map(len, a), np.float64)[:, None] + np.fromiter(map(len, b), np.float64)[None, :] - common
    out = np.zeros_like(candidates)
    out[np.ix_(rows, columns)] = common >= threshold * union - 1e-9
    return out & candidates


def classed_documents(
    documents: DataFrame, id: str = "doc_id", text: str = "text", also: dict[str, Column] | None = None, width: int = WIDTH,
    threshold: float = THRESHOLD, recall: float = RECALL, block: int = 128, block_grams: int = 1_000_000,
) -> DataFrame:
    """``doc`` (the id), ``class_id`` (least id reachable by links), ``n_links``, ``member`` and ``first`` of every row of ``documents``.

    ``member`` is a struct of whether the id is null, the id, and the columns that ``also`` computes to tell rows apart;
    ``first`` is the least member of the row's group, null for a text without n-grams.
    """
    bands, rows = choose_bands(threshold, recall)
    also = also or {}
    narrow = documents.select(F.col(id).alias("doc"), F.col(text).alias("text"), *(c.alias(f"_{n}") for n, c in also.items()))
    passed = ["doc", *(f"_{n}" for n in also)]
    member = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", *(F.col(f"_{n}").alias(n) for n in also))
    fields = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in passed)
    signed = stage(
        narrow.mapInArrow(lambda b: _signatures(b, passed, "text", width, bands, rows), f"{fields}, id long, size long, keys array<long>")
    )
    items = stage(
        signed.where("id is not null").groupBy("id")
        .agg(F.count("*").alias("weight"), F.min(member).alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    )

    def payload(needed: DataFrame) -> DataFrame:
        wanted = items.select("id", "least.doc").join(needed, "id", "left_semi").select("doc").distinct()
        texts = narrow.join(wanted.withColumnRenamed("doc", "_wanted"), F.col("doc").eqNullSafe(F.col("_wanted")), "left_semi")
        sets = texts.select("text").mapInArrow(lambda b: _sets(b, width), "id long, data binary")
        return sets.groupBy("id").agg(F.first("data").alias("data"))

    found = stage(linked_items(items, payload, load_sets, lambda a, b, c: jaccard_links(a, b, c, threshold), block, block_grams))
    linked = items.select("id", "least", "weight").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = linked.groupBy("component").agg(F.min("least").alias("first"))
    classes = stage(
        linked.join(names, "component")
        .select("id", "first", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    )
    return signed.select(*passed, "id").join(classes, "id", "left").select(
        "doc", F.coalesce("first.doc", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        member.alias("member"), "first",
    )


def near_duplicates(documents: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``id``, ``class_id`` (least id reachable by links) and ``n_links`` of every row of ``documents``; options as above."""
    return classed_documents(documents, id, text, **options).select(F.col("doc").alias(id), "class_id", "n_links")
