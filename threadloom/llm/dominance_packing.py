"""Best-fit packing of a whole corpus after Martello-Toth dominance reduction.

Only lengths matter for packing, and there are at most ``capacity`` of them, so the
whole instance is a histogram, however large the corpus. The driver solves it in terms of "so many
sequences with this content": first it fixes sets of pieces that dominate every
other way to fill a sequence with their largest piece, for as many sequences as there are such
pieces; what remains is packed best-fit decreasing, many equal sequences at a
time. The plan has a few rows per length. Spark then numbers the pieces of each length
and looks up the place of each number in the plan.

Numbering is done in small groups (length and salt) whose sizes are summed up, so a
length that most pieces have is spread over many tasks.

Defined results: a null text counts as empty, an empty text is its end mark
alone. Repeated rows are packed one by one. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm import vocabularies
from threadloom.llm.binary_packing import CapacityTree, cut
from threadloom.llm.text import slices, texts_of
from threadloom.session import stage


class Filling(NamedTuple):
    """``sequences`` sequences, each with the given (length, copies)."""

    content: tuple[tuple[int, int], ...]
    sequences: int


def _largest(count: list[int], most: int) -> int:
    while most > 0 and not count[most]:
        most -= 1
    return most


def _take(count: list[int], lengths: list[int]) -> Filling:
    """Fix the set ``lengths`` as often as the remaining pieces allow."""
    copies = {n: lengths.count(n) for n in lengths}
    times = min(count[n] // k for n, k in copies.items())
    for n, k in copies.items():
        count[n] -= k * times
    return Filling(tuple(copies.items()), times)


def reduce_by_dominance(count: list[int], capacity: int) -> list[Filling]:
    """Fix dominating sets of at most three pieces; ``count`` (pieces per length) keeps the rest.

    For the largest piece of a set, with free space r beside it, a set dominates all others if the pieces of any
    other feasible set fit, in groups, into its pieces:
    nothing else fits; the largest piece k that fits fills r; at most one more piece fits, then k; at most
    two more fit, and either k is as long as any two that fit together, or k with the
    longest piece beside it is at least as long, piece by piece, as any such two.
    """
    fixed = []
    for n in range(capacity, 0, -1):
        while count[n]:
            free = capacity - n
            count[n] -= 1
            k = _largest(count, free)
            small = [m for m in range(1, free + 1) if count[m]][:3]
            least = sorted(m for m in small for _ in range(min(3, count[m])))[:3]
            count[n] += 1
            chosen = None
            if not k:
                chosen = [n]
            elif k == free or len(least) < 2 or sum(least[:2]) > free:
                chosen = [n, k]
            elif len(least) < 3 or sum(least) > free:
                pairs = _two(count, n, free)
                if not pairs or max(a + b for a, b in pairs) <= k:
                    chosen = [n, k]
                else:
                    beside = max((b for a, b in pairs if a == k), default=0)
                    if beside and all(b <= beside for _, b in pairs):
                        chosen = [n, k, beside]
            if chosen is None or any(count[m] < chosen.count(m) for m in chosen):
                break
            fixed.append(_take(count, chosen))
    return fixed


def _two(count: list[int], n: int, free: int) -> list[tuple[int, int]]:
    """For each length the longest other that fits beside it (a >= b), with one piece of ``n`` set aside."""
    count[n] -= 1
    pairs = []
    for a in range(1, free):
        if count[a]:
            count[a] -= 1
            b = _largest(count, min(a, free - a))
            count[a] += 1
            if b:
                pairs.append((a, b))
    count[n] += 1
    return pairs


def best_fit(count: list[int], capacity: int) -> list[Filling]:
    """Best-fit decreasing of the pieces in ``count``, equal sequences at a time.

    A piece goes to the fullest sequence that holds it; that sequence stays the fullest for the next piece
    of this length, so it takes as many as fit, and equal sequences take alike.
    """
    tree = CapacityTree(capacity)
    open_by_free: list[list[Filling]] = [[] for _ in range(capacity + 1)]

    def keep(filling: Filling, free: int) -> None:
        if filling.sequences:
            open_by_free[free].append(filling)
            tree.add(free, 1)

    for n in range(capacity, 0, -1):
        left = count[n]
        while left:
            free = tree.least(n)
            if free < 0:
                free, filling = capacity, Filling((), -(-left // (capacity // n)))
            else:
                filling = open_by_free[free].pop()
                tree.add(free, -1)
            each = free // n
            full = min(filling.sequences, left // each)
            rest = min(left - full * each, each) if full < filling.sequences else 0
            keep(Filling((*filling.content, (n, each)), full), free - each * n)
            if rest:
                keep(Filling((*filling.content, (n, rest)), 1), free - rest * n)
            keep(Filling(filling.content, filling.sequences - full - bool(rest)), free)
            left -= full * each + rest
    return [f for at_free in open_by_free for f in at_free if f.content]


def plan(histogram: dict[int, int], capacity: int) -> list[Filling]:
    count = [histogram.get(n, 0) for n in range(capacity + 1)]
    return [*reduce_by_dominance(count, capacity), *best_fit(count, capacity)]


def places(fillings: list[Filling]) -> dict[int, np.ndarray]:
    """Per length, rows of: first number, copies per sequence, first sequence, offset; in order of first number."""
    taken: dict[int, int] = {}
    rows: dict[int, list] = {}
    first = 0
    for filling in fillings:
        offset = 0
        for n, copies in filling.content:
            rows.setdefault(n, []).append((taken.get(n, 0), copies, first, offset))
            taken[n] = taken.get(n, 0) + copies * filling.sequences
            offset += copies * n
        first += filling.sequences
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def look_up(length: np.ndarray, number: np.ndarray, table: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece from its length and its number among the pieces of that length."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        first, copies, start, base = table[n][np.searchsorted(table[n][:, 0], number[at], side="right") - 1].T
        sequence[at] = start + (number[at] - first) // copies
        offset[at] = base + (number[at] - first) % copies * n
    return sequence, offset


def numbered(pieces: DataFrame, histogram: dict[int, int], group: int = 500) -> DataFrame:
    """``pieces`` with ``number``: 0, 1, ... among the pieces of equal ``length``."""
    spark = pieces.sparkSession
    salts = spark.createDataFrame([(n, -(-c // group)) for n, c in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length")  # at most one row per length
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), "salts")).drop("salts")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc", "piece", "ids_crc32", "start")) - 1
    return salted.withColumn("inside", inside).join(before, ["length", "salt"]).withColumn("number", F.col("before") + F.col("inside"))


def pieces_of(documents: DataFrame, vocabulary: str, capacity: int, end: int, id: str, text: str) -> DataFrame:
    """``doc``, ``piece``, ``start``, ``length`` and ``ids_crc32`` of every piece; no shuffle."""
    shared = vocabularies.share_file(documents.sparkSession, vocabulary)
    kind = documents.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabularies.worker_copy("byte level", shared.value, vocabularies.ByteLevelEncoder)
        for part in slices(batches, text):
            row, piece, start, length, crc = [], [], [], [], []
            for r, found in enumerate(encoder.encode(texts_of(part, text))):
                data = np.append(found, end).astype("<u4")
                for n, (a, b) in enumerate(cut(len(data), capacity)):
                    row.append(r)
                    piece.append(n)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[a:b]))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(id).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["doc", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select(id, text).mapInArrow(run, f"doc {kind}, piece int, start long, length long, ids_crc32 long")


def pack(
    documents: DataFrame, vocabulary: str | None = None, capacity: int = 1024, end: int = 2, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset`` of every piece."""
    pieces = stage(pieces_of(documents, vocabulary or vocabularies.default_path("byte_bpe_50k.json"), capacity, end, id, text))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    table = documents.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    found = numbered(pieces, histogram).select("doc", "piece", "start", "length", "ids_crc32", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = look_up(batch.column("length").to_numpy(), batch.column("number").to_numpy(), table.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = documents.schema[id].dataType.simpleString()
    placed = found.mapInArrow(run, f"doc {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("doc", id)
