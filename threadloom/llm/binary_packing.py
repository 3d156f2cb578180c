"""Packed binary token output: best-fit decreasing with a segment tree over free capacity.

Texts become token ids with an end mark. A text longer than a sequence is cut into
pieces without loss. Every task packs its own texts in windows of bounded
token count: pieces in falling length, each into the fullest sequence that still
holds it, which the segment tree finds in logarithmic time. A row of the output is one row of the id matrix, padded to
``length``, with the cumulative lengths of its segments and positions that start
anew at each segment. Nothing is shuffled, and a lost task packs the same again.

Defined results: a null text counts as empty, an empty text is its end mark
alone. Repeated rows are packed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from threadloom.llm import vocabularies
from threadloom.llm.text import slices, texts_of


class CapacityTree:
    """Counts of open sequences by free capacity; finds the least capacity that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, n: int) -> None:
        at = free + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, needed: int) -> int:
        """The smallest capacity of at least ``needed`` that an open sequence has, or -1."""
        at = needed + self.leaves
        if self.count[at]:
            return needed
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``lengths`` by sequence. Equal lengths keep their order."""
    tree, open_by_free, packed = CapacityTree(capacity), [[] for _ in range(capacity + 1)], []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[item]
        free = tree.least(n)
        if free < 0:
            sequence, free = len(packed), capacity
            packed.append([])
        else:
            sequence = open_by_free[free].pop()
            tree.add(free, -1)
        packed[sequence].append(item)
        open_by_free[free - n].append(sequence)
        tree.add(free - n, 1)
    return packed


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """Start and stop of the pieces of ``n`` tokens: whole sequences, but the first piece may be shorter."""
    first = n % length or length
    return [(0, n)] if n <= length else [(0, first), *((s, s + length) for s in range(first, n, length))]


def pack(
    documents: DataFrame, vocabulary: str, length: int = 2048, end: int = 2, window_tokens: int = 8_000_000, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per sequence.

    ``sequence_id``, ``n_tokens``, ``cu_seqlens`` (0, then the end of every segment), ``ids`` of the documents of the segments,
    ``pieces`` (the number of each piece in its document), ``input_ids`` and ``position_ids`` (little-endian unsigned 16-bit, ``length`` of
    each, padded with 0). Vocabularies of more than 65,536 ids are refused.
    """
    shared = vocabularies.share_file(documents.sparkSession, vocabulary)
    kind = documents.schema[id].dataType.simpleString()

    def rows(window: list, task: int, done: int) -> pa.RecordBatch:
        packed = best_fit_decreasing([len(piece) for _, _, piece in window], length)
        matrix = np.zeros((len(packed), length), "<u2")
        positions = np.zeros((len(packed), length), "<u2")
        count = np.arange(length, dtype="<u2")
        ends, documents, pieces = [], [], []
        for r, members in enumerate(packed):
            at, bounds = 0, [0]
            for m in members:
                piece = window[m][2]
                matrix[r, at : at + len(piece)] = piece
                positions[r, at : at + len(piece)] = count[: len(piece)]
                at += len(piece)
                bounds.append(at)
            ends.append(bounds)
            documents.append([window[m][0] for m in members])
            pieces.append([window[m][1] for m in members])
        return pa.RecordBatch.from_arrays(
            [
                pa.array((task << 40) + done + np.arange(len(packed))), pa.array([b[-1] for b in ends], pa.int32()), pa.array(ends, pa.list_(pa.int32())),
                pa.array(documents, pa.list_(id_type)), pa.array(pieces, pa.list_(pa.int32())),
                pa.array([x.tobytes() for x in matrix], pa.binary()), pa.array([x.tobytes() for x in positions], pa.binary()),
            ],
            ["sequence_id", "n_tokens", "cu_seqlens", "ids", "pieces", "input_ids", "position_ids"],
        )

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(documents.schema[id].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabularies.worker_copy("byte level", shared.value, vocabularies.ByteLevelEncoder)
        if encoder.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        task, done, window, held = TaskContext.get().partitionId(), 0, [], 0
        for part in slices(batches, text):
            for doc, found in zip(part.column(id).to_pylist(), encoder.encode(texts_of(part, text))):
                marked = np.append(found, end).astype("<u2")
                for n, (start, stop) in enumerate(cut(len(marked), length)):
                    if held + stop - start > window_tokens and window:
                        out = rows(window, task, done)
                        done, window, held = done + out.num_rows, [], 0
                        yield from _small(out)
                    window.append((doc, n, marked[start:stop]))
                    held += stop - start
        if window:
            yield from _small(rows(window, task, done))

    return documents.select(id, text).mapInArrow(
        run,
        f"sequence_id long, n_tokens int, cu_seqlens array<int>, ids array<{kind}>, pieces array<int>, input_ids binary, position_ids binary",
    )


def _small(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
