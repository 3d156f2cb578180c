"""Queries of a table in texts by prints of windows.

A print is a polynomial over the characters of a window, taken from running sums, so all windows of one length cost a few array operations. A
bitmap of fixed size holds the prints of all queries, and those of their starts of 1, 2, 4, 8 ... characters: a place is asked for the lengths from
8 to 15 only where 8 characters are the start of some query of such a length. What passes by chance is no query, which the join by equality finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import bitmaps
from threadloom.session import stage

#: Bytes of text at a time, or one longer text whole: a character takes some sixty bytes of arrays here.
SLICE = 1 << 20

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Windows(NamedTuple):
    """A table of queries: the few of a block as a list, or their lengths and bitmap."""

    queries: DataFrame
    few: list[str] | None
    sizes: list[int]
    bitmap: np.ndarray | None


def windows_of(queries: DataFrame, block_queries: int, block_chars: int) -> Windows:
    """``queries`` (column ``query``, no repeats) written once; as a list where they are as few as a block takes."""
    asked = stage(queries.select("query"))
    n, chars = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("query")), F.lit(0))).first()
    if n <= block_queries and chars <= block_chars:
        return Windows(asked, [r.query for r in asked.collect()], [], None)
    # Different lengths: as many as the root of twice the characters at most.
    sizes = sorted(r.n for r in asked.select(F.length("query").alias("n")).distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "query"):
                yield pa.RecordBatch.from_arrays([pa.array(_prints_of_queries(part.column("query")).view(np.int64))], ["h"])

    return Windows(asked, None, sizes, bitmaps.built(asked.mapInArrow(run, "h long")))


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Characters:
    """The characters of texts, one text after another."""

    def __init__(self, texts: pa.Array):
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.text = "".join(texts.to_pylist())
        codes = np.frombuffer(self.text.encode("utf-32-le"), "<u4").astype(np.uint64)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_spread(codes + np.uint64(1)) * _powers(BASE, len(codes)))])
        self.back = _powers(INVERSE, len(codes))

    def prints(self, at: np.ndarray, size: np.ndarray | int, role: int) -> np.ndarray:
        """Prints of the windows of ``size`` characters from these places on; ``role`` 0 for queries, a class for starts of its queries."""
        with np.errstate(over="ignore"):
            window = (self.sums[at + size] - self.sums[at]) * self.back[at]
            return _spread(_spread(window) + np.asarray(size).astype(np.uint64) + np.uint64(role << 40))


def _prints_of_queries(queries: pa.Array) -> np.ndarray:
    chars = Characters(queries)
    sizes = chars.ends - chars.starts
    out = [chars.prints(chars.starts, sizes, 0)]
    classes = np.frexp(sizes)[1] - 1
    for c in np.unique(classes):
        out.append(chars.prints(chars.starts[classes == c], 1 << int(c), 1))
    return np.concatenate(out)


def first_windows(texts: pa.Array, sizes: list[int], bitmap: np.ndarray) -> Iterator[list[tuple[str, int]]]:
    """For every text the different windows that may be queries, with the place of the first of each."""
    chars = Characters(texts)
    rest = np.repeat(chars.ends, chars.ends - chars.starts) - np.arange(len(chars.back))
    at, of = [], []
    classes: dict[int, list[int]] = {}
    for size in sizes:
        classes.setdefault(size.bit_length() - 1, []).append(size)
    for c, inside in classes.items():
        near = np.flatnonzero(rest >= inside[0])
        near = near[bitmaps.holds(bitmap, chars.prints(near, 1 << c, 1))]
        for size in inside:
            near = near[rest[near] >= size]
            if not len(near):
                break
            at.append(near[bitmaps.holds(bitmap, chars.prints(near, size, 0))])
            of.append(np.full(len(at[-1]), size))
    at, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, of))
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    bounds = np.searchsorted(at, chars.starts), np.searchsorted(at, chars.ends)
    text, starts = chars.text, chars.starts.tolist()
    for start, low, high in zip(starts, *(b.tolist() for b in bounds)):
        found: dict[str, int] = {}
        for p, size in zip(at[low:high].tolist(), of[low:high].tolist()):
            found.setdefault(text[p : p + size], p - start)
        yield list(found.items())
