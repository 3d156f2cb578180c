"""Arrow and numpy helpers of the text operators: bounded slices, coded words, ragged arrays.

A slice holds at most ``SLICE_BYTES`` of text, or one longer text whole, so a
task's memory follows the longest text and not the batch size.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20


def process_state() -> dict:
    """What this Python worker keeps between tasks (parsed vocabularies, encoded words)."""
    return sys.modules.setdefault("threadloom_process_state", types.ModuleType("threadloom_process_state")).__dict__


def passed_on(frame: DataFrame, made: str, without: str = "") -> tuple[list[str], T.StructType]:
    """Columns of ``frame`` that a step passes on, and the schema of these and the ``made`` ones.

    A made column takes the place of a given one of the same name; ``without`` is left out.
    """
    fields = T.StructType.fromDDL(made).fields
    taken = {f.name.lower() for f in fields} | {without.lower()}
    kept = [f for f in frame.schema.fields if f.name.lower() not in taken]
    return [f.name for f in kept], T.StructType([*kept, *fields])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts with 64-bit offsets; null becomes empty."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


class Coded(NamedTuple):
    """Parts of texts as codes into their distinct values."""

    counts: np.ndarray
    code: np.ndarray
    distinct: pa.Array

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def coded(lists: pa.Array, keep_empty: bool = True) -> Coded:
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    counts = np.diff(offsets)
    if not keep_empty:
        keep = pc.greater(pc.binary_length(flat), 0)
        flags = keep.to_numpy(zero_copy_only=False)
        if not flags.all():
            seen = np.concatenate([[0], np.cumsum(flags)])
            counts, flat = np.diff(seen[offsets]), flat.filter(keep)
    encoded = flat.dictionary_encode()
    return Coded(counts, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary)


def coded_words(texts: pa.Array) -> Coded:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed, carriage return."""
    return coded(pc.ascii_split_whitespace(texts), keep_empty=False)


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; ``counts`` may hold zeros."""
    out = np.zeros((len(counts), *values.shape[1:]), dtype=values.dtype)
    full = counts > 0
    if full.any():
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """``flat[s : s + n]`` for each start and length, one after another."""
    if not len(starts):
        return flat[:0]
    ends = np.cumsum(lengths)
    return flat[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)]


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads integers over all 64 bits, one to one."""
    x = values.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes_of(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of strings with 64-bit offsets: mixed bytes and places, summed up."""
    sizes = pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return np.zeros(0, np.uint64)
    data = bytes_of(strings)
    ends = np.cumsum(sizes)
    place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    sums = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        with np.errstate(over="ignore"):
            sums[full] = np.add.reduceat(mixed(mixed(place + 1 + (seed << 48)) + data), (ends - sizes)[full])
    return mixed(sums + sizes.astype(np.uint64))


def offsets_of(strings: pa.Array) -> np.ndarray:
    return np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8)


def bytes_of(strings: pa.Array) -> np.ndarray:
    offsets, data = offsets_of(strings), strings.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)


class EncodingTable:
    """Integer encodings of distinct strings, computed once while this worker remembers them.

    ``encode`` maps a list of strings to (lengths, flat values). The table is
    dropped whole once it holds ``limit`` strings or ``limit_chars``
    characters, and filled anew: memory stays bounded, results do not change.
    """

    def __init__(
        self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 300_000, limit_chars: int = 16 << 20
    ):
        self.encode, self.limit, self.limit_chars = encode, limit, limit_chars
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.ends, self.flat = np.zeros(1, np.int64), None

    def lookup(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and lengths in the third array, for distinct strings."""
        if len(self.index) >= self.limit or self.chars >= self.limit_chars:
            self.clear()
        get = self.index.get
        at = np.fromiter((get(s, -1) for s in strings), np.int64, len(strings))
        missing = np.flatnonzero(at < 0)
        if len(missing) or self.flat is None:
            new = [strings[i] for i in missing]
            lengths, flat = self.encode(new)
            known = len(self.index)
            at[missing] = known + np.arange(len(new))
            self.index.update(zip(new, range(known, known + len(new))))
            self.chars += sum(map(len, new))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths, dtype=np.int64)])
            self.flat = flat if self.flat is None else np.concatenate([self.flat, flat])
        return self.ends[at], self.ends[at + 1] - self.ends[at], self.flat
