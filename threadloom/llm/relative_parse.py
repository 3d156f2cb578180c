"""Substring dedup by relative Lempel-Ziv parsing against the texts of smaller ids.

A text is parsed into factors, stretches of words that an indexed reference text holds too; factors of ``width`` words or more are
duplicate spans. The reference is the whole corpus, dealt into blocks by anchors: of every ``width`` consecutive words the
phrase of ``ANCHOR`` words with the least hash is the window's anchor, and all windows a place is the anchor of make up one stretch.
Equal windows have equal anchors, so a stretch needs to be held against the block of its anchor and no other.
A block's index holds each different stretch once, with the least id that has it.

* A stretch whose entry has a smaller id continues the factor whole.
* Where the reference has the anchor but goes on in other words, a factor ends: each window at this boundary is looked up by itself in the
  block, as the contract of exact windows asks.
* Stretches whose anchor stands in one text only start no factor.

Blocks hold hashes and ids only, and are built by aggregation with combining in the tasks, so a passage that a third of all texts
share costs one row per task, and its boundaries a row per window. No group of texts ever meets in a task.

Defined results: words are runs of characters other than space, tab, line feed, vertical tab, form feed, carriage return; a null
text has none. Texts of equal ids are not compared with each other. A text with a null id is compared with none and stays
whole. Repeated rows are parsed alike and all returned. Texts under ``width`` words stay whole. Columns of other names are ignored.
An empty table gives no rows. Stretches and windows are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import phrase_filter
from threadloom.llm.text import Coded, coded_words, hashes_of, mixed, slices, texts_of
from threadloom.session import stage

#: Bytes of text at a time: a word takes some hundred bytes of arrays here.
SLICE = 1 << 20

#: Words of an anchor. Longer ones stand in fewer texts by chance, shorter ones make fewer stretches.
ANCHOR = 16

BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Rolling:
    """Hashes of any stretch of words of a slice from prefix sums."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, UNBASE)]), dtype=np.uint64)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[start + length] - self.sums[start]) * self.down[start] + np.asarray(length, np.uint64))


class Stretches(NamedTuple):
    """Windows of one anchor place: row of the text, first window (in its text), number of windows, anchor and hash of all their words."""

    row: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    print: np.ndarray


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` consecutive values the place of the least, the first of equals."""
    out = np.empty(max(0, len(values) - width + 1), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(values, width) if len(out) else values
    for a in range(0, len(out), 1 << 16):
        part = view[a : a + (1 << 16)]
        out[a : a + len(part)] = part.argmin(axis=1) + np.arange(a, a + len(part))
    return out


def stretches_of(words: Coded, width: int, anchor: int) -> Stretches:
    n, counts = len(words.code), words.counts
    if n < width:
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none, none, none)
    word_hash = hashes_of(words.distinct)[words.code]
    rolling = Rolling(word_hash)
    phrase = rolling.of(np.arange(n - anchor + 1), anchor)
    ends = np.cumsum(counts)
    start_of = np.repeat(ends - counts, counts)
    whole = np.arange(n - width + 1) + width <= np.repeat(ends, counts)[: n - width + 1]
    place = least_places(phrase, width - anchor + 1)
    window = np.flatnonzero(whole)
    place = place[window]
    if not len(window):
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none, none, none)
    change = np.concatenate([[True], (place[1:] != place[:-1]) | (start_of[window[1:]] != start_of[window[:-1]])])
    first = np.flatnonzero(change)
    windows = np.diff(np.concatenate([first, [len(window)]]))
    at, first = place[first], window[first]
    with np.errstate(over="ignore"):
        whole_print = mixed(rolling.of(first, windows + (width - 1)) + mixed((at - first) * 4096 + windows))
    return Stretches(words.rows[first], first - start_of[first], windows, phrase[at], whole_print)


def _keyed(documents: DataFrame, id: str, text: str) -> DataFrame:
    """``doc``, ``key`` (of id and text) and ``text`` of every row."""
    return documents.select(F.col(id).alias("doc"), F.xxhash64(id, text).alias("key"), F.col(text).alias("text"))


def anchors_of(texts: DataFrame, width: int, anchor: int) -> DataFrame:
    """``h`` and ``doc`` of every anchor of ``(doc, key, text)``, once per slice and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            found = stretches_of(coded_words(texts_of(part)), width, anchor)
            order = np.lexsort((found.row, found.anchor))
            row, h = found.row[order], found.anchor[order]
            at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else order
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), part.column("doc").take(pa.array(row[at]))], ["h", "doc"])

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.where("doc is not null").select("doc", "text").mapInArrow(run, f"h long, doc {kind}")


def stretches_in(texts: DataFrame, width: int, anchor: int, live: np.ndarray) -> DataFrame:
    """``doc``, ``key``, ``first``, ``windows``, ``anchor`` and ``print`` of the stretches whose anchor may be in ``live``."""
    shared = texts.sparkSession.sparkContext.broadcast(live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            found = stretches_of(coded_words(texts_of(part)), width, anchor)
            at = np.flatnonzero(phrase_filter.holds(shared.value, found.anchor))
            row = pa.array(found.row[at])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc").take(row), part.column("key").take(row), pa.array(found.first[at]), pa.array(found.windows[at]),
                    pa.array(found.anchor[at].view(np.int64)), pa.array(found.print[at].view(np.int64)),
                ],
                ["doc", "key", "first", "windows", "anchor", "print"],
            )

    kind = texts.schema["doc"].dataType.simpleString()
    return texts.where("doc is not null").mapInArrow(run, f"doc {kind}, key long, first long, windows long, anchor long, print long")


def boundary_windows(edges: DataFrame, width: int, shared_windows: np.ndarray | None) -> DataFrame:
    """``doc``, ``key``, ``first``, ``anchor`` and ``print`` of the windows named in ``parts``, or of those whose print may be in ``shared_windows``."""
    shared = edges.sparkSession.sparkContext.broadcast(shared_windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            words = coded_words(texts_of(part))
            if not len(words.code):
                continue
            rolling = Rolling(hashes_of(words.distinct)[words.code])
            lists = part.column("parts")
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            first, windows, anchor = (flat.field(c).to_numpy() for c in ("first", "windows", "anchor"))
            which = np.repeat(np.arange(len(row)), windows)
            start = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
            prints = rolling.of((np.cumsum(words.counts) - words.counts)[row[which]] + start, width)
            if shared.value is not None:
                at = np.flatnonzero(phrase_filter.holds(shared.value, prints))
                which, start, prints = which[at], start[at], prints[at]
            rows = pa.array(row[which])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc").take(rows), part.column("key").take(rows), pa.array(start), pa.array(anchor[which]), pa.array(prints.view(np.int64))],
                ["doc", "key", "first", "anchor", "print"],
            )

    kind = edges.schema["doc"].dataType.simpleString()
    return edges.mapInArrow(run, f"doc {kind}, key long, first long, anchor long, print long")


def _among(texts: DataFrame, keys: np.ndarray, wanted: bool) -> DataFrame:
    """Rows whose key may be in the bitmap, or the others, before anything is shuffled."""
    shared = texts.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(phrase_filter.holds(shared.value, batch.column("key").to_numpy()) == wanted))

    return texts.mapInArrow(run, texts.schema)


def duplicate_spans(documents: DataFrame, width: int = 50, anchor: int = ANCHOR, bits: int = 27, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``key`` and ``spans`` (first word, end) of every text that has words to remove; spans may overlap."""
    texts = _keyed(documents, id, text)
    # Anchors that stand in texts of two ids: only there can a factor start.
    twice = anchors_of(texts, width, anchor).groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    placed = stage(stretches_in(texts, width, anchor, phrase_filter.built(twice.select("h"), bits)))
    index = stage(placed.groupBy("anchor", "print").agg(F.min("doc").alias("low"), F.max("doc").alias("high")))
    split = index.groupBy("anchor").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("n > 1 and low < high")
    entries = index.where("low is not null").select("anchor", "print", "low").join(split.select("anchor", F.lit(True).alias("goes_on")), "anchor", "left")
    found = placed.join(entries, ["anchor", "print"]).withColumn("whole", F.col("doc") > F.col("low"))
    found = stage(found.where("whole or goes_on").select("doc", "key", "first", "windows", "anchor", "whole"))

    ends = found.where("not whole").groupBy("doc", "key").agg(F.collect_list(F.struct("first", "windows", "anchor")).alias("parts"))
    ends = stage(ends)
    near = _among(texts, phrase_filter.built(ends.select(F.col("key").alias("h"))), True)
    edges = stage(near.join(ends, ["doc", "key"]).dropDuplicates(["doc", "key"]))
    windows = boundary_windows(edges, width, None)
    held = windows.groupBy("anchor", "print").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    held = stage(held.select("anchor", "print", "low"))
    again = boundary_windows(edges, width, phrase_filter.built(held.select(F.col("print").alias("h")), bits))
    single = again.join(held, ["anchor", "print"]).where(F.col("doc") > F.col("low"))

    span = F.struct(F.col("first").alias("start"), (F.col("first") + F.col("windows") + (width - 1)).alias("end"))
    factors = found.where("whole").select("doc", "key", span.alias("span"))
    windows = single.select("doc", "key", F.struct(F.col("first").alias("start"), (F.col("first") + width).alias("end")).alias("span"))
    return factors.unionAll(windows).groupBy("doc", "key").agg(F.collect_list("span").alias("spans"))


def _without(batches: Iterator[pa.RecordBatch], id: str) -> Iterator[pa.RecordBatch]:
    """Texts as words joined by one space, without the words in their spans."""
    for part in slices(batches, "text", SLICE):
        words = coded_words(texts_of(part))
        ends = np.cumsum(words.counts)
        kept = np.ones(len(words.code), bool)
        if "spans" in part.schema.names:
            lists = part.column("spans")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offset = np.repeat(ends - words.counts, sizes)
            flat = lists.flatten()
            turn = np.zeros(len(kept) + 1, np.int64)
            np.add.at(turn, offset + flat.field("start").to_numpy(), 1)
            np.add.at(turn, offset + flat.field("end").to_numpy(), -1)
            kept = np.cumsum(turn[:-1]) == 0
        left = np.bincount(words.rows[kept], minlength=part.num_rows)
        flat = words.distinct.take(pa.array(words.code[kept])).cast(pa.large_string())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()), flat)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc"), pa.array(words.counts), pa.array(words.counts - left), pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())],
            [id, "n_words", "n_removed", "kept"],
        )


def without_duplicates(documents: DataFrame, width: int = 50, anchor: int = ANCHOR, bits: int = 27, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space) of every row.

    Only texts with words to remove are shuffled.
    """
    spans = stage(duplicate_spans(documents, width, anchor, bits, id, text))
    texts = _keyed(documents, id, text)
    keys = phrase_filter.built(spans.select(F.col("key").alias("h")))
    schema = f"`{id}` {texts.schema['doc'].dataType.simpleString()}, n_words long, n_removed long, kept string"
    touched = _among(texts, keys, True).join(spans, ["doc", "key"], "left")
    others = _among(texts, keys, False)
    return touched.mapInArrow(lambda b: _without(b, id), schema).unionAll(others.mapInArrow(lambda b: _without(b, id), schema))
