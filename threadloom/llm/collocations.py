"""Phrase collocations by Toivonen's sampling.

A sample of the texts proposes phrases, at a lowered threshold. One full pass then counts the proposed phrases
together with their negative border: every phrase that was not proposed though its parts without the last and without the first
word were. Whatever else occurs holds an infrequent part, unless a border phrase turns out frequent. Such failures join the proposal,
and a further full pass counts only the phrases this adds. Where failures are few it is the last one: it takes whatever it counts for
frequent, so it counts longer phrases in the same pass. Where they are many, that would count too much, and passes go on until one finds no failure.

These passes count prints of phrases (two independent hashes, 93 bits), which are shorter to shuffle than phrases. The words of a
frequent print are then looked up in growing samples of the texts, each round only for prints still without words, the last in all texts.
Proposals and wanted prints travel as bitmaps of fixed size (``phrase_filter``). What slips through one is
counted needlessly, never left out, and whether a print was counted before is asked of the same bitmaps, so results do
not hang on their size. A task adds up what it counts before the shuffle, so a word
or language that a third of all rows hold costs a few rows per task.

Defined results: a null text counts as empty, a null group as ``und``. Repeated rows count each time. Texts may be of any
length; they are read whole. An empty table gives no rows. Columns other than the two named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm import phrase_filter
from threadloom.llm.text import bytes_of, hashes_of, mixed, offsets_of, slices, texts_of
from threadloom.session import stage

#: Bytes of text at a time: a word takes some hundred bytes of arrays here.
SLICE = 1 << 20

UNKNOWN = "und"

#: What a byte does: 0 belongs to a word, 1 stands between words, 2 ends a piece.
ROLE = np.zeros(256, np.uint8)
ROLE[list(b" \t")] = 1
ROLE[list(b".,;:!?\n\x0b\x0c\r")] = 2

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Prints that a task gathers before it hands them on.
PRINTS = 800_000
#: Parts of the shuffle of prints per shuffle partition of the session: a task's table of counts stays small.
PARTS = 4
#: A pass closes the count where failures are at most this share of the proposal's bits.
FEW = 0.25


class Words(NamedTuple):
    """Words of a slice: row, piece and code of each, the distinct words, the group of each and the distinct groups."""

    row: np.ndarray
    piece: np.ndarray
    code: np.ndarray
    distinct: pa.Array
    group: np.ndarray
    groups: pa.Array


def pieces_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, piece and code of every word, and the distinct words: A-Z lower-cased, split at the marks of ``ROLE``."""
    offsets = offsets_of(texts)
    offsets = offsets - offsets[0]
    data = LOWER[bytes_of(texts)]
    n = len(data)
    if not n:
        return *(np.zeros(0, np.int64) for _ in range(3)), pa.array([], pa.large_binary())
    role = ROLE[data]
    word = role == 0
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(word & (first[:n] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (first[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    breaks = np.flatnonzero(role == 2)
    row = np.searchsorted(offsets, starts, side="right") - 1
    piece = row + np.searchsorted(breaks, starts)
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[word])])
    encoded = words.dictionary_encode()
    return row, piece, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def words_of(part: pa.RecordBatch) -> Words:
    row, piece, code, distinct = pieces_of(texts_of(part))
    names = part.column("grp").dictionary_encode()
    return Words(row, piece, code, distinct, names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row], names.dictionary)


#: Lowest bits of a print: the number of words of its phrase; 0 stands for the group itself, counted once per word.
SIZE_BITS = 7


class Phrases(NamedTuple):
    """The phrases of ``n`` words from each word on: a print, and whether the phrase lies in one piece."""

    n: int
    h: np.ndarray
    whole: np.ndarray


class Prints:
    """The prints of the phrases of a slice; the second one is worked out only where a phrase is to be counted."""

    def __init__(self, words: Words):
        self.words = words
        names = words.groups.cast(pa.large_binary())
        self.group = [hashes_of(names, k)[words.group] for k in (0, 1)]
        self.each = [hashes_of(words.distinct, k)[words.code] for k in (0, 1)]

    def by_length(self, longest: int) -> Iterator[Phrases]:
        h, each = self.group[0], self.each[0]
        for n in range(min(longest, len(each)) + 1):
            if n:
                with np.errstate(over="ignore"):
                    h = mixed(h[: len(each) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + each[n - 1 :])
            size = np.uint64(SIZE_BITS)
            whole = self.words.piece[: len(h)] == self.words.piece[max(n - 1, 0) :]
            yield Phrases(n, (h & ~size) | np.uint64(n), whole)

    def second(self, n: int, at: np.ndarray) -> np.ndarray:
        """The second print of the phrases of ``n`` words that begin at these words."""
        g = self.group[1][at]
        for k in range(n):
            with np.errstate(over="ignore"):
                g = (g ^ (g >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + self.each[1][at + k]
        return (g >> np.uint64(33)).astype(np.int32)


def _held(bitmap: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a print is in the bitmap, asked only of those at ``at``."""
    out = np.zeros(len(h), bool)
    out[at] = phrase_filter.holds(bitmap, h[at])
    return out


def _candidates(
    words: Words, longest: int, proposed: np.ndarray, before: np.ndarray | None, closing: bool = False
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size and prints of the phrases to count, one per occurrence; see ``count_prints``.

    A phrase is asked for in a bitmap only if its parts are in it: whatever was proposed once was counted, so they are. What was
    counted before is worked out from ``before`` in the very way a pass works out what it counts, so no phrase is counted twice.
    """
    prints = Prints(words)
    inside = known = None
    for n, h, whole in prints.by_length(longest):
        if n > 1:
            wanted = asked = inside[:-1] & inside[1:] & whole
            if before is not None:
                counted = known[:-1] & known[1:] & whole
                wanted = asked & ~counted
        else:
            wanted = asked = counted = whole
        at = np.flatnonzero(wanted)
        if n > 1 or before is None:
            yield n, h[at], prints.second(n, at)
        if 0 < n < longest:
            new = wanted if closing and n > 1 else np.zeros(len(h), bool)
            inside = _held(proposed, h, np.flatnonzero(asked & ~new)) | new
            known = None if before is None else _held(before, h, np.flatnonzero(counted & inside))


def _added_up(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, g, times = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(h)
    h, g = h[order], g[order]
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
    return h[starts], g[starts], np.add.reduceat(times[order], starts)


def count_prints(
    texts: DataFrame, longest: int, shortest: int, proposed: np.ndarray, before: np.ndarray | None, least: int, gather: int = PRINTS,
    closing: bool = False,
) -> DataFrame:
    """Prints ``h`` and ``g`` with their counts ``a`` of ``least`` or more, of phrases of ``shortest`` to ``longest`` words in ``(grp, text)``.

    Counted are phrases whose parts without the last and without the first word are both ``proposed``, and, where ``before``
    is given, not both in ``before``. Words and groups count where it is not given. A ``closing`` pass, which has a ``before``, takes
    the phrases it counts as proposed. All parts of a frequent phrase are frequent, so were found so or are counted now: none is missed.
    """
    shared = texts.sparkSession.sparkContext.broadcast((proposed, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = added = 0

        def batch(h: np.ndarray, g: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g), pa.array(times)], ["h", "g", "a"])

        for part in slices(batches, "text", SLICE):
            fresh = [(h, g, np.ones(len(h), np.int64)) for n, h, g in _candidates(words_of(part), longest, *shared.value, closing) if n >= shortest and len(h)]
            if fresh:
                held.append(_added_up(fresh))
                rows += len(held[-1][0])
            if rows > max(gather // 4, 2 * added):
                held = [_added_up(held)]
                rows = added = len(held[0][0])
            if added > gather:
                yield batch(*held[0])
                held, rows, added = [], 0, 0
                pa.default_memory_pool().release_unused()
        if held:
            yield batch(*_added_up(held))

    # Tasks have added up already: dealt out first, so that no task tries again before the shuffle.
    parts = PARTS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = texts.mapInArrow(run, "h long, g int, a long").repartition(parts, "h")
    return found.groupBy("h", "g").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def words_of_prints(texts: DataFrame, longest: int, wanted: np.ndarray) -> DataFrame:
    """``h``, ``g``, ``grp``, ``n_words`` and ``phrase`` of the phrases in ``texts`` whose print may be in ``wanted``, once per slice at most."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            words = words_of(part)
            prints = Prints(words)
            for n, h, whole in prints.by_length(longest):
                at = np.flatnonzero(whole & phrase_filter.holds(shared.value, h))
                at = at[np.unique(h[at], return_index=True)[1]]
                if not len(at):
                    continue
                parts = [words.distinct.take(pa.array(words.code[at + k])) for k in range(n)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n else pa.array([b""] * len(at), pa.large_binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[at].view(np.int64)), pa.array(prints.second(n, at)), words.groups.take(pa.array(words.group[at])),
                        pa.array(np.full(len(at), n, np.int32)), phrase.cast(pa.large_string()).cast(pa.string()),
                    ],
                    ["h", "g", "grp", "n_words", "phrase"],
                )

    return texts.mapInArrow(run, "h long, g int, grp string, n_words int, phrase string")


def with_words(texts: DataFrame, frequent: DataFrame, longest: int, bits: int, samples: tuple[int, ...] = (32, 4, 1)) -> DataFrame:
    """``frequent`` prints with ``grp``, ``n_words`` and ``phrase``: looked up in one of 32 texts, then in one of 4, then in all.

    Only prints without words yet are wanted of a round, so no round makes many rows for a print, however common.
    """
    named, missing = None, frequent
    for n, part in enumerate(samples):
        some = texts if part == 1 else texts.sample(1 / part, seed=101 + n)
        found = words_of_prints(some, longest, phrase_filter.built(missing, bits))
        once = found.groupBy("h", "g").agg(*(F.first(c).alias(c) for c in ("grp", "n_words", "phrase")))
        looked = stage(missing.join(once, ["h", "g"], "left"))
        got = looked.where("phrase is not null")
        named = got if named is None else named.unionAll(got)
        missing = looked.where("phrase is null").select("h", "g", "a")
        if missing.isEmpty():
            break
    return named


def sampled_proposal(texts: DataFrame, longest: int, least: int, part: int, bits: int) -> np.ndarray:
    """Phrases frequent in a sample of one in ``part`` texts, level by level, at a threshold lowered by one deviation.

    The sample proposes only: whatever it holds, all counts come from all texts.
    """
    sample = texts.sample(1 / part, seed=13)
    mean = least / part
    lowered = max(2, math.floor(mean - math.sqrt(mean)))
    proposed = phrase_filter.empty(bits)
    for n in range(1, longest):
        proposed = proposed | phrase_filter.built(count_prints(sample, n, n, proposed, None, lowered), bits)
    return proposed


def frequent_phrases(
    documents: DataFrame, longest: int = 4, least: int = 30, part: int = 8, bits: int = phrase_filter.BITS, group: str = "lang", text: str = "text",
) -> DataFrame:
    """``grp``, ``n_words``, ``phrase`` and ``a`` of all phrases of up to ``longest`` words that occur ``least`` times.

    The empty phrase stands for all words of its group, where they are as many.
    """
    texts = documents.select(F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN)).alias("grp"), F.coalesce(text, F.lit("")).alias("text"))
    if not 1 < longest < SIZE_BITS:
        raise ValueError("phrases have two to six words")
    proposed, before = sampled_proposal(texts, longest, least, part, bits), None
    frequent, closing, done = None, False, False
    while not done:
        found = stage(count_prints(texts, longest, 0, proposed, before, least, closing=closing))
        frequent = found if frequent is None else frequent.unionAll(found)
        if closing:
            break
        size = F.col("h").bitwiseAND(F.lit(SIZE_BITS))
        wider = proposed | phrase_filter.built(found.where((size > 0) & (size < longest)), bits)
        failed = int(np.bitwise_count(wider ^ proposed).sum())
        done = not failed
        closing = failed <= FEW * int(np.bitwise_count(proposed).sum())
        proposed, before = wider, proposed
    return with_words(texts, frequent, longest, bits).drop("h", "g")


def _joined(words: Column, first: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(
    documents: DataFrame, least: int = 30, top: int = 2000, longest: int = 4, part: int = 8, group: str = "lang", text: str = "text",
) -> DataFrame:
    """The best phrases of two words or more per group: ``group``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``.

    A phrase scores by its weakest cut; it goes where a longer frequent phrase that holds it stands for four fifths of it.
    """
    counted = stage(frequent_phrases(documents, longest, least, part, group=group, text=text))
    phrases = counted.where("n_words > 0").select("grp", "phrase", F.col("a").alias("f"))
    totals = counted.where("n_words = 0").select("grp", F.col("a").alias("n"))
    candidates = counted.where("n_words > 1").withColumn("words", F.split("phrase", " ", -1))
    cuts = candidates.select(
        "grp", "phrase", "a", "n_words", "words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k")
    ).select(
        "grp", "phrase", "a", "k", _joined(F.col("words"), 1, F.col("k")).alias("left"),
        _joined(F.col("words"), F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"),
    )
    sides = cuts
    for side, name in (("left", "l"), ("right", "r")):
        sides = sides.join(phrases.select("grp", F.col("phrase").alias(side), F.col("f").alias(name)), ["grp", side])
    exact = "decimal(38,0)"
    score = F.expr(f"cast(2000000 as {exact}) * cast(a as {exact}) div (cast(l as {exact}) + cast(r as {exact}))")
    weakest = sides.withColumn("score", score).groupBy("grp", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    inner = candidates.where("n_words > 2").select(
        "grp", "a", "n_words", "words", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("m")
    ).select("grp", "a", "m", "words", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("m") + 1)).alias("at"))
    held = inner.groupBy("grp", _joined(F.col("words"), F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("inside"))
    left = weakest.join(held, ["grp", "phrase"], "left").where(F.expr(f"inside is null or cast(100 as {exact}) * inside < cast(80 as {exact}) * a"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    # One row per group; its size is the number of languages.
    best = left.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "grp")
    return best.select(
        F.col("grp").alias(group), F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        "n", F.col("cut.score").alias("score"),
    )
