"""Quality rules from tokeniser fertility.

Every text is measured under a public sentencepiece vocabulary: tokens per
word, characters per token, share of byte-fallback tokens, and the evenness of its token
distribution (entropy over the largest entropy that many tokens can have). A text is rejected
when a measure leaves the band of its language, or of its script where the
language has too few texts of that length, or of its language at all lengths, or, for byte share and characters
per token, of all texts. Bands are quartiles of the whole corpus widened by a multiple of
their distance, kept per class of length (half octaves of the token count), since
the measures drift with length. Texts of equal measures count once for the quartiles, so copies do not narrow a band.

Defined results: a null text counts as empty; an empty text fails the base rules; a
null language uses the script's band. A group with fewer texts reaches further, by its count, and one with fewer
than ``min_texts`` has no band of its own; the band of all texts is there for any count. Rows with equal ids are measured and returned one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import vocabularies
from threadloom.llm.text import Coded, coded, coded_words, gather, mixed, passed_on, segment_sums, slices, texts_of
from threadloom.session import stage

#: First code points of runs of one script (0 = no script of its own).
SCRIPT_RUNS = [
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00C0, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3),
    (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0900, 7), (0x0980, 0), (0x0E00, 8), (0x0E80, 0), (0x10A0, 9),
    (0x1100, 10), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 11), (0x3100, 0), (0x3400, 12), (0xA000, 0),
    (0xAC00, 10), (0xD7B0, 0), (0x20000, 12), (0x30000, 0),
]
SCRIPTS = [
    "none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "thai", "georgian", "hangul", "kana", "han",
]
RUN_STARTS = np.array([start for start, _ in SCRIPT_RUNS])
RUN_SCRIPT = np.array([script for _, script in SCRIPT_RUNS])

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, tokens_per_word double, chars_per_token double, byte_share double, evenness double, script string"

#: How far a band reaches beyond its quartiles, per measure: in quartile distances, and at least. Keys and
#: numbers raise the tokens per word of good texts too; their evenness and characters per token hardly vary.
SPREAD = {"tokens_per_word": 4.0, "chars_per_token": 3.0, "byte_share": 4.0, "evenness": 2.0}
SLACK = {"tokens_per_word": 0.25, "chars_per_token": 0.125, "byte_share": 0.1, "evenness": 0.02}

#: The quartiles of n texts are uncertain by about their distance over the root of n: a band reaches further by this many of those.
FEW = 4.0

#: Measures that the band of all texts judges where no narrower one does.
ANY_TEXT = ("byte_share", "chars_per_token")

#: Copies of the table of bands, so that its join spreads.
BAND_COPIES = 64


def _script_rows(words: Coded, strings: list[str]) -> np.ndarray:
    """The script that most words of each text begin with (ties: the lower code)."""
    first = np.fromiter((ord(w[0]) for w in strings), np.int64, len(strings))
    script = RUN_SCRIPT[np.searchsorted(RUN_STARTS, first, side="right") - 1][words.code]
    best, most = np.zeros(len(words.counts), np.int64), np.zeros(len(words.counts), np.int64)
    for s in np.unique(script[script > 0]):
        n = segment_sums((script == s).astype(np.int64), words.counts)
        best, most = np.where(n > most, s, best), np.maximum(n, most)
    return best


def _duplicate_lines(texts: pa.Array) -> np.ndarray:
    lines = coded(pc.split_pattern(texts, "\n"))
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines.distinct)), 0).to_numpy(zero_copy_only=False)
    keep = worded[lines.code]
    rows = lines.rows[keep]
    unique = np.unique(rows * max(1, len(lines.distinct)) + lines.code[keep])
    return np.bincount(rows, minlength=len(texts)) - np.bincount(unique // max(1, len(lines.distinct)), minlength=len(texts))


def _repeated_words(words: Coded, width: int = 5) -> np.ndarray:
    """Words inside windows that occur twice or more in their text."""
    n = len(words.code)
    if n < width:
        return np.zeros(len(words.counts), np.int64)
    rows = words.rows
    spread = mixed(words.code + 1)
    with np.errstate(over="ignore"):
        key = mixed(rows[: n - width + 1] + (1 << 40))
        for k in range(width):
            key = key + spread[k : n - width + 1 + k] * np.uint64(2 * int(mixed(np.array([k + 7]))[0] >> np.uint64(1)) + 1)
    at = np.flatnonzero(rows[: n - width + 1] == rows[width - 1 :])
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    for k in range(1, width):
        covered[k:] |= twice[:-k]
    return segment_sums(covered.astype(np.int64), words.counts)


def _evenness(ids: np.ndarray, counts: np.ndarray, vocabulary: int) -> np.ndarray:
    """Entropy of each text's tokens, as a share of that of as many different tokens."""
    rows = np.repeat(np.arange(len(counts)), counts)
    key, seen = np.unique(rows * vocabulary + ids, return_counts=True)
    inside = np.bincount(key // vocabulary, weights=seen * np.log2(seen), minlength=len(counts))
    with np.errstate(divide="ignore", invalid="ignore"):
        top = np.log2(counts)
        return np.where(counts > 1, (top - inside / counts) / top, 1.0)


def measure_texts(texts: pa.Array, encoder: vocabularies.PieceEncoder) -> list[pa.Array]:
    words = coded_words(texts)
    strings = words.distinct.to_pylist()
    starts, lengths, flat = encoder.table.lookup(strings)
    per_word = lengths[words.code]
    n_tokens = segment_sums(per_word, words.counts)
    ids = gather(starts[words.code], per_word, flat)
    byte_tokens = segment_sums(encoder.is_byte[ids].astype(np.int64), n_tokens)
    chars = segment_sums(pc.utf8_length(words.distinct).to_numpy(zero_copy_only=False).astype(np.int64)[words.code], words.counts)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    data = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    symbols = segment_sums(SYMBOLS[data].astype(np.int64), sizes)
    some = np.maximum(n_tokens, 1)
    return [
        pa.array(words.counts), pa.array(chars), pa.array(symbols), pa.array(_duplicate_lines(texts)), pa.array(_repeated_words(words)),
        pa.array(n_tokens), pa.array(n_tokens / np.maximum(words.counts, 1)), pa.array(np.where(n_tokens, chars / some, 0.0)), pa.array(byte_tokens / some),
        pa.array(_evenness(ids, n_tokens, encoder.size)), pa.array(np.array(SCRIPTS)[_script_rows(words, strings)]),
    ]


def measure(texts: DataFrame, vocabulary: Broadcast, text: str = "text") -> DataFrame:
    """All columns of ``texts`` but the text, followed by its measures; no shuffle."""
    others, schema = passed_on(texts, MEASURES, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabularies.worker_copy("pieces", vocabulary.value, vocabularies.PieceEncoder)
        for part in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *measure_texts(texts_of(part, text), encoder)], schema.names)

    return texts.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(measured: DataFrame, language: str = "lang", spread: dict[str, float] = SPREAD, min_texts: int = 50, min_tokens: int = 128) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``: inside the bands of its language or script.

    Bands come from the texts that pass the base rules. The table of bands has one row per
    language or script and half octave of length; equal rows and percentiles combine before their shuffles, so a
    language that most texts share costs one sketch per task. Below ``min_tokens`` tokens the
    measures say too little, and the base rules decide alone.
    """
    rows = measured.withColumns(
        {
            "base_failed": base_failed(),
            "_octave": F.floor(2 * F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int"),
            "_language": F.concat(F.lit("language "), F.col(language)), "_script": F.concat(F.lit("script "), F.col("script")),
        }
    ).withColumns(
        {
            "_by_language": F.when(F.col("_language").isNotNull(), F.struct(F.col("_language").alias("group"), F.col("_octave").alias("octave"))),
            "_by_script": F.struct(F.col("_script").alias("group"), F.col("_octave").alias("octave")),
            "_by_all": F.struct(F.coalesce("_language", "_script").alias("group"), F.lit(-1).alias("octave")),
            "_by_any": F.struct(F.lit("any").alias("group"), F.lit(-1).alias("octave")),
        }
    )
    levels = ("_by_language", "_by_script", "_by_all", "_by_any")
    grouped = (
        rows.where("not base_failed").select(*levels, "n_tokens", "n_words", *SLACK).distinct()
        .select(F.explode(F.array_compact(F.array(*levels))).alias("_group"), *SLACK)
        .groupBy("_group.group", "_group.octave")
    )
    # Written once for the levels below that read it.
    quartiles = stage(grouped.agg(F.count("*").alias("n"), *(F.percentile_approx(m, [0.25, 0.75], 1000).alias(m) for m in SLACK)))
    # One language may hold most rows: each row looks its band up in one of BAND_COPIES copies of the small table.
    copies = F.sequence(F.lit(0).cast("long"), F.lit(BAND_COPIES - 1).cast("long"))
    bands = quartiles.where((F.col("n") >= min_texts) | (F.col("group") == "any")).withColumn("_copy", F.explode(copies))
    rows = rows.withColumn("_copy", F.pmod(F.xxhash64("n_words", "word_chars", "evenness", "chars_per_token"), F.lit(BAND_COPIES)))
    for by in levels:
        band = bands.select(F.struct("group", "octave").alias(by), "_copy", *(F.col(m).alias(f"{by}_{m}") for m in (*SLACK, "n")))
        rows = rows.join(band, [by, "_copy"], "left")
    outside = F.lit(False)
    for m, slack in SLACK.items():
        # Evenness falls with length, so a band over all lengths says nothing about it.
        by = levels[: 2 if m == "evenness" else 4 if m in ANY_TEXT else 3]
        band, n = (F.coalesce(*(F.col(f"{b}_{c}") for b in by)) for c in (m, "n"))
        reach = F.greatest(spread[m] * (band[1] - band[0]), F.lit(slack)) * (1 + FEW / F.sqrt(n))
        above, below = F.col(m) > band[1] + reach, F.col(m) < band[0] - reach
        outside = outside | F.coalesce({"byte_share": above, "evenness": below}.get(m, above | below), F.lit(False))
    outside = outside & (F.col("n_tokens") >= min_tokens)
    return rows.withColumn("kept", ~F.col("base_failed") & ~outside).select(*measured.columns, "base_failed", "kept")


def fertility_verdicts(
    documents: DataFrame, vocabulary: str | None = None, id: str = "doc_id", text: str = "text", language: str = "lang",
    spread: dict[str, float] = SPREAD, min_texts: int = 50, min_tokens: int = 128,
) -> DataFrame:
    """Id, language, measures, ``base_failed`` and ``kept`` of every text; texts are read once."""
    shared = vocabularies.share_file(documents.sparkSession, vocabulary or vocabularies.default_path("piece_bpe_32k.model"))
    narrow = documents.select(id, text, language)
    return judged(stage(measure(narrow, shared, text)), language, spread, min_texts, min_tokens)
