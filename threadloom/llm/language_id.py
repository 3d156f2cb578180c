"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (one to four characters, inside words and their
borders) of all labelled texts: every task adds up one vector per language, and the
vectors of all tasks are summed by Spark, so a language that holds a third of all
rows costs one partial sum per task. The model is a matrix of log-probabilities,
buckets by languages, whose size does not depend on the corpus; it is broadcast. Scoring
computes a vector per distinct word of a slice (sparse rows of hashed n-grams against
the matrix) and adds up the words of each text.

The posterior only compares the learned languages and nears 1 with length, also for a text in none of them. The
fit says whether a text is in its best language at all: the mean log-probability of its n-grams, less the
mean that texts drawn from the model have, in deviations of a single n-gram. It does not grow with length; few
n-grams scatter more, so their fit counts for less.

Defined results: a text that is null or has no letter gets ``und`` with score 0; so
does every text when nothing could be learned. Equal posteriors fall to the first language in
alphabetical order. Null languages are not learned. More than ``MAX_LANGUAGES``
languages are an error, since the matrix would outgrow its broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.text import coded_words, mixed, passed_on, segment_sums, slices, texts_of

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
MAX_LANGUAGES = 256
UNKNOWN = "und"
#: A text of n n-grams scatters by this many deviations over the root of n.
FEW = 3.0


class Model(NamedTuple):
    languages: list[str]
    log_prior: np.ndarray
    log_probability: np.ndarray

    @property
    def spread(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of the log-probability of an n-gram drawn from each language."""
        logs = self.log_probability.astype(np.float64)
        shares = np.exp(logs)
        mean = (shares * logs).sum(axis=0)
        return mean, np.sqrt((shares * (logs - mean) ** 2).sum(axis=0))


def word_grams(words: list[str], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of every n-gram, and how many each word has.

    Words stand between single spaces, which belong to the n-grams at their borders.
    """
    points = np.frombuffer((" " + " ".join(words) + " ").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = points == 32
    spaces = np.concatenate([[0], np.cumsum(space)])
    word = np.maximum(spaces[1:] - 1, 0)
    state = np.zeros(len(points), np.uint64)
    for order in range(1, max(ORDERS) + 1):
        n = len(points) - order + 1
        if n <= 0:
            return
        with np.errstate(over="ignore"):
            state = state[:n] * np.uint64(0x9E3779B97F4A7C15) + points[order - 1 :] + np.uint64(1)
        if order not in ORDERS:
            continue
        at = np.arange(n)
        # No space strictly inside; a lone character is not a space.
        keep = ~space[:n] if order == 1 else spaces[at + order - 1] == spaces[at + 1]
        keep &= at < len(points) - 1
        yield (mixed(state[keep]) % np.uint64(buckets)).astype(np.int64), np.bincount(word[:n][keep], minlength=len(words))


def _counts(batches: Iterator[pa.RecordBatch], text: str, language: str) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for part in slices(batches, text):
        words = coded_words(texts_of(part, text))
        strings = words.distinct.to_pylist()
        labels = part.column(language).dictionary_encode()
        of_row = labels.indices.to_numpy(zero_copy_only=False)
        grams = list(word_grams(strings)) if strings else []
        for n, label in enumerate(labels.dictionary.to_pylist()):
            rows = of_row == n
            total = totals.setdefault(label, np.zeros(BUCKETS + 1, np.int64))
            total[BUCKETS] += rows.sum()
            uses = np.bincount(words.code[np.repeat(rows, words.counts)], minlength=len(strings))
            for bucket, counts in grams:
                total[:BUCKETS] += np.bincount(bucket, weights=np.repeat(uses, counts), minlength=BUCKETS).astype(np.int64)
    for label, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["language", "bucket", "n"])


def train(labelled: DataFrame, text: str = "text", language: str = "lang", smoothing: float = 0.5) -> Model:
    """Model of all rows with a language. Only its buckets reach the driver, at most ``BUCKETS`` per language."""
    rows = labelled.select(F.col(text).alias("text"), F.col(language).cast("string").alias("language")).where("language is not null")
    counts = rows.mapInArrow(lambda b: _counts(b, "text", "language"), "language string, bucket long, n long")
    table = counts.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(pc.unique(table["language"]).to_pylist())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the model holds at most {MAX_LANGUAGES}")
    dense = np.zeros((BUCKETS + 1, len(languages)))
    if languages:
        column = pc.index_in(table["language"], pa.array(languages, table["language"].type)).to_numpy()
        dense[table["bucket"].to_numpy(), column] = table["n"].to_numpy()
    grams, texts = dense[:BUCKETS] + smoothing, dense[BUCKETS]
    return Model(languages, np.log(texts / max(texts.sum(), 1)), np.log(grams / grams.sum(axis=0)).astype(np.float32))


def score_texts(texts: pa.Array, model: Model, spread: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior and, where the model's spread is given, fit of every text."""
    words = coded_words(texts)
    strings = words.distinct.to_pylist()
    lettered = pc.match_substring_regex(words.distinct, r"\p{L}").to_numpy(zero_copy_only=False)
    has_letter = segment_sums(lettered[words.code].astype(np.int64), words.counts) > 0
    if not model.languages or not strings:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    per_word, grams_of = np.zeros((len(strings), len(model.languages))), np.zeros(len(strings), np.int64)
    for bucket, counts in word_grams(strings):
        per_word += segment_sums(model.log_probability[bucket].astype(np.float64), counts)
        grams_of += counts
    likelihood = segment_sums(per_word[words.code], words.counts)
    logs = likelihood + model.log_prior
    logs -= logs.max(axis=1, keepdims=True)
    shares = np.exp(logs)
    shares /= shares.sum(axis=1, keepdims=True)
    best = shares.argmax(axis=1)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has_letter.tolist())]
    at, fits = np.arange(len(best)), np.zeros(len(best))
    if spread:
        (mean, deviation), n = spread, np.maximum(segment_sums(grams_of[words.code], words.counts), 1)
        fits = (likelihood[at, best] / n - mean[best]) / (np.maximum(deviation[best], 1e-9) * (1 + FEW / np.sqrt(n)))
    return names, np.where(has_letter, shares[at, best], 0.0), np.where(has_letter, fits, 0.0)


def predict(documents: DataFrame, model: Model, text: str = "text", prefix: str = "", fit: bool = False) -> DataFrame:
    """All columns of ``documents``, then ``lang_pred``, ``score`` (the posterior) and, if asked for, ``fit``, which replace columns of these names; no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    others, schema = passed_on(documents, f"{prefix}lang_pred string, {prefix}score double" + (f", {prefix}fit double" if fit else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = shared.value.spread if fit else None
        for part in slices(batches, text):
            languages, scores, fits = score_texts(texts_of(part, text), shared.value, spread)
            made = [pa.array(languages, pa.string()), pa.array(scores), *([pa.array(fits)] if fit else [])]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *made], schema.names)

    return documents.mapInArrow(run, schema)


def fold(id: str, folds: int) -> Column:
    """Remainder of the checksum of an id written as text."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % folds
