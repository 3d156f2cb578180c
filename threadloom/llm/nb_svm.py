"""Quality classifier: naive Bayes support vectors.

Features are indicators of word n-grams (one and two words) in two streams: the words as they are,
and their shapes (runs of capitals, of small letters, of digits; a word equal to the one before has a
shape of its own). Each indicator is scaled by its class log-count ratio, rows are brought to length one, and a linear
hinge-loss model is fitted by dual coordinate descent. The margin becomes a score
by a logistic curve fitted to the training margins.

The model is fitted on a bounded sample: at most ``per_class`` labelled texts of each class, the least by a hash
of their ids. Its features reach the driver, where the descent runs; the fitted weights, one per hash bucket, are
broadcast. Scoring is one pass over all texts without a shuffle.

Defined results: a null text counts as empty; an empty text has no feature and is scored by the bias alone. Labels other than 0 and 1
and null labels are not learned; an id labelled twice is learned by its smaller label. Without two classes the score is 1, 0 or,
with none, 0.5 throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.text import Coded, coded_words, mixed, passed_on, segment_sums, slices, texts_of

BUCKETS = 1 << 18


class Model(NamedTuple):
    weight: np.ndarray  # fitted weight times log-count ratio
    square: np.ndarray  # squared ratio, for the length of a row
    bias: float
    slope: float
    shift: float


def _hashes(strings: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(s) for s in strings.to_pylist()), np.uint64, len(strings))


def _streams(words: Coded) -> Iterator[np.ndarray]:
    yield _hashes(words.distinct)[words.code]
    shape = words.distinct
    for pattern, mark in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "a"), (r"\p{N}+", "0")):
        shape = pc.replace_substring_regex(shape, pattern, mark)
    shapes = shape.dictionary_encode()
    hashed = mixed(_hashes(shapes.dictionary) + np.uint64(1))[shapes.indices.to_numpy(zero_copy_only=False)][words.code]
    again = np.zeros(len(hashed), bool)
    again[1:] = (words.code[1:] == words.code[:-1]) & (words.rows[1:] == words.rows[:-1])
    yield np.where(again, np.uint64(0x5A5A), hashed)


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every distinct feature, sorted by row."""
    words = coded_words(texts)
    if not len(words.code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, keys = words.rows, []
    inside = rows[1:] == rows[:-1]
    for h in _streams(words):
        with np.errstate(over="ignore"):
            pair = mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[inside]
        keys += [rows * BUCKETS + (mixed(h) % np.uint64(BUCKETS)).astype(np.int64), rows[1:][inside] * BUCKETS + (pair % np.uint64(BUCKETS)).astype(np.int64)]
    found = np.unique(np.concatenate(keys))
    return found // BUCKETS, found % BUCKETS


def sample(labels: DataFrame, per_class: int, id: str = "doc_id", label: str = "quality") -> DataFrame:
    """At most ``per_class`` ids of each class, as ``id`` and ``label``."""
    one = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(label).cast("int").alias("label"))
    classes = [one.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    return classes[0].unionAll(classes[1])


def train(documents: DataFrame, labels: DataFrame, per_class: int = 4000, id: str = "doc_id", text: str = "text", label: str = "quality", **descent) -> Model:
    """Model of the labelled texts; ``labels`` must hold only rows that may be learned."""
    chosen = F.broadcast(sample(labels, per_class, id, label))  # at most 2 * per_class ids
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text")).join(chosen, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            row, bucket = text_features(texts_of(part))
            cuts = np.searchsorted(row, np.arange(1, part.num_rows))
            data = [x.astype("<i4").tobytes() for x in np.split(bucket, cuts)]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(data, pa.binary())], ["label", "features"])

    table = rows.select("label", "text").mapInArrow(run, "label int, features binary").toArrow()
    examples = sorted(zip(table["label"].to_pylist(), table["features"].to_pylist()))
    return fit([np.frombuffer(f, "<i4") for _, f in examples], np.array([y for y, _ in examples]), **descent)


def fit(features: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0, cost: float = 1.0, rounds: int = 30, tolerance: float = 0.01) -> Model:
    if len(set(labels.tolist())) < 2:
        sure = 0.0 if not len(labels) else 30.0 * (1 if labels[0] else -1)
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0, sure)
    counts = []
    for c in (1, 0):
        n = np.bincount(np.concatenate([f for f, y in zip(features, labels) if y == c]), minlength=BUCKETS) + smoothing
        counts.append(n / n.sum())
    ratio = np.log(counts[0] / counts[1])
    weight, bias = _descend(features, ratio, np.where(labels == 1, 1.0, -1.0), cost, rounds, tolerance)
    margins = np.array([ratio[f] @ weight[f] / (np.sqrt((ratio[f] ** 2).sum()) or 1.0) + bias for f in features])
    slope, shift = _logistic(margins, labels)
    return Model(weight * ratio, ratio**2, bias, slope, shift)


def _descend(features: list[np.ndarray], ratio: np.ndarray, sign: np.ndarray, cost: float, rounds: int, tolerance: float) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; classes weigh alike, the bias is a constant feature."""
    weight, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(sign))
    upper = cost * np.where(sign > 0, len(sign) / (2 * (sign > 0).sum()), len(sign) / (2 * (sign < 0).sum()))
    rows = [ratio[f] / (np.sqrt((ratio[f] ** 2).sum()) or 1.0) for f in features]
    curvature = np.array([x @ x + 1.0 for x in rows])
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(sign)):
            f, x, y = features[i], rows[i], sign[i]
            gradient = y * (weight[f] @ x + bias) - 1.0
            after = min(max(alpha[i] - gradient / curvature[i], 0.0), upper[i])
            step = (after - alpha[i]) * y
            if step:
                worst = max(worst, abs(step))
                alpha[i] = after
                weight[f] += step * x
                bias += step
        if worst < tolerance:
            break
    return weight, bias


def _logistic(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the curve through the margins, by Newton steps on softened labels."""
    positive = int(labels.sum())
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w, g = p * (1 - p) + 1e-9, p - target
        hessian = np.array([[w @ margins**2 + 1e-6, w @ margins], [w @ margins, w.sum() + 1e-6]])
        step = np.linalg.solve(hessian, [g @ margins, g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    row, bucket = text_features(texts)
    counts = np.bincount(row, minlength=len(texts))
    size = np.sqrt(segment_sums(model.square[bucket], counts))
    margin = segment_sums(model.weight[bucket], counts) / np.where(size > 0, size, 1.0) + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))


def score(documents: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """All columns of ``documents`` but the text, then the score, which replaces a column of its name."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    others, schema = passed_on(documents, f"{column} double", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            scores = score_texts(texts_of(part, text), shared.value)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(scores)], schema.names)

    return documents.mapInArrow(run, schema)
