"""Severity of toxic texts by cumulative-link ordinal regression on sparse text features.

The grades 0 < 1 < ... share one weight per feature; each threshold between neighbouring grades has its own
offset: P(grade <= k) = 1 / (1 + exp(score - threshold_k)). The output is the expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.common import documents, in_batches, portions
from fairlead.llm.words import PUNCTUATION, word_hashes


#: Lengths in bytes of the word beginnings that count as features, beside whole words.
HEADS = (5, 6, 7, 8)


@dataclass(frozen=True)
class ToxicityRules:
    """``max_labels`` bounds the labelled rows that the model is fitted on, drawn by a hash of doc_id.

    Features are the words and word beginnings a text holds, hashed to 2**feature_bits. ``sparsity`` and ``1 / rows`` add up to the
    L1 penalty that picks features; the picked ones are fitted again with a small ridge. A text is
    toxic if P(grade >= 1) is at least ``limit``.
    """

    max_labels: int = 8_000
    feature_bits: int = 20
    least_rows: int = 3
    sparsity: float = 0.002
    ridge: float = 1e-4
    steps: int = 250
    limit: float = 0.35
    seed: int = 9


@dataclass(frozen=True)
class OrdinalModel:
    """Observed ``grades`` in order, ``thresholds`` between them, and the weights of the ``features`` picked."""

    grades: np.ndarray
    thresholds: np.ndarray
    features: np.ndarray
    weights: np.ndarray
    feature_bits: int


def word_features(column: pa.Array, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, and where each text's begin; only ``wanted`` ones if a mask is given.

    A feature says that a word, or words with this beginning, occur at least 1, 2 or 4 times.
    """
    hashes, bounds = word_hashes(column, PUNCTUATION, HEADS)
    text = np.repeat(np.repeat(np.arange(len(column)), np.diff(bounds)), hashes.shape[1])
    hashes = hashes.ravel()
    features = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    chosen = hashes != 0
    if wanted is not None:
        chosen &= wanted[features] | wanted[features ^ 1] | wanted[features ^ 2]
    pairs, counts = np.unique((text[chosen] << bits) | features[chosen], return_counts=True)
    # A feature's variants for more occurrences are its number with the lowest bits turned.
    pairs = np.unique(np.concatenate([pairs, pairs[counts >= 2] ^ 1, pairs[counts >= 4] ^ 2]))
    if wanted is not None:
        pairs = pairs[wanted[pairs & ((1 << bits) - 1)]]
    return pairs & ((1 << bits) - 1), np.searchsorted(pairs >> bits, np.arange(len(column) + 1))


def training_rows(docs: DataFrame, labels: DataFrame, rules: ToxicityRules) -> DataFrame:
    """doc_id, grade and features of at most ``max_labels`` labelled documents; features that fewer than ``least_rows`` of them hold are left out.

    Of several labels of one document the largest counts; labels without doc_id or grade are left out.
    """
    chosen = (
        labels.filter("doc_id is not null and grade is not null")
        .groupBy("doc_id")
        .agg(F.max("grade").cast("long").alias("grade"))
        .orderBy(F.xxhash64(F.lit(rules.seed), F.col("doc_id")), "doc_id")
        .limit(rules.max_labels)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_labels rows of two numbers
    bits = rules.feature_bits

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, np.int64)
        for batch in portions(batches):
            held += np.bincount(word_features(batch.column("text"), bits)[0], minlength=1 << bits)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some], pa.int64())], ["feature", "held"])

    counts = in_batches(rows, counted, "feature int, held long").groupBy("feature").agg(F.sum("held").alias("held"))
    # At most 2**feature_bits numbers, and far fewer: most features are rare.
    frequent = counts.filter(F.col("held") >= rules.least_rows).select("feature").toArrow().column(0).to_numpy()
    wanted = np.zeros(1 << bits, bool)
    wanted[frequent] = True
    mask = np.packbits(wanted)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.unpackbits(mask).astype(bool)
        for batch in portions(batches):
            values, bounds = word_features(batch.column("text"), bits)
            held = np.concatenate([[0], np.cumsum(kept[values])])
            lists = pa.ListArray.from_arrays(pa.array(held[bounds], pa.int32()), pa.array(values[kept[values]], pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), lists], ["doc_id", "grade", "features"]
            )

    return in_batches(rows, features, "doc_id long, grade long, features array<int>")


#: Entries of a sparse matrix that are worked on at once.
_SLICE = 1 << 19


class _Rows:
    """A sparse 0/1 matrix of texts and features."""

    def __init__(self, features: np.ndarray, bounds: np.ndarray, width: int) -> None:
        self.features, self.bounds, self.width = features, bounds, width
        self.row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))

    def _slices(self) -> Iterator[slice]:
        return (slice(low, low + _SLICE) for low in range(0, len(self.features), _SLICE))

    def times(self, weights: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.bounds) - 1)
        for part in self._slices():
            total += np.bincount(self.row[part], weights[self.features[part]], minlength=len(total))
        return total

    def back(self, slopes: np.ndarray) -> np.ndarray:
        total = np.zeros(self.width)
        for part in self._slices():
            total += np.bincount(self.features[part], slopes[self.row[part]], minlength=self.width)
        return total

    def only(self, columns: np.ndarray) -> _Rows:
        place = np.full(self.width, -1, np.int32)
        place[columns] = np.arange(len(columns))
        keep = place[self.features] >= 0
        bounds = np.searchsorted(self.row[keep], np.arange(len(self.bounds)))
        return _Rows(place[self.features[keep]], bounds, len(columns))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _slopes(scores: np.ndarray, thresholds: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log-likelihood: by each row's score, and by the thresholds."""
    upper = np.concatenate([thresholds, [np.inf]])[grade]
    lower = np.concatenate([[-np.inf], thresholds])[grade]
    above, below = _sigmoid(upper - scores), _sigmoid(lower - scores)
    chance = np.maximum(above - below, 1e-12)
    up, down = above * (1 - above) / chance, below * (1 - below) / chance
    n = len(grade)
    by_threshold = np.bincount(grade, -up, minlength=len(thresholds) + 1)[: len(thresholds)]
    by_threshold += np.bincount(grade, down, minlength=len(thresholds) + 1)[1:]
    return (up - down) / n, by_threshold / n


def _descend(rows: _Rows, grade: np.ndarray, start: np.ndarray, l1: float, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal descent; thresholds take part in every step and are kept in order."""
    weights, thresholds = np.zeros(rows.width), start.copy()
    ahead, ahead_t, pace = weights, thresholds, 1.0
    # The slope changes by at most a quarter per unit of score; a row's score by its features' number.
    # A power iteration finds how far one step may go.
    probe = np.ones(rows.width)
    for _ in range(12):
        probe = rows.back(rows.times(probe))
        probe /= max(np.linalg.norm(probe), 1e-12)
    bend = np.linalg.norm(rows.back(rows.times(probe))) / max(len(grade), 1)
    step = 1.0 / (0.5 * bend + 1.0 + l2)
    for _ in range(steps):
        by_score, by_threshold = _slopes(rows.times(ahead), ahead_t, grade)
        moved = ahead - step * (rows.back(by_score) + l2 * ahead)
        following = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        following_t = np.maximum.accumulate(ahead_t - step * by_threshold)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = following + (pace - 1) / faster * (following - weights)
        ahead_t = np.maximum.accumulate(following_t + (pace - 1) / faster * (following_t - thresholds))
        weights, thresholds, pace = following, following_t, faster
    return weights, thresholds


def fit(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> OrdinalModel:
    """The model of ``labels`` (doc_id, grade); the only rows that reach the driver are the bounded sample's."""
    table = training_rows(docs, labels, rules).toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    grades, grade = np.unique(table.column("grade").to_numpy(), return_inverse=True)
    nothing = np.zeros(0)
    if len(grades) < 2:
        return OrdinalModel(grades, nothing, nothing.astype(np.int64), nothing, rules.feature_bits)
    lists = table.column("features").combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)))]).astype(np.int64)
    features = lists.flatten().to_numpy(zero_copy_only=False)
    frequent = np.zeros(1 << rules.feature_bits, bool)
    frequent[features] = True
    known = np.flatnonzero(frequent)
    rows = _Rows((np.cumsum(frequent, dtype=np.int32) - 1)[features], bounds, len(known))
    del table, lists, features
    shares = np.cumsum(np.bincount(grade))[:-1] / len(grade)
    start = np.log(shares / (1 - shares))
    weights, _ = _descend(rows, grade, start, rules.sparsity + 1 / len(grade), 0.0, rules.steps)
    picked = np.flatnonzero(weights)
    weights, thresholds = _descend(rows.only(picked), grade, start, 0.0, rules.ridge, 4 * rules.steps)
    return OrdinalModel(grades, thresholds, known[picked], weights, rules.feature_bits)


def severity(column: pa.Array, model: OrdinalModel) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade of each text, and the probability of a grade above 0. Without any label: 0 and 0."""
    if len(model.grades) < 2:
        grade = float(model.grades[0]) if len(model.grades) else 0.0
        return np.full(len(column), grade), np.full(len(column), float(grade > 0))
    dense = np.zeros(1 << model.feature_bits)
    dense[model.features] = model.weights
    features, bounds = word_features(column, model.feature_bits, dense != 0)
    row = np.repeat(np.arange(len(column)), np.diff(bounds))
    scores = np.bincount(row, dense[features], minlength=len(column))
    reached = _sigmoid(scores[:, None] - model.thresholds[None, :])  # P(at least the next grade)
    expected = model.grades[0] + reached @ np.diff(model.grades).astype(float)
    first = np.searchsorted(model.grades, 1)  # the smallest grade above 0
    chance = np.ones(len(column)) if first == 0 else reached[:, first - 1]
    return expected, chance


def score(docs: DataFrame, model: OrdinalModel, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """Per row: doc_id, severity (expected grade), p_toxic, toxic. Null or empty text has no features."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            expected, chance = severity(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(expected), pa.array(chance), pa.array(chance >= rules.limit)],
                ["doc_id", "severity", "p_toxic", "toxic"],
            )

    return in_batches(
        docs.select("doc_id", "text"), scored, "doc_id long, severity double, p_toxic double, toxic boolean"
    )


def without_toxic(docs: DataFrame, model: OrdinalModel, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all columns."""
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield batch.filter(pa.array(severity(batch.column(at), model)[1] < rules.limit))

    return in_batches(docs, kept, docs.schema)


def severity_labels(labels: DataFrame) -> DataFrame:
    """Grades of the given labels: 0 clean, 1 toxic, 2 toxic and of low quality."""
    worse = F.coalesce(F.col("quality") == 0, F.lit(False)).cast("int")
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 1 + worse).when(F.col("toxic") == 0, 0).alias("grade"))


def fitted(spark: SparkSession, sf_dir: str, docs: DataFrame, rules: ToxicityRules = ToxicityRules()) -> OrdinalModel:
    return fit(docs, severity_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")), rules)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fitted(spark, sf_dir, docs))
