"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is taken as lower-cased UTF-8 (A-Z only) between two spaces; its features are n-grams of 3 to 5 bytes, each by its exact
bytes.  On a sample of labelled texts the ratio of an n-gram is the log of the share of toxic texts that hold it over the
share of the others, smoothed by SMOOTHING.  The FEATURES n-grams whose ratio, weighed by how many texts it speaks for,
is largest are kept.  A feature's value is its ratio times the root of its share of all n-grams of the text, so a text
has the same values however often it is repeated, and clean text has much the same score at every length.  Logistic
regression is fitted by full gradients, each a sum over the sample's partitions, in which both classes weigh the same; its
intercept is then moved half way to the class shares of all labelled rows.  Smoothing, the bound on the features and the
penalty keep rare n-grams small; all were chosen by cross-validation within the training folds.

Null and empty texts have no features and get the score of the intercept.  Without labelled texts of both
classes every score is that of the class shares (0 if there are no labels at all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayledger.llm.training import class_counts, labelled_sample, partition_sums
from wayledger.session import checkpointed

ORDERS = (3, 4, 5)
#: The sample's bound for each class, and of the features.
ROWS_PER_CLASS = 4_000
FEATURES = 2_000
STEPS = 30
RATE = 0.3
PENALTY = 1e-3
SMOOTHING = 0.3
FEWEST_TEXTS = 3
#: Bytes of texts scored at once, about.
SLICE_BYTES = 1_000_000
#: Between texts; no UTF-8 text holds this byte.
_BORDER = b"\xff"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 16


def spelled(text: str | None) -> bytes:
    return f" {text} ".encode().lower() if text else b""


def codes_of(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The n-grams at each place of some bytes, one number for each order and n-gram."""
    code = data = data.astype(np.uint64)
    for order in range(2, max(ORDERS) + 1):
        code = (code[:-1] << np.uint64(8)) | data[order - 1 :]
        if order in ORDERS:
            yield order, code | np.uint64(order << 56)


def grams(text: str | None) -> np.ndarray:
    """All n-grams of a text, with repeats."""
    data = np.frombuffer(spelled(text), np.uint8)
    return np.concatenate([code for _, code in codes_of(data)]) if len(data) else np.empty(0, np.uint64)


def log_count_ratio(held_by_toxic, held_by_others, toxic: float, others: float):
    """log of the smoothed share of toxic texts over that of the others; of numbers, arrays or columns."""
    log = F.log if isinstance(held_by_toxic, Column) else np.log
    p, q = (held_by_toxic + SMOOTHING) / (toxic + 2 * SMOOTHING), (held_by_others + SMOOTHING) / (others + 2 * SMOOTHING)
    return log(p) - log(q)


@dataclass
class Features:
    """Sorted codes of the n-grams that were kept, with their ratios."""

    codes: np.ndarray
    ratios: np.ndarray

    def __post_init__(self):
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slots(self.codes)] = True

    @staticmethod
    def _slots(codes: np.ndarray) -> np.ndarray:
        return (codes * _MULTIPLIER) >> np.uint64(64 - _FILTER_BITS)

    def values(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value) of the features that the texts hold, by text."""
        raw = [spelled(t) for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        totals = sum(np.maximum(sizes - n + 1, 0) for n in ORDERS)
        ends = np.cumsum(sizes + 1)
        keys = []
        for _, code in codes_of(np.frombuffer(_BORDER.join(raw) + _BORDER, np.uint8)):
            # Most places are ruled out by a small table before the exact codes are compared.
            maybe = np.flatnonzero(self.filter[self._slots(code)])
            found = code[maybe]
            at = np.minimum(np.searchsorted(self.codes, found), max(len(self.codes) - 1, 0))
            same = self.codes[at] == found if len(self.codes) else np.zeros(0, bool)
            keys.append(np.searchsorted(ends, maybe[same], "right") * len(self.codes) + at[same])
        keys, counts = np.unique(np.concatenate(keys), return_counts=True)
        of, feature = np.divmod(keys, max(len(self.codes), 1))
        return of, feature, np.sqrt(counts / totals[of]) * self.ratios[feature]


@dataclass
class ToxicityModel:
    features: Features
    weights: np.ndarray
    intercept: float

    def odds(self, texts: list[str | None]) -> np.ndarray:
        """Log odds of label 1."""
        of, feature, value = self.features.values(texts)
        return np.bincount(of, self.weights[feature] * value, len(texts)) + self.intercept

    def score(self, spark: SparkSession, text: Column) -> Column:
        """Probability of label 1 for whole texts."""
        # Bounded by the number of features.
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shared.value
            for texts in batches:
                held, size = [], 0
                odds = [np.empty(0)]
                for text in texts:
                    held.append(text.as_py())
                    size += len(held[-1] or "")
                    if size >= SLICE_BYTES:
                        odds.append(model.odds(held))
                        held, size = [], 0
                odds.append(model.odds(held) if held else np.empty(0))
                yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(odds), -500, 500))))

        return scored(text)


def select(sample: DataFrame, others: int, toxic: int) -> Features:
    """The n-grams whose ratio speaks for most, counted over all texts of a bounded sample (label, text)."""

    def held(batches):
        for batch in batches:
            labels = batch["label"].to_pylist()
            found = [[np.unique(grams(t.as_py())) for t, label in zip(batch["text"], labels, strict=True) if label == k] for k in (0, 1)]
            each = [np.unique(np.concatenate(x or [np.empty(0, np.uint64)]), return_counts=True) for x in found]
            for column, (codes, counts) in enumerate(each):
                none = np.zeros(len(codes), np.int64)
                arrays = [codes.view(np.int64), *((counts, none) if column == 0 else (none, counts))]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["code", "q", "p"])

    counts = sample.select("label", "text").mapInArrow(held, "code long, q long, p long")
    counts = counts.groupBy("code").agg(F.sum("q").alias("q"), F.sum("p").alias("p")).where(F.col("q") + F.col("p") >= FEWEST_TEXTS)
    ratio = log_count_ratio(F.col("p"), F.col("q"), toxic, others)
    weight = F.abs(ratio) * F.sqrt(F.col("p") / toxic + F.col("q") / others)
    kept = counts.withColumns({"ratio": ratio, "weight": weight}).orderBy(F.desc("weight"), "code").limit(FEATURES).collect()
    kept = sorted((int(np.int64(r["code"]).view(np.uint64)), r["ratio"]) for r in kept)
    return Features(np.array([c for c, _ in kept], np.uint64), np.array([r for _, r in kept]))


def _table(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Labels, and the text, feature and value of each feature of the texts."""
    ids, values = batch["ids"], batch["values"]
    sizes = np.diff(ids.offsets.to_numpy())
    labels = batch["label"].to_numpy(zero_copy_only=False)
    return labels, np.repeat(np.arange(len(sizes)), sizes), ids.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy()


def fit(sample: DataFrame, shares: tuple[int, int]) -> ToxicityModel:
    """Fit on the ``label`` and ``text`` of a bounded sample; ``shares`` counts all labelled rows of either class."""
    none = Features(np.empty(0, np.uint64), np.empty(0))
    negative, positive = shares
    if not negative or not positive:
        return ToxicityModel(none, np.empty(0), 500.0 if positive else -500.0)
    n_q, n_p = class_counts(sample)
    if not n_q or not n_p:
        return ToxicityModel(none, np.empty(0), float(np.log(positive / negative)))
    features = select(sample, n_q, n_p)
    spark = sample.sparkSession
    chosen = spark.sparkContext.broadcast(features)

    def listed(batches):
        for batch in batches:
            of, feature, value = chosen.value.values(batch["text"].to_pylist())
            offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=batch.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (feature.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([batch["label"], *lists], ["label", "ids", "values"])

    rows = checkpointed(sample.select("label", "text").mapInArrow(listed, "label int, ids array<int>, values array<double>"))
    count = len(features.codes)
    weights, intercept = np.zeros(count), 0.0
    squares = np.full(count + 1, 1e-8)
    for _ in range(STEPS):
        state = spark.sparkContext.broadcast((weights, intercept))

        def slope(batch, state=state):
            by_feature, constant = state.value
            labels, of, ids, values = _table(batch)
            sums = np.bincount(of, by_feature[ids] * values, len(labels)) + constant
            # Both classes weigh the same.
            error = (1 / (1 + np.exp(-np.clip(sums, -500, 500))) - labels) / np.where(labels, n_p, n_q) / 2
            return np.append(np.bincount(ids, error[of] * values, count), error.sum())

        gradient = partition_sums(rows, slope)
        gradient[:-1] += PENALTY * weights
        squares += gradient**2
        change = gradient / np.sqrt(squares) * RATE
        weights, intercept = weights - change[:-1], intercept - change[-1]
        state.unpersist()
    return ToxicityModel(features, weights, float(intercept + np.log(positive / negative) / 2))


def train(documents: DataFrame, labels: DataFrame, keep: Column, rows_per_class: int = ROWS_PER_CLASS) -> ToxicityModel:
    """Fit on a sample of the labelled documents that ``keep`` admits."""
    sample = checkpointed(labelled_sample(documents, labels, "toxic", keep, rows_per_class))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & keep)
    return fit(sample, class_counts(known.select(F.col("toxic").alias("label"))))
