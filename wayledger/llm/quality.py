"""Text quality: a ridge fit on random Fourier features of document statistics, calibrated by isotonic regression.

Each whole text gives a vector of statistics (lengths, shares of character classes, repetition, lines).  Random
cosines of the standardised vector approximate a Gaussian kernel; the ridge weights solve normal equations whose
matrices are summed over the sample's partitions.  Scores of the part of the sample that the fit hasn't seen are
pooled into a rising step function (isotonic regression), which makes a score of any text a probability.

Null texts count as empty ones; these have all statistics 0 and get the score of that vector.  Without labelled rows
of both classes every score is the share of label 1 (0 if there are no labels).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayledger.llm.training import labelled_sample, partition_sums
from wayledger.session import checkpointed

#: The sample's bound for each class.
ROWS_PER_CLASS = 10_000
COSINES = 300
WIDTH = 4.0
RIDGE = 1e-3
#: The part of the sample that calibrates instead of fitting.
CALIBRATION = 0.4
BINS = 1_000

_CLASSES = np.zeros(256, np.int64)
for _class, _bytes in enumerate(
    (b" \t", b"\n\r", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:?'\"-()", b"!", b"|", b"#$%&*@^~=+<>[]{}/\\_`"), 1
):
    _CLASSES[list(_bytes)] = _class
_CLASSES[128:] = 10


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text; all 0 for an empty one."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return np.zeros(25)
    data = np.frombuffer(raw, np.uint8)
    classes = np.bincount(_CLASSES[data], minlength=11) / len(data)
    shares = np.bincount(data, minlength=256) / len(data)
    shares = shares[shares > 0]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    times = np.fromiter(counts.values(), np.int64, len(counts))
    follows = sum(map(bytes.__eq__, words, words[1:]))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated = sum(len(x) * (n - 1) for x, n in Counter(lines).items())
    n = len(words)
    rest = (
        np.log1p(len(data)),
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        len(counts) / n,
        np.log(len(counts) + 1) / np.log(n + 1),
        times.max() / n,
        (times / n * np.log(n / times)).sum(),
        follows / n,
        repeated / len(data),
        np.log1p(len(data) / len(lines)),
        -(shares * np.log(shares)).sum(),
        np.mean(lengths > 15),
        np.mean(lengths <= 3),
    )
    return np.concatenate([classes, rest])


def statistics_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return counted(text)


def cosines(vectors: np.ndarray, mean: np.ndarray, spread: np.ndarray, seed: int = 0) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel of ``WIDTH``, and a constant."""
    draw = np.random.default_rng(seed)
    frequencies = draw.normal(size=(vectors.shape[1], COSINES)) / WIDTH
    phases = draw.uniform(0, 2 * np.pi, COSINES)
    scaled = np.clip((vectors - mean) / spread, -8, 8)
    return np.hstack([np.cos(scaled @ frequencies + phases) * np.sqrt(2 / COSINES), np.ones((len(vectors), 1))])


def pooled(scores: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of label shares on ascending scores: the middles of the pools and their shares."""
    pools: list[list[float]] = []
    for score, one, count in zip(scores, ones, counts, strict=True):
        pools.append([score * count, one, count])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    array = np.array(pools)
    return array[:, 0] / array[:, 2], array[:, 1] / array[:, 2]


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    shares: np.ndarray

    def raw(self, vectors: np.ndarray) -> np.ndarray:
        return cosines(vectors, self.mean, self.spread) @ self.weights

    def score(self, spark: SparkSession, text: Column) -> Column:
        """Probability of label 1 for whole texts."""
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shared.value
            for texts in batches:
                out = np.empty(len(texts))
                for low in range(0, len(texts), 512):
                    vectors = np.array([statistics(t.as_py()) for t in texts[low : low + 512]])
                    out[low : low + 512] = np.interp(model.raw(vectors), model.steps, model.shares)
                yield pa.array(out)

        return scored(text)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch["stats"].flatten().to_numpy().reshape(batch.num_rows, -1)


def fit(sample: DataFrame, share: float) -> QualityModel:
    """Fit on ``label``, ``text`` and ``place`` (uniform in [0, 1), its low part calibrates) of a bounded sample.

    ``share`` is the share of label 1 among all labelled rows, which the sample's classes are weighted to.
    """
    rows = checkpointed(sample.select("label", "place", statistics_column(F.col("text")).alias("stats")))
    # Within a class, places are uniform over what the sample took of it.
    tops = {row["label"]: (row["top"], row["n"]) for row in rows.groupBy("label").agg(F.max("place").alias("top"), F.count("*").alias("n")).collect()}
    if set(tops) != {0, 1}:
        size = len(statistics(None))
        return QualityModel(np.zeros(size), np.ones(size), np.zeros(COSINES + 1), np.zeros(1), np.full(1, float(1 in tops)))
    ends = {k: CALIBRATION * top for k, (top, _) in tops.items()}
    weight = {1: share / tops[1][1], 0: (1 - share) / tops[0][1]}
    fitted = F.col("place") > F.when(F.col("label") == 1, ends[1]).otherwise(ends[0])

    def moments(batch):
        vectors = _vectors(batch)
        return np.concatenate([vectors.sum(0), (vectors**2).sum(0), [len(vectors)]])

    sums = partition_sums(rows, moments)
    size = len(sums) // 2
    mean = sums[:size] / sums[-1]
    spread = np.sqrt(np.maximum(sums[size:-1] / sums[-1] - mean**2, 1e-12))

    def normal(batch):
        labels = batch["label"].to_numpy(zero_copy_only=False)
        points = cosines(_vectors(batch), mean, spread)
        weighted = points * np.where(labels == 1, weight[1], weight[0])[:, None]
        return np.hstack([points.T @ weighted, (weighted.T @ labels)[:, None]]).ravel()

    sums = partition_sums(rows.where(fitted), normal)
    if sums is None:
        sums = partition_sums(rows, normal)
    sums = sums.reshape(COSINES + 1, COSINES + 2)
    matrix, right = sums[:, :-1], sums[:, -1]
    weights = np.linalg.solve(matrix + RIDGE * matrix.trace() / len(matrix) * np.eye(len(matrix)), right)
    model = QualityModel(mean, spread, weights, np.zeros(1), np.zeros(1))

    def binned(batch):
        raw = np.clip(model.raw(_vectors(batch)), -0.5, 1.5)
        labels = batch["label"].to_numpy(zero_copy_only=False)
        each = np.where(labels == 1, weight[1], weight[0])
        place = np.minimum(((raw + 0.5) / 2 * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(place, w, BINS) for w in (each * raw, each * labels, each)])

    held = partition_sums(rows.where(~fitted), binned)
    if held is None:
        held = partition_sums(rows, binned)
    totals, ones, counts = held.reshape(3, BINS)
    some = counts > 0
    model.steps, model.shares = pooled(totals[some] / counts[some], ones[some], counts[some])
    return model


def train(documents: DataFrame, labels: DataFrame, keep: Column, rows_per_class: int = ROWS_PER_CLASS) -> QualityModel:
    """Fit on a sample of the labelled documents that ``keep`` admits."""
    sample = labelled_sample(documents, labels, "quality", keep, rows_per_class)
    share = labels.where(F.col("doc_id").isNotNull() & keep).agg(F.avg("quality")).first()[0]
    return fit(sample, 0.0 if share is None else float(share))
