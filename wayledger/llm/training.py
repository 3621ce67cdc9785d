"""What the trained operators share: folds, bounded labelled samples, sums over partitions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.llm.batches import bound_batches

#: Tasks that a bounded sample is spread over.
SAMPLE_TASKS = 16


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, keep: Column, rows_per_class: int, seed: int = 0
) -> DataFrame:
    """Texts with their label (0 or 1), at most about ``rows_per_class`` of each class, taken by a seeded hash of the id.

    ``keep`` says which labelled ids may be used.  A document labelled more than once gets the label that most rows
    give it, 1 on a tie; null ids and labels count for nothing.
    """
    bound_batches(documents.sparkSession)
    votes = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
    votes = votes.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    counts = {row["_label"]: row["count"] for row in votes.groupBy("_label").count().collect()}
    place = F.pmod(F.xxhash64(F.lit(seed), F.lit("sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    shares = [F.when((F.col("_label") == k) & (place < rows_per_class / n), True) for k, n in counts.items()]
    chosen = votes.where(F.coalesce(*shares, F.lit(False)))
    # Two numbers for each of a bounded number of rows, whatever the size of the tables.
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.repartition(SAMPLE_TASKS, "doc_id").select(F.col("_label").alias("label"), "text", place.alias("place"))


def class_counts(labels: DataFrame) -> tuple[int, int]:
    counts = {row["label"]: row["count"] for row in labels.groupBy("label").count().collect()}
    return counts.get(0, 0), counts.get(1, 0)


def partition_sums(rows: DataFrame, add: Callable[[pa.RecordBatch], np.ndarray], kind: str = "f8") -> np.ndarray | None:
    """Sum ``add`` over all batches: at most SAMPLE_TASKS tasks send one array each, of numbers of ``kind``."""

    def summed(batches):
        total = None
        for batch in batches:
            part = add(batch)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([total.astype(kind).tobytes()], pa.binary())})

    parts = rows.coalesce(SAMPLE_TASKS).mapInArrow(summed, "part binary").collect()
    total = None
    for row in parts:
        part = np.frombuffer(row["part"], kind)
        total = part.astype("f8") if total is None else total + part
    return total
