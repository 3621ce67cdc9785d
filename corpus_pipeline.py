"""The corpus pipeline: stages that each take the documents that the one before kept.

Every stage is written as Parquet to the shared folder and read again, so a lost executor costs at most the stage that
runs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayledger.llm import leaks, near, quality, toxicity
from wayledger.llm.pieces import Pieces
from wayledger.session import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a classifier trained on their labels gives less than an even chance of being toxic."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), F.lit(True))
    return docs.where(model.score(spark, F.col("text")) < 0.5)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a classifier trained on their labels gives at least an even chance of good quality."""
    model = quality.train(docs, _table(spark, sf_dir, "labels"), F.lit(True))
    return docs.where(model.score(spark, F.col("text")) >= 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies: five-word shingles, similarity 0.8 or more.

    Repeated rows (same id and text) become one; a row with a null id stays unless a row with an id is in its group.
    """
    kept = near.near_classes(docs).where("kept").select(F.col("id").alias("_near_kept_id")).distinct()
    left = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_near_kept_id")), "left_semi")
    return left.dropDuplicates(["doc_id", "text"])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of a benchmark item."""
    return leaks.without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document and whether decoding them gives its text back."""
    model = Pieces(spark)
    coded = docs.select("doc_id", "lang", "source", model.checked(F.col("text")).alias("coded"))
    pieces = F.size("coded.ids").alias("n_pieces")
    return coded.select("doc_id", "lang", "source", pieces, "coded.round_trip", "coded.ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, from the ``documents`` of a folder."""
    docs, folder = _table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: Trained classifiers, MinHash and edit distances in windows are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
