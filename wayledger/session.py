"""Session settings and the shared folder that operators write through."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

HOT_ROWS = "spark.wayledger.hotRows"
PART_ROWS = "spark.wayledger.partRows"
_DEFAULTS = {HOT_ROWS: 2_000_000, PART_ROWS: 10_000}

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join in front of a window keeps its skew split even though that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Automatic broadcasts go by file sizes; in memory the rows take several times as much.
    "spark.sql.sources.fileCompressionFactor": "4.0",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the operators rely on; cluster sizing is left alone."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def setting(spark: SparkSession, key: str) -> int:
    return int(spark.conf.get(key, str(_DEFAULTS[key])))


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one in the warehouse, which is shared too."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/wayledger-shared"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def shared_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written or checkpointed within drops its shuffle files as soon as it ends, not when the driver next
    collects its garbage.  Not for tables that are collected: one that is run again would miss its files.
    """
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder, so later branches read the same rows.

    The option holds for this run alone, as ``df`` itself may have been run before.
    """
    spark = df.sparkSession
    shared_root(spark)
    with shuffles_dropped(spark):
        return df.select("*").checkpoint()


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write once in the shared folder, by columns, so later branches read only the columns they use."""
    folder = shared_folder(df.sparkSession, purpose)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def forget(*tables: DataFrame) -> None:
    """Remove the files of ``checkpointed`` tables that nothing will read again."""
    for df in tables:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            remove(df.sparkSession, file.get())


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
