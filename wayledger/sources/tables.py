"""Reading and writing the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayledger.schemas import DEFAULTS, schema


def read_table(spark: SparkSession, path: str, table: str | T.StructType) -> DataFrame:
    """Load one table with its declared schema; columns the files lack come back null."""
    declared = schema(table) if isinstance(table, str) else table
    return spark.read.schema(declared).parquet(path)


def fill_defaults(df: DataFrame, table: str) -> DataFrame:
    """Add columns that older data lacks with their defaults and drop unknown ones.

    A null that is present stays null: only an absent column takes its default.
    """
    present = set(df.columns)
    defaults = DEFAULTS[table]
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
            for f in schema(table)
        ]
    )


def write_snapshot(df: DataFrame, path: str, cluster_by: str, then: str = "id") -> None:
    """Write a full table version clustered by the key its readers filter and join on.

    Files cover narrow key ranges, so readers skip the others by their statistics; ``then``
    lets a key with very many rows span several files.
    """
    clustered = df.repartitionByRange(cluster_by, then).sortWithinPartitions(cluster_by, then)
    clustered.write.mode("errorifexists").parquet(path)


def append_log(log: DataFrame, path: str) -> None:
    """Append history rows; history is never rewritten."""
    log.write.mode("append").parquet(path)
