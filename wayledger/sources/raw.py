"""Loading raw JSON and CSV text with declared columns; rows that don't fit go to quarantine with a reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayledger.schemas import REQUIRED, schema

UNREADABLE, WRONG_TYPE, MISSING = "unreadable", "wrong_type", "missing_required"
_RAW = "_raw"


@dataclass(frozen=True)
class Loaded:
    """Rows that fit their table, and the text and reason of the others: every line is in one of the two."""

    rows: DataFrame
    quarantine: DataFrame


def _texts(declared: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in declared]).add(_RAW, T.StringType())


def _complete(texts: DataFrame, table: str) -> Loaded:
    """Types are tried column by column, so one bad value tells its column and spoils no other row."""
    declared, broken = schema(table), F.col("_broken")
    typed = {f.name: F.try_to_timestamp(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name).try_cast(f.dataType) for f in declared}
    wrong = [F.when(F.col(n).isNotNull() & c.isNull(), F.lit(f"{WRONG_TYPE}:{n}")) for n, c in typed.items()]
    missing = [F.when(F.col(n).isNull(), F.lit(f"{MISSING}:{n}")) for n in REQUIRED[table]]
    reason = F.coalesce(F.when(broken, F.lit(UNREADABLE)), *wrong, *missing)
    judged = texts.withColumn("reason", reason)
    rows = judged.where("reason is null").select(*[c.alias(n) for n, c in typed.items()])
    return Loaded(rows, judged.where("reason is not null").select(F.col(_RAW).alias("raw"), "reason"))


def read_json_lines(spark: SparkSession, path: str, table: str) -> Loaded:
    """One JSON object a line.  Lines that are no object are unreadable; unknown fields are ignored, absent ones null."""
    lines = spark.read.text(path).select(F.col("value").alias(_RAW)).where(F.trim(_RAW) != "")
    declared = _texts(schema(table))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW, "primitivesAsString": "true"}
    parsed = lines.withColumn("_row", F.from_json(_RAW, declared, options))
    # The reader puts the line in the corrupt-record column if it can't read it; an array is not an object.
    broken = F.col(f"_row.{_RAW}").isNotNull() | F.col("_row").isNull() | ~F.trim(_RAW).startswith("{")
    columns = [F.col(f"_row.{n}").alias(n) for n in schema(table).names]
    return _complete(parsed.select(*columns, _RAW, broken.alias("_broken")), table)


def read_csv_lines(spark: SparkSession, path: str, table: str, header: bool = True) -> Loaded:
    """Columns in the declared order.  Lines with more or fewer of them are unreadable; empty values are null."""
    declared = _texts(schema(table))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW, "escape": '"', "multiLine": "true", "header": str(header).lower()}
    rows = spark.read.schema(declared).options(**options).csv(path)
    names = schema(table).names
    # Whole rows are rebuilt for the quarantine; the corrupt-record column has the text of those that couldn't be read.
    kept = F.coalesce(_RAW, F.to_csv(F.struct(*names)))
    return _complete(rows.select(*names, kept.alias(_RAW), F.col(_RAW).isNotNull().alias("_broken")), table)


def by_reason(loaded: Loaded) -> DataFrame:
    """(reason, n) of all rows, those that fit under ``ok``."""
    ok = loaded.rows.agg(F.lit("ok").alias("reason"), F.count("*").alias("n"))
    return ok.unionByName(loaded.quarantine.groupBy("reason").agg(F.count("*").alias("n")))


def raw_lines(df: DataFrame, spoiled: Column) -> DataFrame:
    """A table as JSON lines, with the text of ``spoiled`` instead where it isn't null."""
    line = F.to_json(F.struct(*[F.col(n) for n in df.columns]), {"timestampFormat": "yyyy-MM-dd HH:mm:ss"})
    return df.select(F.coalesce(spoiled, line).alias("value"))
