"""Compare a Spark result with the same question asked in SQL."""

from __future__ import annotations

import contextlib
import datetime
import decimal
import math
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        db.execute(f"create view {name} as select * from read_parquet('{path}')")
    return db


def plain(value):
    """One spelling per value, whatever client library it came through."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 4)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return str(value)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def sql_rows(db, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), rows_of(columns, cursor.fetchall())


def shuffle_files(spark):
    """Names and bytes of the shuffle files that this session's process has on disk."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    found = {}
    for top in folders:
        for folder, _, names in os.walk(top.getPath()):
            for name in names:
                with contextlib.suppress(FileNotFoundError):
                    if name.startswith("shuffle_"):
                        found[name] = os.path.getsize(f"{folder}/{name}")
    return found


def new_shuffle_bytes(spark, before, most):
    """Bytes of the shuffle files made since, once they are no more than ``most`` or some seconds are over: files go in the background."""
    for _ in range(50):
        made = sum(size for name, size in shuffle_files(spark).items() if name not in before)
        if made <= most:
            break
        time.sleep(0.1)
    return made
