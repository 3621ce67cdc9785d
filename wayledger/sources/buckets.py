"""Tables kept in buckets of their ids, so that a batch of changes rewrites only the buckets it touches."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayledger.schemas import schema
from wayledger.session import remove, shuffles_dropped

BUCKETS = 1_024
#: Requests that are broadcast together at most, the bytes of text for which one counts once more, and groups of buckets that
#: are made at the same time.
TOGETHER, TEXT_BYTES, AT_ONCE = 500_000, 100, 4


class BucketedTable:
    """One table in ``folder``, a sub-folder for each bucket of ``id``.

    ``buckets`` stays as it was when the table was created.  A batch is staged beside the buckets first and then moved into
    place bucket by bucket; if that is interrupted, ``publish`` with the staged folder does the rest.  One writer at
    a time; a reader that started before a batch may have to start again.
    """

    def __init__(self, spark: SparkSession, folder: str, table: str, buckets: int = BUCKETS):
        self.spark = spark
        self.folder = folder
        self.schema = schema(table)
        self.buckets = buckets

    def _bucket(self, id_: Column) -> Column:
        return F.pmod(F.xxhash64(id_), F.lit(self.buckets)).cast("int")

    def _spread(self, rows: DataFrame) -> DataFrame:
        # One file for each bucket, more where a bucket is large.
        return rows.withColumn("bucket", self._bucket(F.col("id"))).hint("rebalance", F.col("bucket"))

    def _shaped(self, rows: DataFrame) -> DataFrame:
        """The declared columns; those that the rows lack are null."""
        present = set(rows.columns)
        return rows.select(*[(F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])

    def _write(self, rows: DataFrame, folder: str) -> None:
        with shuffles_dropped(self.spark):
            rows.write.mode("errorifexists").option("compression", "zstd").partitionBy("bucket").parquet(folder)

    def create(self, rows: DataFrame) -> None:
        self._write(self._spread(self._shaped(rows)), self.folder)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema]).add("bucket", T.IntegerType())).parquet(self.folder)

    def read(self, ids: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the buckets that the ``id`` values of a batch lie in."""
        rows = self._stored()
        if ids is not None:
            rows = rows.where(F.col("bucket").isin(self.touched(ids)))
        return rows.drop("bucket")

    def touched(self, ids: DataFrame) -> list[int]:
        """The buckets of some ids: at most as many small numbers as there are buckets."""
        return sorted(r[0] for r in ids.where("id is not null").select(self._bucket(F.col("id"))).distinct().collect())

    def apply(self, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Put ``change`` of the touched buckets' rows in their place; rows must keep their ids.  Gives the buckets."""
        touched = self.touched(ids)
        if not touched:
            return touched
        staged = self._staging()
        rows = self._stored().where(F.col("bucket").isin(touched)).drop("bucket")
        self._write(self._spread(self._shaped(change(rows))), f"{staged}/rows")
        self.publish(staged, touched)
        return touched

    def _staging(self) -> str:
        # In the table's own store, where a folder can be moved; readers pass over names that begin with "_".
        return f"{self.folder}/_staged-{uuid.uuid4().hex}"

    def apply_requests(
        self, requests: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], key: str = "id", together: int = TOGETHER
    ) -> list[int]:
        """``apply`` for a change that meets each row with the requests of its id, in the column ``key``, and nothing else.

        The requests are stored by bucket and ``change(rows, requests)`` made for some buckets at a time.  Those of up to
        ``together`` requests are broadcast, so that the rows stay in the tasks that read them; a bucket with more is
        joined alone.  Either way the rows needn't be dealt to their buckets again.  All is staged before any is moved.
        """
        staged = self._staging()
        asked = requests.where(F.col(key).isNotNull()).withColumn("_bucket", self._bucket(F.col(key)))
        with shuffles_dropped(self.spark):
            asked.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{staged}/requests")
        asked = self.spark.read.schema(asked.schema).parquet(f"{staged}/requests")
        texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in asked.schema if f.dataType == T.StringType()]
        weight = F.lit(1) + F.floor(sum(texts, F.lit(0)) / TEXT_BYTES)
        counts = dict(asked.groupBy("_bucket").agg(F.sum(weight)).collect())
        groups: list[list[int]] = []
        for bucket in sorted(counts):
            if groups and sum(counts[b] for b in groups[-1]) + counts[bucket] <= together:
                groups[-1].append(bucket)
            else:
                groups.append([bucket])

        def make(number: int) -> None:
            group = groups[number]
            rows = self._stored().where(F.col("bucket").isin(group)).drop("bucket")
            part = asked.where(F.col("_bucket").isin(group)).drop("_bucket")
            few = sum(counts[b] for b in group) <= together
            made = self._shaped(change(rows, F.broadcast(part) if few else part))
            self._write(made.withColumn("bucket", self._bucket(F.col("id"))), f"{staged}/made/{number}")

        with shuffles_dropped(self.spark), ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(make), range(len(groups))))
        if groups:
            self._gather(staged, groups)
            self.publish(staged, sorted(counts))
        else:
            remove(self.spark, staged)
        return sorted(counts)

    def _gather(self, staged: str, groups: list[list[int]]) -> None:
        """The folders of all groups as one, which is there as a whole or not at all."""
        path, store = self._store(staged)
        store.mkdirs(path(f"{staged}/gathered"))
        moves = [(f"made/{n}/bucket={b}", f"gathered/bucket={b}") for n, group in enumerate(groups) for b in group]
        for source, target in [*moves, ("gathered", "rows")]:
            source, target = path(f"{staged}/{source}"), path(f"{staged}/{target}")
            if store.exists(source) and not store.rename(source, target):
                raise OSError(f"{source} could not be moved to {target}")

    def _store(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def publish(self, staged: str, touched: list[int]) -> None:
        """Move staged buckets into place; those that were touched and have no rows left go.

        What is still staged is what is still to be done, so buckets without rows get an empty folder before any is moved.
        """
        path, store = self._store(staged)
        rows, done = path(f"{staged}/rows"), path(f"{staged}/listed")
        if store.exists(rows) and not store.exists(done):
            for bucket in touched:
                store.mkdirs(path(rows, f"bucket={bucket}"))
            store.mkdirs(done)
        for bucket in touched:
            source, target = path(rows, f"bucket={bucket}"), path(f"{self.folder}/bucket={bucket}")
            if not store.exists(source):
                continue
            store.delete(target, True)
            if store.listStatus(source):
                if not store.rename(source, target):
                    raise OSError(f"{source} could not be moved to {target}")
            else:
                store.delete(source, True)
        # The list goes last: without it, missing folders would be made again.
        store.delete(rows, True)
        remove(self.spark, staged)
