"""Shopping lists kept current from a stream of row changes.

Each micro-batch is reduced to the last change per item and appended to a change log,
partitioned by list bucket; the current table is the log reduced once more.  A replayed
batch rewrites its own folder, so every change counts once.  The last write, by event time and then event id, wins.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wayledger.operators.shopping import budget_status, category_rollup
from wayledger.schemas import schema

BUCKETS = 64
#: What a change carries besides the columns of its table.
META = "event_id LONG, ts TIMESTAMP, op STRING"
TABLE = "buylist_items"
#: The change that a starting snapshot's rows count as: before every event.
SNAPSHOT = {"event_id": -1, "ts": "1970-01-01 00:00:00", "op": "insert"}


def change_schema(table: str = TABLE) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(META), *schema(table)])


def read_changes(spark: SparkSession, path: str, schema: str | T.StructType, files: str = "*.parquet") -> DataFrame:
    """File-source stream with a declared schema."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(path)


def change_feed(raw: DataFrame, table: str = TABLE) -> DataFrame:
    """Typed changes of one table: event id, time, kind and all its columns, null where the source lacks one.

    Event time becomes an instant, as watermarks need one.
    """
    present = set(raw.columns)
    return raw.select(
        *[(F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in change_schema(table)]
    )


def as_changes(snapshot: DataFrame, table: str = TABLE) -> DataFrame:
    """A table as changes older than every event."""
    return change_feed(snapshot.withColumns({name: F.lit(value) for name, value in SNAPSHOT.items()}), table)


def deduped_changes(feed: DataFrame, delay: str) -> DataFrame:
    """Drop redelivered events that arrive within ``delay`` of the first, and all events later than that."""
    return feed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def latest(changes: DataFrame) -> DataFrame:
    """The last change per item; partial aggregation keeps one row per item and task."""
    fields = [c for c in changes.columns if c != "id"]
    last = F.max_by(F.struct(*fields), F.struct("ts", "event_id")).alias("_last")
    return changes.groupBy("id").agg(last).select("id", "_last.*").select(*changes.columns)


def present(changes: DataFrame) -> DataFrame:
    """Current rows of a change history: the last change per item, deleted items left out."""
    return latest(changes).where(F.col("op") != "delete")


class Epochs:
    """Folders of what each micro-batch wrote, in epochs of ``fold_every``.

    At its end an epoch is reduced into the first entry of the next one, so readers only ever list and read one epoch.
    """

    def __init__(self, spark: SparkSession, folder: str, fold_every: int = 100):
        self.spark = spark
        self.folder = folder
        self.fold_every = fold_every
        self.marks = f"{folder}/finished_epochs"

    def _path(self, kind: str, epoch: int, batch_id: int | None = None) -> str:
        path = f"{self.folder}/{kind}/epoch={epoch}"
        return path if batch_id is None else f"{path}/batch={batch_id}"

    def epoch(self) -> int:
        """The epoch readers use: the one after the last that was folded and marked."""
        try:
            return self.spark.read.schema("epoch LONG").parquet(self.marks).agg(F.max("epoch")).first()[0] + 1
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return 0
            raise

    def _keep(self, kind: str, rows: DataFrame, epoch: int, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(self._path(kind, epoch, batch_id))

    def _mark(self, epoch: int) -> None:
        self.spark.range(epoch, epoch + 1).toDF("epoch").write.mode("append").parquet(self.marks)


class LiveLists(Epochs):
    """The change log of one deployment and the tables read from it.

    ``buckets`` is the number of folders that an epoch's lists are spread over; it stays as it was at the start.
    An item keeps its list: the changes of one list are all there is to know of its items.
    """

    def __init__(self, spark: SparkSession, folder: str, fold_every: int = 100, buckets: int = BUCKETS, table: str = TABLE):
        super().__init__(spark, folder, fold_every)
        self.buckets = buckets
        self.table = table

    def history(self, buckets: list[int] | None = None) -> DataFrame:
        """The changes that can still decide a row; ``buckets`` prunes the folders read."""
        logged = T.StructType([*change_schema(self.table)]).add("batch", T.LongType()).add("list_bucket", T.IntegerType())
        rows = self.spark.read.schema(logged).parquet(self._path("changes", self.epoch()))
        if buckets is not None:
            rows = rows.where(F.col("list_bucket").isin(buckets))
        return rows.drop("batch", "list_bucket")

    def current_items(self, buckets: list[int] | None = None) -> DataFrame:
        return present(self.history(buckets))

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Log one micro-batch; running it again for the same id changes nothing."""
        self._log(latest(batch), batch_id // self.fold_every, batch_id)

    def _log(self, changes: DataFrame, epoch: int, batch_id: int) -> None:
        # Few files per bucket, more where a bucket is large.
        bucket = F.pmod(F.hash("list_id"), F.lit(self.buckets))
        spread = changes.withColumn("list_bucket", bucket).hint("rebalance", F.col("list_bucket"))
        spread.write.mode("overwrite").partitionBy("list_bucket").parquet(self._path("changes", epoch, batch_id))

    def seed(self, snapshot: DataFrame, budget: DataFrame | None = None) -> None:
        """Begin with the rows that a table holds already; to be called before the first batch."""
        self._log(latest(as_changes(snapshot, self.table)), 0, -1)
        if budget is not None:
            self._refresh(0, -1, budget)

    def refresh(self, batch_id: int, budget: DataFrame) -> None:
        """Recompute budget and categories of just the lists a logged batch touched."""
        self._refresh(batch_id // self.fold_every, batch_id, budget)

    def _refresh(self, epoch: int, batch_id: int, budget: DataFrame) -> None:
        logged = self.spark.read.parquet(self._path("changes", epoch, batch_id))
        touched = logged.select("list_id", "list_bucket").distinct()
        # At most as many small numbers as there are buckets; they prune the folders of the log that are read.
        buckets = [r.list_bucket for r in touched.select("list_bucket").distinct().collect()]
        lists = touched.select("list_id")
        # Only changes of the touched lists are reduced, once for both results.
        items = present(self.history(buckets).join(lists, "list_id", "left_semi")).persist()
        try:
            status = budget_status(budget.join(lists, "list_id", "left_semi"), items)
            # A touched list with neither budget nor items left still gets its empty state.
            status = lists.join(status, "list_id", "left").fillna("none", ["status"])
            self._keep("budgets", status, epoch, batch_id)
            self._keep("rollups", category_rollup(items), epoch, batch_id)
        finally:
            items.unpersist()

    def fold(self, batch_id: int, with_budget: bool) -> None:
        """End the epoch of ``batch_id``; readers move on once its mark is written."""
        epoch = batch_id // self.fold_every
        if epoch < self.epoch():
            return
        self._log(latest(self.history()), epoch + 1, batch_id)
        if with_budget:
            self._keep("budgets", self.live_budget(), epoch + 1, batch_id)
            self._keep("rollups", self.live_rollup(), epoch + 1, batch_id)
        self._mark(epoch)

    def live_budget(self) -> DataFrame:
        """Status of every list as of the last batch that touched it."""
        rows = self.spark.read.parquet(self._path("budgets", self.epoch()))
        fields = [c for c in rows.columns if c not in ("list_id", "batch")]
        last = F.max_by(F.struct(*fields), "batch").alias("_last")
        return rows.groupBy("list_id").agg(last).select("list_id", "_last.*")

    def live_rollup(self) -> DataFrame:
        """Categories of every list as of the last batch that touched it."""
        epoch = self.epoch()
        touched = self.spark.read.parquet(self._path("budgets", epoch)).groupBy("list_id").agg(F.max("batch").alias("batch"))
        rows = self.spark.read.parquet(self._path("rollups", epoch))
        return rows.join(touched, ["list_id", "batch"], "left_semi").drop("batch")

    def take(self, batch: DataFrame, batch_id: int, budget: DataFrame | None = None) -> None:
        """Everything done for one micro-batch; safe to repeat after a failure."""
        self.append(batch, batch_id)
        if batch_id // self.fold_every < self.epoch():
            return  # repeated after its epoch was folded
        if budget is not None:
            self.refresh(batch_id, budget)
        if (batch_id + 1) % self.fold_every == 0:
            self.fold(batch_id, budget is not None)

    def start(self, changes: DataFrame, budget: DataFrame | None = None) -> StreamingQuery:
        """Process what the source holds now, then stop; run again to go on."""
        sink = changes.writeStream.foreachBatch(lambda batch, batch_id: self.take(batch, batch_id, budget))
        return sink.option("checkpointLocation", f"{self.folder}/checkpoints").trigger(availableNow=True).start()
