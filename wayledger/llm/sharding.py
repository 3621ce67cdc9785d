"""Shuffling records into shards in two passes: scatter into buckets, then permute each bucket.

Pass one sends every record to one of many buckets by a seeded hash of its key, so a bucket is a uniform sample of
all records and small enough for one task.  Pass two permutes each bucket by Fisher-Yates (Spark's ``shuffle`` of the
positions) and lays the buckets one after another; shard s takes the positions from floor(s*N/S) to
floor((s+1)*N/S) - 1, so shard sizes differ by at most one record and each bucket lies in few shards.

The order depends on the seed, the keys and the number of buckets, not on the layout of the input: a lost task gives
the same rows again.  Records with the same key go to the same bucket, so the key should tell records apart;
records equal in every key column are interchangeable.  Null keys and null or empty texts are ordinary values, an
empty table gives no rows.  Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wayledger.session import checkpointed

BUCKET_BYTES = 64 << 20
#: What a record takes besides its text: its key, its place and its position among those that are drawn.
RECORD_BYTES = 64
#: Buckets per block of the running totals.
BLOCK = 4096
#: A task takes one bucket, or several one after another where there are more than this.
MOST_TASKS = 100_000


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null, and one for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def count_buckets(records: DataFrame, size: Column, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of at most about ``bucket_bytes`` of records, and no fewer than there are shuffle partitions."""
    total = records.agg(F.sum(size + RECORD_BYTES)).first()[0] or 0
    return max(-(-total // bucket_bytes), int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _offsets(counts: DataFrame) -> DataFrame:
    """First position of each bucket, by totals of blocks of buckets and totals within a block."""
    block = F.expr(f"_bucket div {BLOCK}")
    counts = counts.withColumn("_block", block)
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = counts.groupBy("_block").agg(F.sum("_n").alias("_total"))
    # One row per BLOCK buckets, each of many MB of records.
    starts = totals.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy("_block").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("_n").over(within), F.lit(0))
    first = (F.col("_start") + F.col("_inner")).alias("_first")
    return counts.withColumn("_inner", inner).join(starts, "_block").select("_bucket", "_n", first)


def shuffle_into_shards(
    records: DataFrame,
    key: list[str],
    shards: int,
    buckets: int,
    seed: int = 0,
    shard: str = "shard",
    slot: str = "slot",
) -> DataFrame:
    """All records with their shard and, from 0 without gaps, their place in it.

    ``key`` names the columns that tell records apart.  Columns of ``records`` named like ``shard`` or ``slot`` give
    way to the new ones.
    """
    records = records.drop(shard, slot)
    # A null and an absent value hash alike, so nulls get a place of their own.
    parts = [x for c in key for x in (F.col(c), F.col(c).isNull())]
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), *parts), F.lit(buckets)).cast("int")
    counts = checkpointed(records.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    # An explicit number of partitions: Fisher-Yates draws from the seed and the partition's number.
    tasks = min(buckets, MOST_TASKS)
    rows = F.struct(*[F.col(c) for c in records.columns]).alias("_shuffle_row")
    order = F.xxhash64(F.lit(seed), F.lit("order"), *parts).alias("_order")
    # Within a bucket the hash order stands for the order of arrival, which retries would change.
    arrival = W.partitionBy("_bucket").orderBy("_order", *[f"_shuffle_row.{c}" for c in key])
    scattered = records.select(rows, bucket.alias("_bucket"), order).repartition(tasks, "_bucket")
    scattered = scattered.withColumn("_at", (F.row_number().over(arrival) - 1).cast("int")).drop("_order")
    drawn = F.shuffle(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int")), F.lit(seed)).alias("_drawn")
    placed = _offsets(counts).repartition(tasks, "_bucket").sortWithinPartitions("_bucket")
    permuted = placed.select("_bucket", "_first", drawn).select("_bucket", "_first", F.posexplode("_drawn").alias("_at", "_to"))
    place = (F.col("_first") + F.col("_to")).alias("_place")
    # Both sides lie by bucket, so the merge join moves nothing; a broadcast would grow with the records.
    found = scattered.join(permuted.hint("merge"), ["_bucket", "_at"]).select("_shuffle_row", place)
    # Whole-number division, exact at any size.
    found = found.withColumn("_shard", F.expr(f"({shards} * (_place + 1) - 1) div greatest({total}, 1)"))
    within = F.expr(f"_place - (_shard * {total}L) div {shards}").alias(slot)
    return found.select("_shuffle_row.*", F.col("_shard").cast("int").alias(shard), within)


def write_shards(shuffled: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder per shard; files hold rows in order of their slot."""
    shuffled.sortWithinPartitions(shard, slot).write.mode("overwrite").partitionBy(shard).parquet(path)
