"""Ranks over a whole table and order statistics of hot keys, from counts instead of gathered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayledger.operators.skew import match, salted_lookup
from wayledger.session import checkpointed

#: Parts that a range of values is divided into at each round.
PARTS = 16_384
#: The span of the values that a round may start from: that of whole cents in DECIMAL(12, 2).
LOWEST, HIGHEST = -(10**12), 10**12


def ranked_overall(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of each row in the whole table; ``order`` must be total.

    The rows are range-sorted over the cluster.  A row's position is its place in its partition plus the rows of the
    partitions before, of which the driver adds up one count each.
    """
    spark = df.sparkSession
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).count().collect()
    before, offsets = 0, []
    for row in sorted(counts, key=lambda r: r["_part"]):
        offsets.append((row["_part"], before))
        before += row["count"]
    # One row for each partition.
    table = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return placed.withColumn("_part", part).join(table, "_part").withColumn(name, place).select(*df.columns, name)


def nth_values(rows: DataFrame, key: str, value: Column, nth: Column, spread: str) -> DataFrame:
    """(key, nth value, n) of few keys with very many rows each: the value at place ``nth``, an expression of the count ``n``.

    ``value`` is a whole number in [LOWEST, HIGHEST] and never null.  Each round counts a key's rows in PARTS parts of the
    range where the value must lie, combined in the tasks that read them, and goes on in the part that holds the
    place; a key sends at most PARTS counts, whatever its rows hold, and its rows stay where they are.
    """
    rows = rows.select(key, F.col(spread).alias("_spread"), value.cast("long").alias("_value"))
    bounds = rows.groupBy(key).agg(F.count("*").alias("n"))
    ends = {"_low": F.lit(LOWEST).cast("long"), "_high": F.lit(HIGHEST).cast("long")}
    bounds = checkpointed(bounds.withColumn("_place", nth.cast("long")).withColumns(ends))
    width = HIGHEST - LOWEST + 1
    while width > 1:
        step = -(-width // PARTS)
        part = F.expr(f"(_value - _low) div {step}").alias("_part")
        inside = salted_lookup(rows, bounds.select(key, "_low", "_high"), [key], "_spread", "inner")
        counts = inside.where(F.col("_value").between(F.col("_low"), F.col("_high"))).groupBy(key, part).agg(F.count("*").alias("_rows"))
        upto = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # PARTS rows a key at most.
        sums = counts.withColumn("_upto", F.sum("_rows").over(upto))
        found = match(sums, bounds.select(key, "n", "_place", "_low"), [key], "inner")
        found = found.where("_upto >= _place and _upto - _rows < _place")
        low = F.col("_low") + F.col("_part") * step
        found = found.select(key, "n", (F.col("_place") - F.col("_upto") + F.col("_rows")).alias("_place"), low.alias("_low"))
        bounds = checkpointed(found.withColumn("_high", F.col("_low") + (step - 1)))
        width = step
    return bounds.select(key, F.col("_low").alias("value"), "n")
