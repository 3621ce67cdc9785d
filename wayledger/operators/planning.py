"""Re-timing of trip days: reorder, cascade and single moves, and appended positions.

Requests come as one row per requested item, so that a request of any length spreads
over tasks; ``request_rows`` turns arrays of ids into that form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.functions import clock
from wayledger.operators.skew import Running, hot_keys, match, ranked, running

DAY = ["trip_id", "day_number"]


def request_rows(requests: DataFrame, ids: str = "ids") -> DataFrame:
    """One row per requested id with its 0-based position."""
    others = [c for c in requests.columns if c != ids]
    return requests.select(*others, F.posexplode(ids).alias("pos", "item_id"))


def next_sort_order(items: DataFrame, days: DataFrame) -> DataFrame:
    """Position after the last item of each asked day, 0 on an empty one."""
    last = items.groupBy(*DAY).agg((F.max("sort_order") + 1).alias("next_sort_order"))
    return days.select(*DAY).distinct().join(last, DAY, "left").fillna(0, ["next_sort_order"])


def reorder_plan(items: DataFrame, requests: DataFrame) -> DataFrame:
    """New times of days put in a new order.

    The day starts at the earliest time of all its timed items; the requested ones follow
    each other by their lengths.  Unknown or untimed ids are passed over but keep their
    position number.  For a repeated id the last mention wins, and every mention moves
    the following ones on.
    """
    timed = items.where(F.col("day_number").isNotNull()).select(
        *DAY,
        F.col("id").alias("item_id"),
        clock.time_to_minutes(F.col("start_time")).alias("_s"),
        clock.overlap_minutes(F.col("duration_minutes")).alias("_d"),
    )
    timed = timed.where(F.col("_s").isNotNull())
    opening = timed.groupBy(*DAY).agg(F.min("_s").alias("_first"))
    asked = requests.join(timed.drop("_s"), [*DAY, "item_id"])
    order = [F.col("pos"), F.col("item_id")]
    gone = {"_gone": Running("sum", "_d", inclusive=False)}
    chained = running(asked, DAY, order, gone, hot_keys(requests, DAY))
    start = F.col("_first") + F.coalesce("_gone", F.lit(0))
    placed = chained.join(opening, DAY).withColumn("_start", start)
    last = placed.groupBy(*DAY, "item_id").agg(
        F.max_by("_start", "pos").alias("_start"), F.max("pos").alias("sort_order")
    )
    new_time = clock.minutes_to_time(F.col("_start")).alias("start_time")
    return last.select(*DAY, F.col("item_id").alias("id"), new_time, "sort_order")


def cascade_plan(items: DataFrame, requests: DataFrame, picks: DataFrame) -> DataFrame:
    """New times of a target and of the items picked to move with it.

    A request whose target is missing or has no time, or whose new time can't be read, gives one row with ``error`` set.
    """
    times = items.select("trip_id", F.col("id"), "start_time", clock.time_to_minutes(F.col("start_time")).alias("_s"))
    targets = times.select("trip_id", F.col("id").alias("target_id"), "_s", F.lit(True).alias("_known"))
    resolved = requests.join(targets, ["trip_id", "target_id"], "left")
    error = (
        F.when(F.col("_known").isNull(), "unknown_target").when(F.col("_s").isNull(), "untimed_target").when(bad_time(), "bad_time")
    )
    resolved = resolved.withColumn("error", error).withColumn(
        "delta_minutes", F.when(F.col("error").isNull(), clock.time_to_minutes(F.col("new_time")) - F.col("_s"))
    )
    ahead = resolved.select(
        "request_id",
        F.when(F.col("error").isNull(), F.col("target_id")).alias("id"),
        F.when(F.col("error").isNull(), F.col("new_time")).alias("start_time"),
        "delta_minutes",
        "error",
        F.lit(True).alias("is_target"),
    )
    going = resolved.where(F.col("error").isNull()).select("request_id", "trip_id", "target_id", "delta_minutes")
    along = (
        picks.select("request_id", F.col("item_id").alias("id"))
        .distinct()
        .join(going, "request_id")
        .where(F.col("id") != F.col("target_id"))
        .join(times.where(F.col("_s").isNotNull()).drop("start_time"), ["trip_id", "id"])
    )
    shifted = along.select(
        "request_id",
        "id",
        clock.minutes_to_time(F.col("_s") + F.col("delta_minutes")).alias("start_time"),
        "delta_minutes",
        F.lit(None).cast("string").alias("error"),
        F.lit(False).alias("is_target"),
    )
    return ahead.unionByName(shifted)


def bad_time() -> Column:
    """Whether a request's new time is missing or no time of day."""
    return ~clock.valid_time(F.col("new_time"), "suggestion")


def single_plan(requests: DataFrame) -> DataFrame:
    """Move one item, leave the rest; a time that can't be read gives a row with ``error`` set and no time."""
    error = F.when(bad_time(), F.lit("bad_time"))
    time = F.when(~bad_time(), F.col("new_time")).alias("start_time")
    return requests.select("request_id", F.col("item_id").alias("id"), time, error.alias("error"), F.lit(True).alias("is_target"))


def append_sort_order(items: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Positions for new items behind the present ones of their day, in batch order."""
    dated = batch.where(F.col("day_number").isNotNull())
    base = items.groupBy(*DAY).agg(F.max("sort_order").alias("_last"))
    placed = ranked(dated, DAY, [F.col(order).asc()], "_k")
    placed = match(placed, base, DAY, "left")
    position = (F.coalesce("_last", F.lit(-1)) + F.col("_k")).cast("int")
    placed = placed.withColumn("sort_order", position).drop("_last", "_k")
    return placed.unionByName(batch.where(F.col("day_number").isNull()).withColumn("sort_order", F.lit(0)))
