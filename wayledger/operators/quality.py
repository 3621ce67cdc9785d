"""Checks over change batches.

A check is a reason column: its name where the row breaks the rule, else null.  The
``find`` form lists the offending rows; ``validate_*`` splits a batch by its first reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayledger.functions import clock
from wayledger.functions.text import js_trim
from wayledger.schemas import REQUIRED, schema

PATCH_KEYS = ("item_id", "to_candidate")
TAG_LENGTH = 60


def reason(name: str, broken: Column) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.lit(name))


def find(batch: DataFrame, check: Column) -> DataFrame:
    return batch.withColumn("reason", check).where(F.col("reason").isNotNull())


def bad_date_range() -> Column:
    return reason("bad_date_range", F.col("end_date") < F.col("start_date"))


def day_out_of_range() -> Column:
    """Needs ``total_days`` of the row's own trip, see ``with_trip`` and ``with_target``."""
    day = F.col("day_number")
    known = F.col("total_days").isNotNull()
    return reason("day_out_of_range", known & ((day < 1) | (day > F.col("total_days"))))


def bad_time() -> Column:
    given = F.col("start_time").isNotNull()
    return reason("bad_time", given & ~clock.valid_time(F.col("start_time"), "strict"))


def bad_duration() -> Column:
    """A length below zero; such items take no part in the overlap rules."""
    return reason("bad_duration", F.col("duration_minutes") < 0)


def time_without_day() -> Column:
    return reason("time_without_day", F.col("start_time").isNotNull() & F.col("day_number").isNull())


def candidate_with_day() -> Column:
    return reason("candidate_with_day", F.col("to_candidate") & F.col("day_number").isNotNull())


def time_on_candidate() -> Column:
    """Needs ``existing_day``, see ``with_target``."""
    day = F.when(~F.coalesce("to_candidate", F.lit(False)), F.coalesce("day_number", "existing_day"))
    return reason("time_on_candidate", F.col("start_time").isNotNull() & day.isNull())


def empty_patch(columns: list[str], candidates: bool = True) -> Column:
    """No field given; going back to candidate is a change too where there are ``candidates``."""
    fields = [F.col(c).cast("string") for c in columns if c not in PATCH_KEYS]
    kept = ~F.coalesce("to_candidate", F.lit(False)) if candidates else F.lit(True)
    return reason("empty_patch", kept & F.coalesce(*fields).isNull())


def unknown_id() -> Column:
    """Needs ``known``, see ``with_trip`` and ``with_target``."""
    return reason("unknown_id", F.col("known").isNull())


def bad_status() -> Column:
    known = F.lower(js_trim(F.col("status"))).isin("pending", "purchased")
    return reason("bad_enum", ~known)


def bad_urgency() -> Column:
    return reason("bad_enum", ~F.col("urgency").isin("need", "want", "maybe"))


def bad_enum() -> Column:
    return F.coalesce(bad_status(), bad_urgency())


def missing_required(table: str, columns: list[str]) -> Column:
    absent = [F.lit(True) if c not in columns else F.col(c).isNull() for c in REQUIRED[table]]
    return F.coalesce(*[reason("missing_required", a) for a in absent])


def bad_rating() -> Column:
    scores = [F.coalesce(F.col(c), F.lit(0)).between(1, 5) for c in ("spiciness", "aroma", "cp", "repurchase")]
    return F.coalesce(blank_name("bad_rating"), *[reason("bad_rating", ~s) for s in scores])


def blank_name(name: str = "blank_name") -> Column:
    return reason(name, js_trim(F.coalesce("name", F.lit(""))) == "")


def bad_tag_request() -> Column:
    tag = js_trim(F.coalesce("tag", F.lit("")))
    return reason("bad_tag_request", (tag == "") | (F.length(tag) > TAG_LENGTH))


def contract_mismatch(raw: DataFrame, table: str, required: list[str]) -> DataFrame:
    """Rows of text columns that lack a required value or hold one of the wrong type.

    Columns beyond the contract are ignored.
    """
    present = set(raw.columns)
    checks = []
    for field in schema(table):
        if field.name not in present:
            if field.name in required:
                checks.append(F.lit(f"missing {field.name}"))
            continue
        value = F.col(field.name)
        if field.name in required:
            checks.append(F.when(value.isNull(), F.lit(f"missing {field.name}")))
        if not isinstance(field.dataType, (T.StringType, T.ArrayType)):
            wrong = value.isNotNull() & value.try_cast(field.dataType).isNull()
            checks.append(F.when(wrong, F.lit(f"type {field.name}")))
    return find(raw, F.coalesce(*checks)) if checks else raw.limit(0).withColumn("reason", F.lit(None).cast("string"))


def with_trip(batch: DataFrame, trips: DataFrame) -> DataFrame:
    """Add whether the row's trip is known and how many days it has."""
    days = clock.total_days(F.col("start_date"), F.col("end_date"))
    span = trips.select(F.col("id").alias("trip_id"), days.alias("total_days"), F.lit(True).alias("known"))
    return batch.join(span, "trip_id", "left")


def with_target(patches: DataFrame, items: DataFrame, trips: DataFrame) -> DataFrame:
    """Add the item a patch names: whether it exists, its day, and the days of its own trip."""
    days = clock.total_days(F.col("start_date"), F.col("end_date"))
    span = trips.select(F.col("id").alias("trip_id"), days.alias("total_days"))
    existing = items.select(F.col("id").alias("item_id"), "trip_id", F.col("day_number").alias("existing_day"))
    targets = patches.join(existing.withColumn("known", F.lit(True)), "item_id", "left")
    return targets.join(span, "trip_id", "left")


def insert_reason() -> Column:
    """First broken rule of a new item, in the order they are checked."""
    return F.coalesce(unknown_id(), day_out_of_range(), bad_time(), time_without_day())


def patch_reason(columns: list[str]) -> Column:
    """First broken rule of an item patch, in the order they are checked."""
    return F.coalesce(
        candidate_with_day(), unknown_id(), day_out_of_range(), bad_time(), time_on_candidate(), empty_patch(columns)
    )


def _split(judged: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    accepted = judged.where(F.col("reason").isNull()).select(*columns)
    return accepted, judged.where(F.col("reason").isNotNull()).select(*columns, "reason")


def judge_inserts(batch: DataFrame, trips: DataFrame) -> DataFrame:
    return with_trip(batch, trips).withColumn("reason", insert_reason())


def judge_patches(patches: DataFrame, items: DataFrame, trips: DataFrame) -> DataFrame:
    return with_target(patches, items, trips).withColumn("reason", patch_reason(patches.columns))


def validate_inserts(batch: DataFrame, trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted new items with their time trimmed, and quarantined ones with the first reason."""
    accepted, rejected = _split(judge_inserts(batch, trips), batch.columns)
    return accepted.withColumn("start_time", js_trim(F.col("start_time"))), rejected


def validate_patches(patches: DataFrame, items: DataFrame, trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted patches, those back to candidate clearing day and time; and quarantined ones."""
    accepted, rejected = _split(judge_patches(patches, items, trips), patches.columns)
    back = F.coalesce("to_candidate", F.lit(False))
    clear = F.when(back, F.array(F.lit("day_number"), F.lit("start_time"))).otherwise(F.array().cast("array<string>"))
    ready = accepted.withColumn("clear", clear).withColumn("start_time", js_trim(F.col("start_time")))
    return ready.drop("to_candidate"), rejected


def judge_trips(new_trips: DataFrame) -> DataFrame:
    return new_trips.withColumn("reason", bad_date_range())


def validate_trips(new_trips: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(judge_trips(new_trips), new_trips.columns)


def judge_buylist(batch: DataFrame) -> DataFrame:
    """New shopping items: a name is needed, a given urgency must be known."""
    return batch.withColumn("reason", F.coalesce(blank_name(), bad_urgency()))


def judge_buylist_patches(patches: DataFrame, buylist: DataFrame) -> DataFrame:
    """Changes of shopping items, one row per ``item_id``: known item, known urgency, at least one field given."""
    known = buylist.select(F.col("id").alias("item_id"), F.lit(True).alias("known"))
    reasons = F.coalesce(unknown_id(), bad_urgency(), empty_patch(patches.columns, False))
    return patches.join(known, "item_id", "left").withColumn("reason", reasons)


def validate_buylist(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(judge_buylist(batch), batch.columns)


def validate_buylist_patches(patches: DataFrame, buylist: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(judge_buylist_patches(patches, buylist), patches.columns)
