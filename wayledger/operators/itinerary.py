"""Reading side of the trips: listings, labels, day plans, counts."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.functions import clock
from wayledger.operators.selection import ranked_overall
from wayledger.operators.skew import hot_keys, ranked, spread_under

# Category labels, icon first.
CATEGORY_LABELS = {
    "restaurant": "🍽️ 餐廳",
    "hotel": "🏨 住宿",
    "attraction": "🏛️ 景點",
    "shopping": "🛍️ 購物",
    "transport": "🚆 交通",
    "other": "📌 其他",
}
CANDIDATE_LABEL = "候選中"
NO_TIME = "99:99"


def labelled(c: Column, labels: dict[str, str], default: str) -> Column:
    """Look a code up in a fixed set of labels."""
    pairs = [F.lit(text) for pair in labels.items() for text in pair]
    return F.coalesce(F.create_map(*pairs)[c], F.lit(default))


def up(*names: str) -> list[Column]:
    """Ascending with nulls last."""
    return [F.col(n).asc_nulls_last() for n in names]


def down(*names: str) -> list[Column]:
    """Descending with nulls first."""
    return [F.col(n).desc_nulls_first() for n in names]


def trips_by_user(trips: DataFrame, user: str | None = None) -> DataFrame:
    chosen = trips if user is None else trips.where(F.col("username") == user)
    return ranked(chosen, ["username"], [*down("start_date"), *up("id")])


def trips_list(trips: DataFrame) -> DataFrame:
    """All trips with their place in the list of all, latest start first."""
    listed = trips.select("id", "name", "start_date", "end_date")
    return ranked_overall(listed, [*down("start_date"), *up("id")])


def items_by_day(items: DataFrame, trip_id: int | None = None, day: int | None = None) -> DataFrame:
    """Items of each day, or of one, in day order."""
    chosen = items_scheduled_rows(items)
    if trip_id is not None:
        chosen = chosen.where(F.col("trip_id") == trip_id)
    if day is not None:
        chosen = chosen.where(F.col("day_number") == day)
    return ranked(chosen, ["trip_id", "day_number"], up("start_time", "sort_order", "id"))


def items_scheduled_rows(items: DataFrame) -> DataFrame:
    return items.where(F.col("day_number").isNotNull())


def items_all(items: DataFrame) -> DataFrame:
    return ranked(items, ["trip_id"], up("day_number", "start_time", "sort_order", "id"))


def items_scheduled(items: DataFrame) -> DataFrame:
    return items_all(items_scheduled_rows(items))


def items_candidates(items: DataFrame) -> DataFrame:
    return ranked(items.where(F.col("day_number").isNull()), ["trip_id"], up("id"))


def is_true(name: str) -> Column:
    """Filter form of a flag: reaches the file scan."""
    return F.col(name)


def not_true(name: str) -> Column:
    """Filter form of a flag that is false or missing: reaches the file scan."""
    return F.col(name).isNull() | ~F.col(name)


def needs_attention() -> Column:
    return is_true("confirm_required") & not_true("is_confirmed")


def items_unconfirmed_required(items: DataFrame) -> DataFrame:
    return ranked(items.where(needs_attention()), ["trip_id"], up("day_number", "start_time", "id"))


def items_filtered(
    items: DataFrame, day: int | None = None, only_candidates: bool = False, only_unconfirmed: bool = False
) -> DataFrame:
    """Listing of each trip's items under any of the three conditions."""
    if day is not None and only_candidates:
        raise ValueError("a candidate has no day: give a day or only_candidates, not both")
    chosen = items
    if only_candidates:
        chosen = chosen.where(F.col("day_number").isNull())
    elif day is not None:
        chosen = chosen.where(F.col("day_number") == day)
    if only_unconfirmed:
        chosen = chosen.where(not_true("is_confirmed"))
    return ranked(chosen, ["trip_id"], up("day_number", "start_time", "id"))


def checklist_order(items: DataFrame, name: str = "rank") -> DataFrame:
    order = [*down("confirm_required"), *up("is_confirmed", "day_number", "start_time", "id")]
    return ranked(items, ["trip_id"], order, name)


def where_label(items: DataFrame) -> DataFrame:
    time = F.coalesce(F.nullif("start_time", F.lit("")), F.lit(""))
    on_day = F.rtrim(F.concat(F.lit("Day "), F.col("day_number").cast("string"), F.lit(" "), time))
    return items.withColumn("where_label", F.coalesce(on_day, F.lit(CANDIDATE_LABEL)))


def category_labels(items: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    labels = labels or CATEGORY_LABELS
    label = labelled(F.col("category"), labels, labels["other"])
    return items.withColumn("label", label).withColumn("icon", F.split_part("label", F.lit(" "), F.lit(1)))


def plan_place(items: DataFrame) -> DataFrame:
    booking = F.concat(F.lit("📋 "), F.nullif("booking_ref", F.lit("")))
    return items.withColumn("place", F.coalesce(F.nullif("notes", F.lit("")), booking, F.lit("")))


def day_label(day: Column, date: Column) -> Column:
    return F.concat(F.lit("Day "), day.cast("string"), F.lit(" ("), F.date_format(date, "MM/dd"), F.lit(")"))


def _trip_span(trips: DataFrame) -> DataFrame:
    days = clock.total_days(F.col("start_date"), F.col("end_date"))
    return trips.select(F.col("id").alias("trip_id"), "start_date", days.alias("total_days"))


def item_dates(trips: DataFrame, items: DataFrame) -> DataFrame:
    """Scheduled items with the calendar date and label of their day."""
    dated = items_scheduled_rows(items).join(_trip_span(trips), "trip_id")
    date = clock.day_date(F.col("start_date"), F.col("day_number"))
    return dated.withColumn("date", date).withColumn("day_label", day_label(F.col("day_number"), F.col("date")))


def plan_time_sort(items: DataFrame, hot=None) -> DataFrame:
    """Order of a day's items by time, untimed ones last."""
    timed = items_scheduled_rows(items).withColumn(
        "_time", F.coalesce(F.nullif("start_time", F.lit("")), F.lit(NO_TIME))
    )
    return ranked(timed, ["trip_id", "day_number"], up("_time", "id"), hot=hot).drop("_time")


def trip_days(trips: DataFrame, items: DataFrame) -> DataFrame:
    """Every day of every trip; a trip without dates runs to its last used day."""
    span = _trip_span(trips)
    dated = span.where(F.col("total_days") > 0)
    undated = span.where(F.coalesce("total_days", F.lit(0)) <= 0).select("trip_id", "start_date")
    used = (
        items.where(F.col("day_number") > 0)
        .join(undated.select("trip_id"), "trip_id", "left_semi")
        .groupBy("trip_id")
        .agg(F.max("day_number").alias("total_days"))
    )
    span = dated.unionByName(undated.join(used, "trip_id"))
    days = span.withColumn("day_number", F.explode(F.sequence(F.lit(1), F.col("total_days"))))
    label = F.coalesce(
        day_label(F.col("day_number"), clock.day_date(F.col("start_date"), F.col("day_number"))),
        F.concat(F.lit("Day "), F.col("day_number").cast("string")),
    )
    return days.select("trip_id", "day_number", label.alias("day_label"))


def day_plan(trips: DataFrame, items: DataFrame) -> DataFrame:
    """Each day of each trip with its items by time; empty days give one row without item."""
    keys = ["trip_id", "day_number"]
    rows = items_scheduled_rows(items).select(*keys, F.col("id").alias("item_id"), "name", "start_time", "id")
    hot = hot_keys(rows, keys)
    placed = plan_time_sort(rows, hot).drop("id")
    return spread_under(trip_days(trips, items), placed, keys, "item_id", hot)


def trip_summary(trips: DataFrame, items: DataFrame, *more: Column) -> DataFrame:
    """Each trip with its days and item counts; ``more`` aggregates come from the same pass."""
    counts = items.groupBy("trip_id").agg(
        F.count("day_number").alias("scheduled"),
        F.count_if(F.col("day_number").isNull()).alias("candidates"),
        *more,
    )
    days = clock.total_days(F.col("start_date"), F.col("end_date"))
    joined = trips.select(F.col("id").alias("trip_id"), "name", days.alias("total_days")).join(
        counts, "trip_id", "left"
    )
    return joined.fillna(0, ["scheduled", "candidates"])


def today_day(trips: DataFrame, as_of: datetime.date) -> DataFrame:
    """Which day of each trip ``as_of`` is; null outside the trip."""
    day = F.date_diff(F.lit(as_of), "start_date") + 1
    within = (day >= 1) & (day <= clock.total_days(F.col("start_date"), F.col("end_date")))
    return trips.select(F.col("id").alias("trip_id"), F.when(within, day).alias("today_day"))


def checklist_sections(items: DataFrame) -> DataFrame:
    required = F.coalesce("confirm_required", F.lit(False))
    section = (
        F.when(needs_attention(), "must_unconfirmed").when(required, "must_confirmed").otherwise("flexible")
    )
    return items.withColumn("section", section)


def checklist_counts(items: DataFrame) -> DataFrame:
    sections = ["must_unconfirmed", "must_confirmed", "flexible"]
    counts = (
        checklist_sections(items)
        .groupBy("trip_id")
        .agg(*[F.count_if(F.col("section") == s).alias(s) for s in sections])
    )
    return counts.withColumn("all_clear", F.col("must_unconfirmed") == 0)


def day_plan_counts(items: DataFrame) -> DataFrame:
    """Items per trip and day; the row without a day counts the unscheduled ones."""
    return items.groupBy("trip_id", "day_number").agg(F.count("*").alias("items"))


def attention_count(listing: DataFrame, keys: list[str]) -> DataFrame:
    return listing.groupBy(*keys).agg(
        F.count("*").alias("items"), F.count_if(needs_attention()).alias("attention")
    )


# What listings are called in their summaries.
ALL_ITEMS, CANDIDATES, ONLY_UNCONFIRMED = "全部項目", "候選項目", "（僅未確認）"


def listing_summary(
    trips: DataFrame, items: DataFrame, day: int | None = None, only_candidates: bool = False, only_unconfirmed: bool = False
) -> DataFrame:
    """What the listing of ``items_filtered`` amounts to for every trip, in words: size and items that need attention."""
    listed = attention_count(items_filtered(items, day, only_candidates, only_unconfirmed), ["trip_id"])
    scope = CANDIDATES if only_candidates else ALL_ITEMS if day is None else f"第 {day} 天的項目"
    scope += ONLY_UNCONFIRMED if only_unconfirmed else ""
    counted = trips.select(F.col("id").alias("trip_id")).join(listed, "trip_id", "left").fillna(0, ["items", "attention"])
    waiting = F.concat(F.lit("，其中 "), F.col("attention").cast("string"), F.lit(" 項必須確認但還沒確認。"))
    filled = F.concat(F.lit(f"{scope}共 "), F.col("items").cast("string"), F.lit(" 筆"), F.when(F.col("attention") > 0, waiting).otherwise("。"))
    text = F.when(F.col("items") == 0, f"這趟旅程的{scope}是空的。").otherwise(filled)
    return counted.select("trip_id", "items", "attention", text.alias("summary"))


def headline(rows: DataFrame, keys: list[str], order: list[Column], entry: Column) -> DataFrame:
    """Count and first three entries per key.

    The rank limit lets Spark keep three rows per key already before the shuffle.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    first = _first_three(rows.select(*keys, *_sorting(order), entry.alias("entry")), keys, len(order))
    heads = first.groupBy(*keys).agg(
        F.expr("listagg(entry, '、') within group (order by position)").alias("head")
    )
    return counts.join(heads, keys)


def _sorting(order: list[Column]) -> list[Column]:
    return [c.alias(f"_o{i}") for i, c in enumerate(order)]


def _first_three(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    from pyspark.sql import Window

    window = Window.partitionBy(*keys).orderBy(*[F.col(f"_o{i}") for i in range(width)])
    return rows.withColumn("position", F.row_number().over(window)).where(F.col("position") <= 3)


def trip_headline(trips: DataFrame) -> DataFrame:
    """Per user: how many trips, the latest three, and how many more."""
    span = F.concat(F.col("start_date").cast("string"), F.lit(" ~ "), F.col("end_date").cast("string"))
    entry = F.concat("name", F.lit("（"), span, F.lit("）"))
    lines = headline(trips, ["username"], [-F.unix_date("start_date"), F.col("id")], entry)
    more = F.when(F.col("n") > 3, F.concat(F.lit("，另有 "), (F.col("n") - 3).cast("string"), F.lit(" 趟")))
    summary = F.concat(
        F.lit("共 "), F.col("n").cast("string"), F.lit(" 趟旅程："), "head", F.coalesce(more, F.lit("")), F.lit("。")
    )
    return lines.withColumn("summary", summary)
