"""Batches of change requests applied to table snapshots.

Every job returns the full new table; files are immutable, so the caller writes it as a
new snapshot.  Null in a request means the field was not given.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayledger.functions.text import blank_as_null, js_trim, text_or
from wayledger.operators.planning import append_sort_order
from wayledger.operators.skew import HotKeys, hot_keys, ranked, with_part
from wayledger.schemas import DEFAULTS, schema

# Instructions of the history.
REORDERED = "重新排序 Day "
ADJUSTED = "手動調整"
# What a summary says of a change.
BACK, CONFIRMED, UNCONFIRMED, RENAMED, UNCHANGED = "退回候選", "標記為已確認", "取消已確認", "改了名稱", "無變更"


def _next_id(table: DataFrame) -> Column:
    """Ids beyond the present ones: the largest, as a one-value subquery."""
    return F.coalesce(table.select(F.max("id")).scalar(), F.lit(0))


def _with_defaults(batch: DataFrame, table: str, columns: list[str]) -> DataFrame:
    defaults, given = DEFAULTS[table], set(batch.columns)
    types = {f.name: f.dataType for f in schema(table)}
    made = []
    for name in columns:
        default = F.lit(defaults.get(name)).cast(types[name])
        value = F.coalesce(F.col(name).cast(types[name]), default) if name in given else default
        made.append(value.alias(name))
    return batch.select(*made)


def insert_items(items: DataFrame, batch: DataFrame, source: str = "manual") -> DataFrame:
    """Present items and the new ones, each placed last on its day.

    ``request_id`` orders the batch and, added to the largest id, names the new row.
    """
    named = batch.withColumn("id", F.col("request_id") + _next_id(items)).withColumn("source", F.lit(source))
    if "category" in batch.columns:
        named = named.withColumn("category", F.nullif("category", F.lit("")))
    placed = append_sort_order(items, named, "request_id")
    fresh = _with_defaults(placed, "itinerary_items", [c for c in items.columns if c != "created_at"])
    return items.unionByName(fresh, allowMissingColumns=True)


def _order(order: str | None, columns: list[str]) -> Column:
    """The order of requests; without one, any that is the same each time."""
    return F.col(order) if order is not None else F.xxhash64(*columns)


def fold_patches(patches: DataFrame, order: str | None = None) -> DataFrame:
    """One patch per item: for every field the last event, be it a value or a clearing, decides.

    A patch that gives a field and lists it in ``clear`` clears it.  The result has ``clear`` if ``patches`` has.
    """
    fields = [c for c in patches.columns if c not in ("item_id", "clear", order)]
    at = _order(order, patches.columns)
    if "clear" not in patches.columns:
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in fields]
        return patches.groupBy("item_id").agg(*last) if last else patches.select("item_id").distinct()

    def event(name: str) -> Column:
        cleared = F.coalesce(F.array_contains("clear", name), F.lit(False))
        value = F.when(~cleared, F.col(name)).alias("value")
        return F.max_by(F.struct(value, cleared.alias("cleared")), F.when(cleared | F.col(name).isNotNull(), at))

    # Fields that no patch gives can only have been cleared; distinct lists are few.
    others = F.array_except(F.flatten(F.collect_set("clear")), F.array(*map(F.lit, fields)).cast("array<string>"))
    folded = patches.groupBy("item_id").agg(others.alias("_others"), *[event(c).alias(f"_last_{c}") for c in fields])
    gone = F.array(*[F.when(F.col(f"_last_{c}.cleared"), F.lit(c)) for c in fields]).cast("array<string>")
    values = [F.col(f"_last_{c}.value").alias(c) for c in fields]
    return folded.select("item_id", *values, F.concat(F.filter(gone, F.isnotnull), "_others").alias("clear"))


def patch_items(table: DataFrame, patches: DataFrame, order: str | None = None) -> DataFrame:
    """Overwrite the given fields of the named rows.

    Several patches of one row are folded in ``order`` first, so the table keeps its rows.  A field is set to null
    only when ``clear``, an array of field names, lists it.
    """
    patches = fold_patches(patches, order)
    fields = [c for c in patches.columns if c not in ("item_id", "clear")]
    clear = F.col("clear") if "clear" in patches.columns else F.array().cast("array<string>")
    given = patches.select(
        F.col("item_id").alias("id"), clear.alias("_clear"), *[F.col(c).alias(f"_new_{c}") for c in fields]
    )
    types = dict(table.dtypes)
    joined = table.join(given, "id", "left")
    cleared = {c for c in table.columns if c != "id"} if "clear" in patches.columns else set()

    def value(name: str) -> Column:
        kept = F.col(name)
        if name in fields:
            kept = F.coalesce(F.col(f"_new_{name}").cast(types[name]), kept)
        if name in cleared:
            kept = F.when(F.coalesce(F.array_contains("_clear", name), F.lit(False)), F.lit(None)).otherwise(kept)
        return kept.alias(name)

    return joined.select(*[value(c) for c in table.columns])


def update_summaries(items: DataFrame, patches: DataFrame, order: str | None = None) -> DataFrame:
    """One sentence per patched item: which fields the patch gives and what they are now."""
    patched = patch_items(items, patches, order)
    folded = fold_patches(patches, order)
    fields = [c for c in folded.columns if c not in ("item_id", "clear")]
    cleared = F.col("clear") if "clear" in folded.columns else F.array().cast("array<string>")
    gone = lambda name: F.coalesce(F.array_contains(cleared, name), F.lit(False))
    given = {c: F.col(c).isNotNull() | gone(c) for c in fields}
    flags = folded.select(F.col("item_id").alias("id"), *[g.alias(f"_has_{c}") for c, g in given.items()], cleared.alias("_clear"))
    rows = patched.join(flags, "id")

    def has(name: str) -> Column:
        return F.col(f"_has_{name}") if name in fields else F.coalesce(F.array_contains("_clear", name), F.lit(False))

    day, time = F.col("day_number"), F.col("start_time")
    placed = F.when(day.isNull(), F.lit(BACK)).otherwise(F.concat(F.lit("排到第 "), day.cast("string"), F.lit(" 天")))
    moved = F.when(has("start_time") & (F.coalesce(time, F.lit("")) != ""), F.concat(F.lit("時間改為 "), time))
    confirmed = F.when(F.coalesce("is_confirmed", F.lit(False)), F.lit(CONFIRMED)).otherwise(F.lit(UNCONFIRMED))
    others = [c for c in fields if c not in ("day_number", "start_time", "is_confirmed", "name")]
    rest = F.array_join(F.filter(F.array(*[F.when(has(c), F.lit(c)) for c in others]).cast("array<string>"), F.isnotnull), "、")
    parts = [
        F.when(has("day_number"), placed), moved, F.when(has("is_confirmed"), confirmed), F.when(has("name"), F.lit(RENAMED)),
        F.when(rest != "", F.concat(F.lit("更新了 "), rest)),
    ]
    told = F.concat_ws("；", *parts)
    what = F.when(told == "", F.lit(UNCHANGED)).otherwise(told)
    return rows.select("id", F.concat(F.lit("已更新「"), "name", F.lit("」："), what, F.lit("。")).alias("summary"))


def schedule_patches(items: DataFrame, requests: DataFrame, order: str | None = None) -> DataFrame:
    """Requests as patches with the position behind the items that their day already has, in the order of the requests.

    Of several requests for one item the last counts.  Without ``order`` the item id orders.
    """
    order = order or "item_id"
    rest = [c for c in requests.columns if c != "item_id"]
    at = F.struct(order, F.xxhash64(*requests.columns))
    last = requests.groupBy("item_id").agg(F.max_by(F.struct(*rest), at).alias("_last")).select("item_id", "_last.*")
    known = items.select(F.col("id").alias("item_id"), "trip_id")
    placed = append_sort_order(items, last.join(known, "item_id"), order)
    return placed.select("item_id", "day_number", "start_time", "sort_order")


def schedule_items(items: DataFrame, requests: DataFrame, order: str | None = None) -> DataFrame:
    """Put items on a day and time, behind the items that day already has."""
    return patch_items(items, schedule_patches(items, requests, order))


def unschedule_items(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Make items candidates again: no day, no time, first position."""
    clear = F.array(F.lit("day_number"), F.lit("start_time"))
    return patch_items(items, ids.select(F.col("id").alias("item_id"), F.lit(0).alias("sort_order"), clear.alias("clear")))


def set_flags(table: DataFrame, requests: DataFrame, order: str | None = None) -> DataFrame:
    """Set confirmation, purchase, status or price fields of the named rows.

    Requests may say ``purchased`` for the column ``bought``; those for one row are folded in ``order``.
    """
    return patch_items(table, requests.withColumnRenamed("purchased", "bought"), order)


def adjustment_log(updates: DataFrame, order: str = "pos", hot: HotKeys | None = None) -> DataFrame:
    """History rows of applied changes, per trip and instruction.

    A very long change set is logged as several rows, numbered by ``part``.
    """
    keys = ["trip_id", "instruction"]
    rows = updates.select(*keys, "id", "start_time", order)
    placed = ranked(rows, keys, [F.col(order), F.col("id")], "_k", hot)
    entry = F.struct("_k", "id", "start_time")
    entries = with_part(placed, "_k").groupBy(*keys, "part").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    changed = F.transform("_all", lambda e: F.struct(e["id"].alias("id"), e["start_time"].alias("start_time")))
    return entries.select(*keys, "part", changed.alias("items_changed"))


def apply_plans(items: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with their planned times and positions, and the history rows of the plan.

    ``updates`` has one row per item, as ``reorder_updates`` and ``cascade_updates`` give them; a null position leaves
    an item's as it is.
    """
    changes = updates.select(F.col("id").alias("item_id"), "start_time", "sort_order")
    # A plan has one row per item, so the items bound the rows per trip.
    log = adjustment_log(updates, hot=hot_keys(items, ["trip_id"]))
    return patch_items(items, changes), log


def reorder_updates(plan: DataFrame) -> DataFrame:
    """A reorder plan as updates with the instruction it is logged under."""
    told = F.concat(F.lit(REORDERED), F.col("day_number").cast("string"))
    return plan.select("trip_id", "id", "start_time", "sort_order", F.col("sort_order").alias("pos"), told.alias("instruction"))


def cascade_updates(items: DataFrame, plan: DataFrame, instruction: str = ADJUSTED) -> DataFrame:
    """A cascade or single plan as updates: its rows without error, of an item moved more than once the last request.

    The target comes first in the history row, then the items that move with it.
    """
    moved = plan.where(F.col("error").isNull())
    first = F.when(F.col("is_target"), 0).otherwise(1)
    last = F.max_by(F.struct("start_time", first.alias("pos")), "request_id").alias("_last")
    last = moved.groupBy("id").agg(last).select("id", "_last.*")
    known = items.select("id", "trip_id")
    told, kept = F.lit(instruction).alias("instruction"), F.lit(None).cast("int").alias("sort_order")
    return last.join(known, "id").select("trip_id", "id", "start_time", kept, "pos", told)


def delete_rows(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_anti")


def cascade_delete(
    trips: DataFrame, items: DataFrame, log: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the named trips and all that depends on them."""
    gone = ids.select(F.col("id").alias("trip_id"))
    kept_items = items.join(gone, "trip_id", "left_anti")
    return delete_rows(trips, ids), kept_items, log.join(gone, "trip_id", "left_anti")


def orphan_items(trips: DataFrame, items: DataFrame) -> DataFrame:
    return items.join(trips.select(F.col("id").alias("trip_id")), "trip_id", "left_anti")


def upsert_budget(budget: DataFrame, requests: DataFrame, order: str | None = None) -> DataFrame:
    """Set the budget of each named list, adding lists that have none yet; of several requests the last counts."""
    asked = F.max_by(F.coalesce("monthly_budget", F.lit(0)).cast("decimal(12,2)"), _order(order, requests.columns))
    joined = budget.join(requests.groupBy("list_id").agg(asked.alias("_new")), "list_id", "full")
    return joined.select(
        "list_id",
        F.coalesce("_new", "monthly_budget").alias("monthly_budget"),
        F.coalesce("last_cleared", F.lit("")).alias("last_cleared"),
    )


def blank_to_null(edits: DataFrame) -> DataFrame:
    """Edit-form values as stored: blanks, lengths of zero and times without a day are null."""
    texts = [c for c in ("location", "address", "booking_ref", "notes") if c in edits.columns]
    day = F.when(F.col("day_number") != 0, F.col("day_number"))
    time = F.when(day.isNotNull(), F.nullif("start_time", F.lit("")))
    cleaned = {c: blank_as_null(F.col(c)) for c in texts}
    return edits.withColumns(
        {
            **cleaned,
            "start_time": time,
            "day_number": day,
            "duration_minutes": F.when(F.col("duration_minutes") > 0, F.col("duration_minutes")),
        }
    )


def insert_buylist(table: DataFrame, batch: DataFrame, added_by: str = "") -> DataFrame:
    """Present shopping items and the new ones; names are trimmed, nameless rows dropped."""
    named = batch.withColumn("name", js_trim(F.col("name"))).where(F.col("name") != "")
    named = named.withColumns(
        {
            "id": F.col("request_id") + _next_id(table),
            "category": text_or(F.col("category"), DEFAULTS["buylist_items"]["category"]),
            "added_by": F.lit(added_by),
            **{c: js_trim(F.col(c)) for c in ("note", "link", "tag") if c in batch.columns},
        }
    )
    fresh = _with_defaults(named, "buylist_items", [c for c in table.columns if c != "created_at"])
    return table.unionByName(fresh, allowMissingColumns=True)


def insert_wishlist(table: DataFrame, batch: DataFrame, as_of: datetime.date) -> DataFrame:
    """The older list with new pending entries."""
    named = batch.withColumn("name", js_trim(F.col("name"))).where(F.col("name") != "")
    named = named.withColumns(
        {
            "id": F.col("request_id") + _next_id(table),
            "estimated_price": F.col("price"),
            "status": F.lit("pending"),
            "added_date": F.lit(as_of),
        }
    )
    fresh = _with_defaults(named, "wishlist", [c for c in table.columns if c != "created_at"])
    return table.unionByName(fresh, allowMissingColumns=True)
