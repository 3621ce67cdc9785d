"""Queries on checks over change batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.operators import quality
from wayledger.plans.registry import query
from wayledger.sources.tables import fill_defaults

_SPAN = "(select id, date_diff('day', start_date, end_date) + 1 as days from trips)"
_STRICT = "regexp_full_match(trim(start_time), '([01][0-9]|2[0-3]):[0-5][0-9]')"


@query("bad_date_range", "select request_id, 'bad_date_range' as reason from new_trips where end_date < start_date")
def _(t):
    return quality.find(t.new_trips, quality.bad_date_range()).select("request_id", "reason")


@query(
    "day_out_of_range",
    f"""select request_id, 'day_out_of_range' as reason from new_items n join {_SPAN} s on s.id = n.trip_id
      where day_number < 1 or day_number > days""",
)
def _(t):
    found = quality.find(quality.with_trip(t.new_items, t.trips), quality.day_out_of_range())
    return found.select("request_id", "reason")


@query(
    "bad_time",
    f"select request_id, 'bad_time' as reason from new_items where start_time is not null and not {_STRICT}",
)
def _(t):
    return quality.find(t.new_items, quality.bad_time()).select("request_id", "reason")


@query(
    "time_without_day",
    """select request_id, 'time_without_day' as reason from new_items
    where start_time is not null and day_number is null""",
)
def _(t):
    return quality.find(t.new_items, quality.time_without_day()).select("request_id", "reason")


@query(
    "candidate_with_day",
    "select item_id, 'candidate_with_day' as reason from item_patches where to_candidate and day_number is not null",
)
def _(t):
    return quality.find(t.item_patches, quality.candidate_with_day()).select("item_id", "reason")


@query(
    "time_on_candidate",
    """select item_id, 'time_on_candidate' as reason from item_patches p left join items i on i.id = p.item_id
    where p.start_time is not null and (to_candidate or coalesce(p.day_number, i.day_number) is null)""",
)
def _(t):
    targets = quality.with_target(t.item_patches, t.items, t.trips)
    return quality.find(targets, quality.time_on_candidate()).select("item_id", "reason")


@query(
    "empty_patch",
    """select item_id, 'empty_patch' as reason from item_patches where not to_candidate and day_number is null
    and start_time is null and is_confirmed is null""",
)
def _(t):
    return quality.find(t.item_patches, quality.empty_patch(t.item_patches.columns)).select("item_id", "reason")


@query(
    "unknown_id",
    """select 'trip' as kind, request_id as id, 'unknown_id' as reason from new_items
      where trip_id not in (select id from trips)
    union all select 'item', item_id, 'unknown_id' from item_patches where item_id not in (select id from items)""",
)
def _(t):
    batch = quality.find(quality.with_trip(t.new_items, t.trips), quality.unknown_id())
    patch = quality.find(quality.with_target(t.item_patches, t.items, t.trips), quality.unknown_id())
    first = batch.select(F.lit("trip").alias("kind"), F.col("request_id").alias("id"), "reason")
    return first.unionByName(patch.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "reason"))


@query(
    "bad_enum",
    """select request_id, 'bad_enum' as reason from new_wishes where lower(trim(status)) not in ('pending', 'purchased')
    or urgency not in ('need', 'want', 'maybe')""",
)
def _(t):
    return quality.find(t.new_wishes, quality.bad_enum()).select("request_id", "reason")


@query("missing_required", "select request_id, 'missing_required' as reason from new_items where name is null")
def _(t):
    check = quality.missing_required("itinerary_items", t.new_items.columns)
    return quality.find(t.new_items, check).select("request_id", "reason")


@query(
    "bad_rating",
    """select id, 'bad_rating' as reason from sauces where trim(coalesce(name, '')) = ''
    or spiciness not between 1 and 5 or aroma not between 1 and 5 or cp not between 1 and 5
    or repurchase not between 1 and 5""",
)
def _(t):
    return quality.find(t.sauces, quality.bad_rating()).select("id", "reason")


@query(
    "blank_name", "select request_id, 'blank_name' as reason from new_items where trim(coalesce(name, '')) = ''"
)
def _(t):
    return quality.find(t.new_items, quality.blank_name()).select("request_id", "reason")


@query(
    "bad_tag_request",
    "select list_id, tag, 'bad_tag_request' as reason from share_requests where trim(tag) = '' or length(trim(tag)) > 60",
)
def _(t):
    return quality.find(t.share_requests, quality.bad_tag_request()).select("list_id", "tag", "reason")


def _raw_items(t):
    """Items as untyped text, with what an older writer could have left in them."""
    return t.reply_rows.select(
        F.concat("reply_id", F.lit("-"), "pos").alias("source_key"),
        (F.col("reply_id") * 100 + F.col("pos")).cast("string").alias("id"),
        F.nullif("day", F.lit("0")).alias("trip_id"),
        F.col("start_time").alias("name"),
        F.col("duration_minutes"),
        F.col("location").alias("is_confirmed"),
    )


@query(
    "contract_mismatch",
    """select reply_id || '-' || pos as source_key, case when nullif(day, '0') is null then 'missing trip_id'
      when try_cast(day as bigint) is null then 'type trip_id' when start_time is null then 'missing name'
      when duration_minutes is not null and try_cast(duration_minutes as int) is null then 'type duration_minutes'
      else 'type is_confirmed' end as reason
    from reply_rows where nullif(day, '0') is null or try_cast(day as bigint) is null or start_time is null
      or (duration_minutes is not null and try_cast(duration_minutes as int) is null)
      or location is not null""",
)
def _(t):
    found = quality.contract_mismatch(_raw_items(t), "itinerary_items", ["id", "trip_id", "name"])
    return found.select("source_key", "reason")


@query(
    "fill_defaults",
    """select id, trip_id, name, day_number, 'other' as category, 60 as duration_minutes, '' as location,
      'manual' as source, 0 as sort_order, false as confirm_required, is_confirmed from items""",
)
def _(t):
    older = t.items.select("id", "trip_id", "name", "day_number", "is_confirmed", F.lit(1).alias("unknown_column"))
    return fill_defaults(older, "itinerary_items").select(
        "id", "trip_id", "name", "day_number", "category", "duration_minutes", "location", "source", "sort_order",
        "confirm_required", "is_confirmed",
    )


@query(
    "validate_changes",
    f"""select 'insert' as kind, request_id as id, case when s.id is null then 'unknown_id'
      when day_number < 1 or day_number > days then 'day_out_of_range'
      when start_time is not null and not {_STRICT} then 'bad_time'
      when start_time is not null and day_number is null then 'time_without_day' else 'accepted' end as outcome
    from new_items n left join {_SPAN} s on s.id = n.trip_id
    union all
    select 'patch', item_id, case when to_candidate and p.day_number is not null then 'candidate_with_day'
      when i.id is null then 'unknown_id' when p.day_number < 1 or p.day_number > days then 'day_out_of_range'
      when p.start_time is not null and not {_STRICT.replace('start_time', 'p.start_time')} then 'bad_time'
      when p.start_time is not null and (to_candidate or coalesce(p.day_number, i.day_number) is null)
        then 'time_on_candidate'
      when not to_candidate and p.day_number is null and p.start_time is null and p.is_confirmed is null
        then 'empty_patch' else 'accepted' end
    from item_patches p left join items i on i.id = p.item_id left join {_SPAN} s on s.id = i.trip_id
    union all
    select 'trip', request_id, case when end_date < start_date then 'bad_date_range' else 'accepted' end from new_trips""",
)
def _(t):
    parts = [
        ("insert", quality.judge_inserts(t.new_items, t.trips), "request_id"),
        ("patch", quality.judge_patches(t.item_patches, t.items, t.trips), "item_id"),
        ("trip", quality.judge_trips(t.new_trips), "request_id"),
    ]
    outcome = F.coalesce("reason", F.lit("accepted")).alias("outcome")
    judged = [rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), outcome) for kind, rows, key in parts]
    return reduce(DataFrame.unionByName, judged)


_WISH = "trim(coalesce(name, ''))"


@query(
    "validate_shopping",
    f"""select 'insert' as kind, request_id as id, case when {_WISH} = '' then 'blank_name'
      when urgency not in ('need', 'want', 'maybe') then 'bad_enum' else 'accepted' end as outcome from new_wishes
    union all
    select 'patch', p.request_id, case when b.id is null then 'unknown_id'
      when p.urgency not in ('need', 'want', 'maybe') then 'bad_enum'
      when p.price is null and p.quantity is null and p.urgency is null then 'empty_patch' else 'accepted' end
    from new_wishes p left join buylist_items b on b.id = p.request_id""",
)
def _(t):
    asked = t.new_wishes.select(F.col("request_id").alias("item_id"), "price", "quantity", "urgency")
    outcome = F.coalesce("reason", F.lit("accepted")).alias("outcome")
    fresh = quality.judge_buylist(t.new_wishes)
    changed = quality.judge_buylist_patches(asked, t.buylist_items)
    return fresh.select(F.lit("insert").alias("kind"), F.col("request_id").alias("id"), outcome).unionByName(
        changed.select(F.lit("patch").alias("kind"), F.col("item_id").alias("id"), outcome)
    )


@query("bad_duration", "select item_id, 'bad_duration' as reason from edits where duration_minutes < 0")
def _(t):
    return quality.find(t.edits, quality.bad_duration()).select("item_id", "reason")


@query(
    "listing_day_errors",
    f"""select s.id as trip_id, day_number, 'day_out_of_range' as reason
    from (select distinct trip_id, day_number from new_items where day_number is not null) n
    join {_SPAN} s on s.id = n.trip_id where day_number < 1 or day_number > days""",
)
def _(t):
    asked = t.new_items.where(F.col("day_number").isNotNull()).select("trip_id", "day_number").distinct()
    found = quality.find(quality.with_trip(asked, t.trips), quality.day_out_of_range())
    return found.select("trip_id", "day_number", "reason")
