"""Queries on re-timing and on change batches."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from wayledger.operators import changes, itinerary, planning
from wayledger.plans.registry import query
from wayledger.session import stored

AS_OF = datetime.date(2001, 8, 15)


def _minutes(c: str) -> str:
    return f"(cast(split_part({c}, ':', 1) as int) * 60 + cast(split_part({c}, ':', 2) as int))"


def _clock(m: str) -> str:
    within = f"greatest(0, least(1439, {m}))"
    return f"lpad(cast({within} // 60 as varchar), 2, '0') || ':' || lpad(cast({within} % 60 as varchar), 2, '0')"


@query(
    "next_sort_order",
    """with days as (select id as trip_id, unnest(generate_series(1, date_diff('day', start_date, end_date) + 1)) as d
       from trips)
    select days.trip_id, cast(d as int) as day_number, coalesce(max(sort_order) + 1, 0) as next_sort_order
    from days left join items on items.trip_id = days.trip_id and items.day_number = d group by all""",
)
def _(t):
    return planning.next_sort_order(t.items, itinerary.trip_days(t.trips, t.items))


_REORDER = f"""first as (select trip_id, day_number, min({_minutes('start_time')}) as m from items
      where day_number is not null and start_time is not null group by trip_id, day_number),
    asked as (select r.trip_id, r.day_number, r.item_id, r.pos, coalesce(duration_minutes, 0) as d
      from reorder_requests r join items i on i.id = r.item_id and i.trip_id = r.trip_id
        and i.day_number = r.day_number where i.start_time is not null),
    plan as (select a.trip_id, a.day_number, a.item_id as id, a.pos as sort_order,
      m + coalesce((select sum(d) from asked b where b.trip_id = a.trip_id and b.day_number = a.day_number
        and b.pos < a.pos), 0) as s
      from asked a join first f on f.trip_id = a.trip_id and f.day_number = a.day_number)"""


@query(
    "reorder_plan",
    f"with {_REORDER} select trip_id, day_number, id, sort_order, {_clock('s')} as start_time from plan",
)
def _(t):
    return planning.reorder_plan(t.items, t.reorder_requests)


_CASCADE = f"""r as (select c.*, i.id as known, case when i.start_time is not null
        then 600 - {_minutes('i.start_time')} end as delta
      from cascade_requests c left join items i on i.id = c.target_id and i.trip_id = c.trip_id)"""


@query(
    "cascade_plan",
    f"""with {_CASCADE}
    select request_id, case when delta is not null then target_id end as id,
      case when delta is not null then new_time end as start_time, delta as delta_minutes,
      case when known is null then 'unknown_target' when delta is null then 'untimed_target' end as error from r
    union all
    select r.request_id, i.id, {_clock(f"({_minutes('i.start_time')} + delta)")}, delta, null
    from r join cascade_picks p on p.request_id = r.request_id
      join items i on i.id = p.item_id and i.trip_id = r.trip_id
    where delta is not null and i.id <> target_id and i.start_time is not null""",
)
def _(t):
    return planning.cascade_plan(t.items, t.cascade_requests, t.cascade_picks).drop("is_target")


@query(
    "single_plan",
    """select item_id as id, nullif(new_time, 'noon') as start_time,
      case when new_time = 'noon' then 'bad_time' end as error from single_requests""",
)
def _(t):
    return planning.single_plan(t.single_requests).select("id", "start_time", "error")


_NAMED = "n as (select * from new_items where trip_id > 0 and trim(coalesce(name, '')) <> '')"
_APPENDED = f"""{_NAMED},
    placed as (select n.*, case when day_number is null then 0 else cast(coalesce((select max(sort_order) from items i
        where i.trip_id = n.trip_id and i.day_number = n.day_number), -1)
      + row_number() over (partition by trip_id, day_number order by request_id) as int) end as sort_order from n)"""


def _named(t):
    return t.new_items.where((F.col("trip_id") > 0) & (F.trim(F.coalesce("name", F.lit(""))) != ""))


@query(
    "append_sort_order",
    f"with {_APPENDED} select request_id, trip_id, day_number, sort_order from placed",
)
def _(t):
    placed = planning.append_sort_order(t.items, _named(t), "request_id")
    return placed.select("request_id", "trip_id", "day_number", "sort_order")


@query(
    "insert_items",
    f"""with {_APPENDED}
    select id, trip_id, name, day_number, start_time, duration_minutes, category, notes, source, sort_order,
      confirm_required from items
    union all
    select request_id + (select max(id) from items), trip_id, name, day_number, start_time,
      coalesce(duration_minutes, 60), coalesce(category, 'other'), '', 'manual', sort_order, false from placed""",
)
def _(t):
    return changes.insert_items(t.items, _named(t)).select(
        "id", "trip_id", "name", "day_number", "start_time", "duration_minutes", "category", "notes", "source",
        "sort_order", "confirm_required",
    )


PATCH_SQL = """select id, coalesce(p.day_number, i.day_number) as day_number, coalesce(p.start_time, i.start_time) as start_time,
      coalesce(p.is_confirmed, i.is_confirmed) as is_confirmed, i.name
    from items i left join item_patches p on i.id = p.item_id"""


@query("patch_items", PATCH_SQL)
def _(t):
    patched = changes.patch_items(t.items, t.item_patches.drop("to_candidate"))
    return patched.select("id", "day_number", "start_time", "is_confirmed", "name")


SCHEDULE_SQL = """with c as (select id, trip_id, 1 as d from items where day_number is null),
    placed as (select c.id, coalesce((select max(sort_order) from items i where i.trip_id = c.trip_id
        and i.day_number = 1), -1) + row_number() over (partition by trip_id order by id) as so from c)
    select i.id, case when p.id is null then i.day_number else 1 end as day_number,
      case when p.id is null then i.start_time else '10:30' end as start_time,
      cast(coalesce(p.so, i.sort_order) as int) as sort_order
    from items i left join placed p on p.id = i.id"""


@query("schedule_items", SCHEDULE_SQL)
def _(t):
    # The operator reads the items four times; they are derived once.
    items = stored(t.items, "items")
    candidates = items.where(F.col("day_number").isNull())
    asked = candidates.select(
        F.col("id").alias("item_id"), F.lit(1).alias("day_number"), F.lit("10:30").alias("start_time")
    )
    return changes.schedule_items(items, asked).select("id", "day_number", "start_time", "sort_order")


UNSCHEDULE_SQL = """select id, case when not confirm_required then day_number end as day_number,
      case when not confirm_required then start_time end as start_time,
      case when confirm_required then 0 else sort_order end as sort_order from items"""


@query("unschedule_items", UNSCHEDULE_SQL)
def _(t):
    back = changes.unschedule_items(t.items, t.items.where("confirm_required").select("id"))
    return back.select("id", "day_number", "start_time", "sort_order")


@query(
    "set_flags",
    """select id, category = 'hotel' or confirm_required as confirm_required,
      case when category = 'hotel' then false else is_confirmed end as is_confirmed from items""",
)
def _(t):
    hotels = t.items.where(F.col("category") == "hotel")
    asked = hotels.select(
        F.col("id").alias("item_id"), F.lit(True).alias("confirm_required"), F.lit(False).alias("is_confirmed")
    )
    return changes.set_flags(t.items, asked).select("id", "confirm_required", "is_confirmed")


@query(
    "set_flags_buylist",
    """select id, true as bought, urgency = 'need' or starred as starred,
      cast(case when urgency = 'need' then price else actual_price end as double) as actual_price
    from buylist_items where urgency in ('need', 'want') and not bought
    union all select id, bought, starred, cast(actual_price as double) from buylist_items
    where not coalesce(urgency in ('need', 'want') and not bought, false)""",
)
def _(t):
    wanted = t.buylist_items.where(F.col("urgency").isin("need", "want") & ~F.col("bought"))
    need = F.col("urgency") == "need"
    asked = wanted.select(
        F.col("id").alias("item_id"),
        F.lit(True).alias("bought"),
        F.when(need, True).alias("starred"),
        F.when(need, F.col("price")).alias("actual_price"),
    )
    changed = changes.set_flags(t.buylist_items, asked)
    return changed.select("id", "bought", "starred", F.col("actual_price").cast("double"))


def _updates(t):
    return changes.reorder_updates(planning.reorder_plan(t.items, t.reorder_requests))


APPLY_SQL = f"""with {_REORDER}
    select i.id, case when p.id is null then start_time else {_clock('s')} end as start_time, coalesce(p.sort_order, i.sort_order) as sort_order
    from items i left join plan p on p.id = i.id"""


@query("apply_plans", APPLY_SQL)
def _(t):
    return changes.apply_plans(t.items, _updates(t))[0].select("id", "start_time", "sort_order")


@query(
    "adjustment_log",
    f"""with {_REORDER}
    select trip_id, '重新排序 Day ' || day_number as instruction, 0 as part, '[' || string_agg('{{"id":' || id ||
      ',"start_time":"' || {_clock('s')} || '"}}', ',' order by sort_order) || ']' as items_changed
    from plan group by trip_id, day_number""",
)
def _(t):
    return changes.apply_plans(t.items, _updates(t))[1].withColumn("items_changed", F.to_json("items_changed"))


_CASCADED = f"""{_CASCADE},
    plan as (select r.trip_id, target_id as id, new_time as s, 0 as pos from r where delta is not null
      union all select r.trip_id, i.id, {_clock(f"({_minutes('i.start_time')} + delta)")}, 1
      from r join cascade_picks p on p.request_id = r.request_id
        join items i on i.id = p.item_id and i.trip_id = r.trip_id
      where delta is not null and i.id <> target_id and i.start_time is not null)"""


def _cascaded(t):
    plan = planning.cascade_plan(t.items, t.cascade_requests, t.cascade_picks)
    return changes.apply_plans(t.items, changes.cascade_updates(t.items, plan))


@query(
    "apply_cascade",
    f"""with {_CASCADED} select i.id, coalesce(p.s, i.start_time) as start_time, i.sort_order
    from items i left join plan p on p.id = i.id""",
)
def _(t):
    return _cascaded(t)[0].select("id", "start_time", "sort_order")


@query(
    "cascade_log",
    f"""with {_CASCADED} select trip_id, '手動調整' as instruction, 0 as part, '[' || string_agg('{{"id":' || id ||
      ',"start_time":"' || s || '"}}', ',' order by pos, id) || ']' as items_changed from plan group by trip_id""",
)
def _(t):
    return _cascaded(t)[1].withColumn("items_changed", F.to_json("items_changed"))


@query(
    "apply_single",
    """select i.id, coalesce(nullif(r.new_time, 'noon'), i.start_time) as start_time, i.sort_order
    from items i left join single_requests r on r.item_id = i.id""",
)
def _(t):
    updates = changes.cascade_updates(t.items, planning.single_plan(t.single_requests))
    return changes.apply_plans(t.items, updates)[0].select("id", "start_time", "sort_order")


@query(
    "patch_sequence",
    """select id, case when category = 'hotel' and duration_minutes > 60 then null
        when category = 'hotel' or duration_minutes > 90 then 2 when confirm_required then null else day_number end
        as day_number,
      case when category = 'hotel' and duration_minutes > 60 then null
        when category = 'hotel' or duration_minutes > 90 then '08:15' when confirm_required then null else start_time
        end as start_time,
      case when duration_minutes > 60 then true when confirm_required is not null then not confirm_required
        else is_confirmed end as is_confirmed
    from items""",
)
def _(t):
    back = F.array(F.lit("day_number"), F.lit("start_time"))
    clear = F.when(F.coalesce("to_candidate", F.lit(False)), back).otherwise(F.array().cast("array<string>"))
    patches = t.patch_sequence.withColumn("clear", clear).drop("to_candidate")
    return changes.patch_items(t.items, patches, "at").select("id", "day_number", "start_time", "is_confirmed")


DELETE_SQL = "select id, trip_id from items where not (category = 'unknown' and day_number is null)"


@query("delete_rows", DELETE_SQL)
def _(t):
    gone = t.items.where((F.col("category") == "unknown") & F.col("day_number").isNull()).select("id")
    return changes.delete_rows(t.items, gone).select("id", "trip_id")


_OLD = "select id from trips where end_date < date '1996-01-01'"


def _cascade(t):
    gone = t.trips.where(F.col("end_date") < F.lit(datetime.date(1996, 1, 1))).select("id")
    log = t.items.select("trip_id", F.col("id").alias("log_id"))
    return changes.cascade_delete(t.trips, t.items, log, gone)


@query(
    "cascade_delete",
    f"""select 'trip' as kind, id from trips where id not in ({_OLD})
    union all select 'item', id from items where trip_id not in ({_OLD})
    union all select 'log', id from items where trip_id not in ({_OLD})""",
)
def _(t):
    trips, items, log = _cascade(t)
    kinds = [("trip", trips, "id"), ("item", items, "id"), ("log", log, "log_id")]
    first, second, third = (d.select(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, d, c in kinds)
    return first.unionByName(second).unionByName(third)


@query("orphan_items", f"select id, trip_id from items where trip_id in ({_OLD})")
def _(t):
    return changes.orphan_items(_cascade(t)[0], t.items).select("id", "trip_id")


@query(
    "upsert_budget",
    """select coalesce(g.list_id, r.list_id) as list_id,
      cast(case when r.list_id is not null then coalesce(m, 0) else monthly_budget end as double) as monthly_budget,
      coalesce(last_cleared, '') as last_cleared
    from buylist_budget g full join (select -list_id as list_id, 10 as m from buylist_budget where last_cleared = ''
      union all select list_id, case when monthly_budget > 0 then 99 end from buylist_budget
      where last_cleared = '2001-08') r on r.list_id = g.list_id""",
)
def _(t):
    fresh = t.buylist_budget.where("last_cleared = ''").select((-F.col("list_id")).alias("list_id"), F.lit(10).alias("monthly_budget"))
    known = t.buylist_budget.where("last_cleared = '2001-08'").select(
        "list_id", F.when(F.col("monthly_budget") > 0, 99).alias("monthly_budget")
    )
    stored = changes.upsert_budget(t.buylist_budget, fresh.unionByName(known))
    return stored.withColumn("monthly_budget", F.col("monthly_budget").cast("double"))


@query(
    "blank_to_null",
    """select item_id, nullif(trim(location), '') as location, nullif(booking_ref, '') as booking_ref,
      nullif(notes, '') as notes, nullif(day_number, 0) as day_number,
      case when coalesce(day_number, 0) <> 0 then nullif(start_time, '') end as start_time,
      case when duration_minutes > 0 then duration_minutes end as duration_minutes from edits""",
)
def _(t):
    return changes.blank_to_null(t.edits)


@query(
    "insert_buylist",
    """select id, list_id, name, cast(price as double) as price, quantity, category, urgency, this_month, bought,
      added_by from buylist_items
    union all
    select request_id + (select max(id) from buylist_items), list_id, trim(name), cast(coalesce(price, 0) as double),
      coalesce(quantity, 1), coalesce(nullif(category, ''), '其他'), coalesce(urgency, 'maybe'), true, false, 'user-1'
    from new_wishes where trim(name) <> ''""",
)
def _(t):
    stored = changes.insert_buylist(t.buylist_items, t.new_wishes, "user-1")
    return stored.select(
        "id", "list_id", "name", F.col("price").cast("double"), "quantity", "category", "urgency", "this_month",
        "bought", "added_by",
    )


@query(
    "insert_wishlist",
    """select id, username, name, category, cast(estimated_price as double) as estimated_price, status from wishlist
    union all
    select request_id + (select max(id) from wishlist), 'user-' || list_id, trim(name), category,
      cast(coalesce(price, 0) as double), 'pending' from new_wishes where trim(name) <> ''""",
)
def _(t):
    batch = t.new_wishes.withColumn("username", F.concat(F.lit("user-"), F.col("list_id").cast("string")))
    stored = changes.insert_wishlist(t.wishlist, batch.drop("list_id"), AS_OF)
    return stored.select(
        "id", "username", "name", "category", F.col("estimated_price").cast("double"), "status"
    )


@query(
    "update_summaries",
    """with changed as (select i.id, i.name, coalesce(p.day_number, i.day_number) as d, p.day_number as pd,
      p.start_time as ps, p.is_confirmed as pc from items i join item_patches p on i.id = p.item_id)
    select id, '已更新「' || name || '」：' || coalesce(nullif(concat_ws('；',
      case when pd is not null then '排到第 ' || d || ' 天' end, '時間改為 ' || ps,
      case when pc then '標記為已確認' when not pc then '取消已確認' end), ''), '無變更') || '。' as summary from changed""",
)
def _(t):
    return changes.update_summaries(t.items, t.item_patches.drop("to_candidate"))
