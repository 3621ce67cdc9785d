"""Queries on the reading side of the trips."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from wayledger.operators import itinerary
from wayledger.plans.registry import query

TODAY = datetime.date(1998, 6, 15)


@query(
    "trips_by_user",
    """select username, id, row_number() over (partition by username order by start_date desc nulls first, id) as rank
    from trips""",
)
def _(t):
    return itinerary.trips_by_user(t.trips).select("username", "id", "rank")


@query(
    "trips_list",
    """select id, name, cast(start_date as varchar) as start_date, cast(end_date as varchar) as end_date,
      row_number() over (order by start_date desc nulls first, id) as rank from trips""",
)
def _(t):
    return itinerary.trips_list(t.trips).select(
        "id", "name", F.col("start_date").cast("string"), F.col("end_date").cast("string"), "rank"
    )


def _rank_sql(keys: str, order: str, where: str = "true", extra: str = "") -> str:
    return (
        f"select trip_id, id, {extra} row_number() over (partition by {keys} order by {order}, id) as rank "
        f"from items where {where}"
    )


_TIME_ORDER = "day_number asc nulls last, start_time asc nulls last"


@query(
    "items_by_day",
    _rank_sql("trip_id, day_number", "start_time asc nulls last, sort_order", "day_number is not null", "day_number,"),
)
def _(t):
    return itinerary.items_by_day(t.items).select("trip_id", "id", "day_number", "rank")


@query("items_all", _rank_sql("trip_id", f"{_TIME_ORDER}, sort_order"))
def _(t):
    return itinerary.items_all(t.items).select("trip_id", "id", "rank")


@query("items_scheduled", _rank_sql("trip_id", f"{_TIME_ORDER}, sort_order", "day_number is not null"))
def _(t):
    return itinerary.items_scheduled(t.items).select("trip_id", "id", "rank")


@query("items_candidates", _rank_sql("trip_id", "id", "day_number is null"))
def _(t):
    return itinerary.items_candidates(t.items).select("trip_id", "id", "rank")


@query(
    "items_unconfirmed_required", _rank_sql("trip_id", _TIME_ORDER, "confirm_required and not is_confirmed")
)
def _(t):
    return itinerary.items_unconfirmed_required(t.items).select("trip_id", "id", "rank")


@query("items_filtered", _rank_sql("trip_id", _TIME_ORDER, "day_number = 2 and not is_confirmed"))
def _(t):
    return itinerary.items_filtered(t.items, day=2, only_unconfirmed=True).select("trip_id", "id", "rank")


@query("items_filtered_candidates", _rank_sql("trip_id", _TIME_ORDER, "day_number is null"))
def _(t):
    return itinerary.items_filtered(t.items, only_candidates=True).select("trip_id", "id", "rank")


@query(
    "checklist_order",
    _rank_sql("trip_id", f"confirm_required desc nulls first, is_confirmed asc nulls last, {_TIME_ORDER}"),
)
def _(t):
    return itinerary.checklist_order(t.items).select("trip_id", "id", "rank")


@query(
    "where_label",
    """select id, case when day_number is null then '候選中' when coalesce(start_time, '') = '' then 'Day ' || day_number
    else 'Day ' || day_number || ' ' || start_time end as where_label from items""",
)
def _(t):
    return itinerary.where_label(t.items).select("id", "where_label")


@query(
    "category_labels",
    """select id, coalesce(label, '📌 其他') as label, split_part(coalesce(label, '📌 其他'), ' ', 1) as icon
    from items left join (values ('restaurant', '🍽️ 餐廳'), ('hotel', '🏨 住宿'), ('attraction', '🏛️ 景點'),
      ('shopping', '🛍️ 購物'), ('transport', '🚆 交通'), ('other', '📌 其他')) as l(code, label) on category = code""",
)
def _(t):
    return itinerary.category_labels(t.items).select("id", "label", "icon")


@query(
    "plan_place",
    """select id, case when notes <> '' then notes when booking_ref <> '' then '📋 ' || booking_ref else '' end as place
    from items""",
)
def _(t):
    return itinerary.plan_place(t.items).select("id", "place")


_DATE_LABEL = "'Day ' || d || ' (' || strftime(start_date + cast(d - 1 as int), '%m/%d') || ')'"


@query(
    "item_dates",
    f"""select id, cast(start_date + cast(d - 1 as int) as varchar) as date, {_DATE_LABEL} as day_label
    from (select items.id, day_number as d, start_date from items join trips on trip_id = trips.id
          where day_number is not null)""",
)
def _(t):
    return itinerary.item_dates(t.trips, t.items).select("id", F.col("date").cast("string"), "day_label")


@query(
    "plan_time_sort",
    """select trip_id, day_number, id, row_number() over (partition by trip_id, day_number
       order by coalesce(nullif(start_time, ''), '99:99'), id) as rank from items where day_number is not null""",
)
def _(t):
    return itinerary.plan_time_sort(t.items).select("trip_id", "day_number", "id", "rank")


@query(
    "day_plan",
    f"""with days as (
      select id as trip_id, start_date, unnest(generate_series(1, date_diff('day', start_date, end_date) + 1)) as d
      from trips)
    select days.trip_id, cast(d as int) as day_number, {_DATE_LABEL} as day_label, items.id as item_id, items.start_time,
      case when items.id is not null then row_number() over (partition by days.trip_id, d
        order by coalesce(items.start_time, '99:99'), items.id) end as rank
    from days left join items on items.trip_id = days.trip_id and items.day_number = d""",
)
def _(t):
    plan = itinerary.day_plan(t.trips, t.items)
    return plan.select("trip_id", "day_number", "day_label", "item_id", "start_time", "rank")


@query(
    "trip_summary",
    """select trips.id as trip_id, any_value(trips.name) as name,
      any_value(date_diff('day', start_date, end_date) + 1) as total_days,
      count(day_number) as scheduled, count(items.id) - count(day_number) as candidates
    from trips left join items on items.trip_id = trips.id group by trips.id""",
)
def _(t):
    return itinerary.trip_summary(t.trips, t.items)


@query(
    "today_day",
    """select id as trip_id, case when date '1998-06-15' between start_date and end_date
      then date_diff('day', start_date, date '1998-06-15') + 1 end as today_day from trips""",
)
def _(t):
    return itinerary.today_day(t.trips, TODAY)


_SECTION = """case when confirm_required and not is_confirmed then 'must_unconfirmed'
   when confirm_required then 'must_confirmed' else 'flexible' end"""


@query("checklist_sections", f"select id, {_SECTION} as section from items")
def _(t):
    return itinerary.checklist_sections(t.items).select("id", "section")


@query(
    "checklist_counts",
    f"""select trip_id, sum(case when s = 'must_unconfirmed' then 1 else 0 end)::bigint as must_unconfirmed,
      sum(case when s = 'must_confirmed' then 1 else 0 end)::bigint as must_confirmed,
      sum(case when s = 'flexible' then 1 else 0 end)::bigint as flexible,
      not bool_or(s = 'must_unconfirmed') as all_clear
    from (select trip_id, {_SECTION} as s from items) group by trip_id""",
)
def _(t):
    return itinerary.checklist_counts(t.items)


@query("day_plan_counts", "select trip_id, day_number, count(*) as items from items group by trip_id, day_number")
def _(t):
    return itinerary.day_plan_counts(t.items)


@query(
    "attention_count",
    """select trip_id, count(*) as items, count(*) filter (confirm_required and not is_confirmed) as attention
    from items where day_number is null group by trip_id""",
)
def _(t):
    listing = itinerary.items_filtered(t.items, only_candidates=True)
    return itinerary.attention_count(listing, ["trip_id"])


def _summary_sql(scope: str, where: str) -> str:
    return f"""with listed as (select trip_id, count(*) as n, count(*) filter (confirm_required and not is_confirmed) as a
      from items where {where} group by trip_id)
    select id as trip_id, coalesce(n, 0) as items, coalesce(a, 0) as attention, case when coalesce(n, 0) = 0
      then '這趟旅程的{scope}是空的。' else '{scope}共 ' || n || ' 筆' || case when a > 0
        then '，其中 ' || a || ' 項必須確認但還沒確認。' else '。' end end as summary
    from trips left join listed on trip_id = id"""


@query("listing_summary", _summary_sql("全部項目", "true"))
def _(t):
    return itinerary.listing_summary(t.trips, t.items)


@query("listing_summary_unconfirmed", _summary_sql("第 1 天的項目（僅未確認）", "day_number = 1 and not is_confirmed"))
def _(t):
    return itinerary.listing_summary(t.trips, t.items, day=1, only_unconfirmed=True)


@query(
    "trip_headline",
    """with r as (select *, row_number() over (partition by username order by start_date desc, id) as k,
        count(*) over (partition by username) as n from trips)
    select username, n, '共 ' || n || ' 趟旅程：' || string_agg(name || '（' || start_date || ' ~ ' || end_date || '）',
      '、' order by k) || case when n > 3 then '，另有 ' || (n - 3) || ' 趟' else '' end || '。' as summary
    from r where k <= 3 group by username, n""",
)
def _(t):
    return itinerary.trip_headline(t.trips).select("username", "n", "summary")
