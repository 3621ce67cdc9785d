"""Queries on overlaps within a day."""

from __future__ import annotations

from wayledger.operators import timeline
from wayledger.plans.registry import query

# Timed items the long way round, for the check queries.
_TIMED = """timed as (select trip_id, day_number, id,
   cast(split_part(start_time, ':', 1) as int) * 60 + cast(split_part(start_time, ':', 2) as int) as s,
   cast(split_part(start_time, ':', 1) as int) * 60 + cast(split_part(start_time, ':', 2) as int)
     + coalesce(duration_minutes, 0) as e
   from items where day_number is not null and start_time is not null)"""
_PAIR = """a.trip_id = b.trip_id and a.day_number = b.day_number and a.id <> b.id and a.s < b.e and b.s < a.e"""


@query(
    "overlap_pairs",
    f"""with {_TIMED}
    select trip_id, day_number, id, partner_id from (
      select a.trip_id, a.day_number, a.id, b.id as partner_id,
        row_number() over (partition by a.id order by case when b.s < a.s then 0 when b.s = a.s then 1 else 2 end,
          case when b.s < a.s then -b.e end, case when b.s < a.s then -b.id end, b.s,
          case when b.s = a.s and b.id < a.id then b.id - 1000000000000000 when b.s = a.s then -b.id else b.id end) as k
      from timed a join timed b on {_PAIR}) where k = 1""",
)
def _(t):
    return timeline.overlap_pairs(t.items)


@query(
    "overlap_counts",
    f"""with {_TIMED}
    select trip_id, day_number, id, (select count(*) from timed b where {_PAIR}) as overlaps from timed a""",
)
def _(t):
    return timeline.overlap_counts(t.items)


@query(
    "conflict_flags",
    f"""with {_TIMED}
    select trip_id, day_number, id, exists (select 1 from timed b where {_PAIR}) as conflict from timed a""",
)
def _(t):
    return timeline.conflict_flags(t.items)


_CLUSTERS = f"""{_TIMED},
    reached as (select *, max(e) over (partition by trip_id, day_number order by s, id
       rows between unbounded preceding and 1 preceding) as reach from timed)"""


@query(
    "overlap_clusters",
    f"""with {_CLUSTERS}
    select trip_id, day_number, id, cast(sum(case when reach is null or s >= reach then 1 else 0 end) over
      (partition by trip_id, day_number order by s, id rows unbounded preceding) as bigint) as cluster from reached""",
)
def _(t):
    return timeline.overlap_clusters(t.items).select("trip_id", "day_number", "id", "cluster")


@query(
    "timeline_columns",
    f"""with recursive {_CLUSTERS},
    numbered as (select *, sum(case when reach is null or s >= reach then 1 else 0 end) over
      (partition by trip_id, day_number order by s, id rows unbounded preceding) as cluster from reached),
    steps as (select *, row_number() over (partition by trip_id, day_number, cluster order by s, id) as k from numbered),
    walk as (
      select trip_id, day_number, cluster, k, id, 0 as col, [{{'c': 0, 's': s, 'e': e}}] as placed from steps where k = 1
      union all
      select trip_id, day_number, cluster, k, id, col, list_append(placed, {{'c': col, 's': s, 'e': e}}) from (
        select n.trip_id, n.day_number, n.cluster, n.k, n.id, n.s, n.e, w.placed,
          cast(list_min(list_filter(range(0, len(w.placed) + 1), lambda c: len(list_filter(w.placed,
            lambda o: o.c = c and o.s < n.e and n.s < o.e)) = 0)) as int) as col
        from walk w join steps n on n.trip_id = w.trip_id and n.day_number = w.day_number and n.cluster = w.cluster
          and n.k = w.k + 1))
    select trip_id, day_number, cast(cluster as bigint) as cluster, id, col,
      max(col) over (partition by trip_id, day_number, cluster) + 1 as cols from walk""",
)
def _(t):
    return timeline.timeline_columns(t.items)


@query(
    "trip_overview",
    f"""with {_TIMED},
    c as (select trip_id, count(*) as conflicts from timed a
          where exists (select 1 from timed b where {_PAIR}) group by trip_id)
    select trips.id as trip_id, any_value(trips.name) as name,
      any_value(date_diff('day', start_date, end_date) + 1) as total_days, count(day_number) as scheduled,
      count(items.id) - count(day_number) as candidates,
      count(*) filter (confirm_required and not is_confirmed) as attention,
      coalesce(any_value(c.conflicts), 0) as conflicts
    from trips left join items on items.trip_id = trips.id left join c on c.trip_id = trips.id group by trips.id""",
)
def _(t):
    return timeline.trip_overview(t.trips, t.items)
