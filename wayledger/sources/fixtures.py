"""The domain tables derived from the benchmark tables.

Every view is one SQL text that means the same on Spark and in the checking database:
it builds the DataFrame here and goes into the ``with`` clause there.  Views cover their
whole source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayledger.session import tune
from wayledger.sources.tables import read_table

# The benchmark tables as they are stored.
RAW: dict[str, str] = {
    "orders": (
        "o_orderkey LONG, o_custkey LONG, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
        "o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey LONG, l_partkey LONG, l_suppkey LONG, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
        "l_shipdate TIMESTAMP_NTZ"
    ),
    "customer": "c_custkey LONG, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey LONG, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "supplier": "s_suppkey LONG, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "events": "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG",
}

_LINES = """select l.*, row_number() over (partition by l_orderkey
           order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as seq
  from lineitem l"""

# name -> (tables and views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "trips": (
        ("orders",),
        """
select o_orderkey as id, concat('user-', o_custkey) as username, concat('Trip ', o_orderkey) as name,
       cast(o_orderdate as date) as start_date,
       cast(o_orderdate as date) + cast(o_orderkey % 5 as int) as end_date,
       o_orderpriority as notes, o_orderdate as created_at
from orders""",
    ),
    "items": (
        ("lineitem",),
        f"""
with b as ({_LINES}),
d as (
  select *, (l_returnflag = 'R' and l_linenumber % 2 = 0) as cand,
         cast(480 + (l_suppkey * 15) % 840 as int) as m, cast(l_quantity as int) as q
  from b)
select cast(l_orderkey * 100 + seq as bigint) as id, l_orderkey as trip_id,
       case when cand then null else cast(1 + l_partkey % (1 + l_orderkey % 5) as int) end as day_number,
       concat('Place ', l_partkey) as name,
       case cast(l_partkey % 7 as int) when 0 then 'restaurant' when 1 then 'hotel' when 2 then 'attraction'
            when 3 then 'shopping' when 4 then 'transport' when 5 then 'other' else 'unknown' end as category,
       case when cand or l_suppkey % 10 = 0 then null
            else concat(lpad(cast(cast(floor(m / 60) as int) as string), 2, '0'), ':',
                        lpad(cast(m % 60 as string), 2, '0')) end as start_time,
       case when q % 11 = 0 then null when q % 13 = 0 then 0 else 15 * (1 + q % 12) end as duration_minutes,
       case when l_linenumber % 3 = 0 then '' when l_linenumber % 3 = 1 then '  '
            else concat('Shop "', l_suppkey, '", A') end as location,
       '' as address,
       case when l_partkey % 4 = 0 then concat('CONF-', l_partkey) else '' end as booking_ref,
       case when l_partkey % 3 = 0 then concat('a; b, c', chr(10), 'd ', chr(92), ' ', l_suppkey) else '' end as notes,
       'manual' as source, cast(seq - 1 as int) as sort_order,
       l_returnflag = 'A' as confirm_required, l_linestatus = 'F' as is_confirmed, l_shipdate as created_at
from d""",
    ),
    "buylist_items": (
        ("orders",),
        """
select o_orderkey as id, o_custkey as list_id, concat('Item ', o_orderkey % 50) as name,
       case when o_orderkey % 17 = 0 then cast(0 as decimal(12,2))
            else cast(o_totalprice as decimal(12,2)) end as price,
       case o_orderpriority when '1-URGENT' then 'need' when '2-HIGH' then 'want'
            when '3-MEDIUM' then 'maybe' when '5-LOW' then 'later' end as urgency,
       case cast(o_orderkey % 4 as int) when 0 then 'tw_easy' when 1 then 'overseas' when 2 then 'rare'
            else 'other' end as accessibility,
       o_orderkey % 3 <> 0 as this_month, o_orderstatus = 'F' as bought,
       concat('user-', o_custkey % 2) as added_by,
       case when o_orderkey % 7 = 0 then 'Gift 100%_sure' else '' end as note, '' as link,
       case when o_orderkey % 9 = 8 then '' when o_orderkey % 9 = 7 then 'legacy'
            else concat('cat', o_orderkey % 9) end as category,
       cast(o_orderkey % 3 * 10 as decimal(12,2)) as recurring_cost, o_orderdate as created_at,
       o_orderkey % 6 = 0 as starred, cast(1 + o_orderkey % 4 as int) as quantity,
       case when o_orderkey % 4 = 0 then '' when o_orderkey % 4 = 1 then ' Japan '
            else concat('tag', o_custkey % 5) end as tag,
       case when o_orderstatus = 'F' and o_orderkey % 5 <> 0
            then cast(cast(o_totalprice as decimal(12,2)) + cast(o_orderkey % 3 - 1 as decimal(12,2))
                 as decimal(12,2)) end as actual_price
from orders""",
    ),
    "buylist_budget": (
        ("customer",),
        """
select c_custkey as list_id,
       case when c_custkey % 10 = 0 then null when c_acctbal < 0 then cast(0 as decimal(12,2))
            else cast(cast(c_acctbal as decimal(12,2)) * 50 as decimal(12,2)) end as monthly_budget,
       case cast(c_custkey % 3 as int) when 0 then '' when 1 then '2001-08' else '2001-07' end as last_cleared
from customer""",
    ),
    "sauces": (
        ("supplier",),
        """
select s_suppkey as id, cast(s_nationkey as bigint) as list_id, s_name as name, '' as url,
       cast(s_suppkey % 6 as int) as spiciness, cast(1 + s_suppkey * 3 % 5 as int) as aroma,
       cast(1 + s_suppkey * 7 % 5 as int) as cp, cast(1 + s_suppkey % 3 as int) as repurchase,
       '' as added_by, date '2024-01-01' + cast(s_suppkey as int) as created_at
from supplier""",
    ),
    "wishlist": (
        ("part",),
        """
select p_partkey as id, concat('user-', p_partkey % 20) as username, p_name as name, p_type as category,
       cast(p_retailprice as decimal(12,2)) as estimated_price,
       case when p_size % 3 = 0 then 'purchased' else 'pending' end as status, '' as notes
from part""",
    ),
    "change_feed": (
        ("events",),
        """
select event_id, ts, user_id * 10 + event_id % 10 as id, user_id as list_id,
       case event_type when 'signup' then 'insert' when 'error' then 'delete' else 'update' end as op,
       concat('item ', event_type) as name, cast(value as decimal(12,2)) as price,
       case cast(event_id % 4 as int) when 0 then 'need' when 1 then 'want' when 2 then 'maybe' end as urgency,
       'tw_easy' as accessibility, event_type <> 'click' as this_month, event_type = 'purchase' as bought,
       concat('user-', cast(user_id as string)) as added_by, event_type as note, '' as link,
       case cast(event_id % 3 as int) when 0 then '' when 1 then '食品' else event_type end as category,
       cast(event_id % 3 as decimal(12,2)) as recurring_cost, ts as created_at, event_type = 'view' as starred,
       cast(event_id % 5 as int) as quantity, case when event_type = 'view' then 'seen' else '' end as tag,
       case when event_type = 'purchase' then cast(value as decimal(12,2)) end as actual_price
from events""",
    ),
    "replies": (
        ("events",),
        """
select event_id as reply_id, event_id as trip_id,
       case cast(event_id % 8 as int)
         when 0 then '' when 1 then 'not json' when 2 then '{"day":1}' when 3 then '[]'
         when 4 then concat('[{"day":"2","name":"Place ', user_id, '","category":"RESTAURANT","start_time":"9:30"}]')
         when 5 then concat('```JSON', chr(10), '[{"day":1,"name":"A"}]', chr(10), '```')
         when 6 then 'Here: [{"day":9,"name":"B","duration_minutes":0}] bye'
         else '[{"name":"  "},{"name":"C","category":"food","start_time":"25:00"}]' end as raw
from events""",
    ),
    "reply_rows": (
        ("lineitem",),
        f"""
with b as ({_LINES})
select l_orderkey as reply_id, l_orderkey as trip_id, cast(seq - 1 as int) as pos,
       case when seq % 9 = 0 then '   ' else concat(' Place ', l_partkey, ' ') end as name,
       case cast(l_suppkey % 6 as int) when 0 then '0' when 1 then '99' when 2 then 'x' when 3 then '3 days'
            else cast(l_linenumber as string) end as day,
       case cast(l_partkey % 5 as int) when 0 then '25:00' when 1 then '9:30' when 2 then null when 3 then '18:45'
            else 'noon' end as start_time,
       case cast(l_linenumber % 4 as int) when 0 then '0' when 1 then '90' when 2 then 'abc' else null
            end as duration_minutes,
       case cast(l_partkey % 4 as int) when 0 then 'RESTAURANT' when 1 then ' hotel ' when 2 then 'food'
            else null end as category,
       case when l_suppkey % 2 = 0 then concat(' Area ', l_suppkey) else '' end as location
from b""",
    ),
    "product_replies": (
        ("part",),
        """
select p_partkey as reply_id,
       case cast(p_partkey % 6 as int)
         when 0 then 'nothing found'
         when 1 then concat('Sure.', chr(10), '{"name": " ', p_name, ' ",', chr(10), '"price": ',
                            cast(cast(p_retailprice as decimal(12,2)) as string), '} done')
         when 2 then concat('{"name":"', p_brand, '","price":0}')
         when 3 then concat('{"name":"', p_name, '","price":"', cast(p_size as string), '.5"}')
         when 4 then concat('{"name":"", "price":', cast(p_size as string), '}')
         else concat('{"name": ', p_name, '}') end as raw
from part""",
    ),
    "answers": (
        ("customer",),
        """
select c_custkey as request_id, case when c_nationkey % 4 = 0 then '  ' else c_name end as destination,
       concat(cast(1 + c_nationkey % 7 as string), ' days') as days,
       case when c_custkey % 3 = 0 then null else ' 2 adults ' end as people, c_mktsegment as preference,
       cast(cast(c_acctbal as decimal(12,2)) as string) as budget,
       case when c_custkey % 2 = 0 then '' else concat('no ', lower(c_mktsegment)) end as extra
from customer""",
    ),
    "plan_texts": (
        ("documents",),
        "select doc_id as request_id, doc_id as trip_id, text from documents",
    ),
    "pastes": (("documents",), "select doc_id as list_id, text from documents"),
    "reorder_requests": (
        ("items",),
        """
select trip_id, day_number, case when id % 13 = 0 then -id else id end as item_id,
       cast(row_number() over (partition by trip_id, day_number order by id desc) - 1 as int) as pos
from items where day_number is not null""",
    ),
    "cascade_requests": (
        ("items",),
        "select trip_id as request_id, trip_id, min(id) as target_id, '10:00' as new_time from items group by trip_id",
    ),
    "cascade_picks": (
        ("items",),
        "select trip_id as request_id, case when confirm_required then -id else id end as item_id from items",
    ),
    "single_requests": (
        ("items",),
        """
select id as request_id, id as item_id,
       case when category = 'hotel' then 'noon' when confirm_required then '11:15' else '20:40' end as new_time
from items""",
    ),
    "share_requests": (("buylist_items",), "select distinct list_id, tag from buylist_items"),
    "new_items": (
        ("items",),
        """
select id as request_id, case when id % 101 = 0 then -1 else trip_id end as trip_id,
       case when id % 19 = 0 then '  ' when id % 23 = 0 then null else name end as name,
       case when id % 3 = 0 then null else cast(id % 7 as int) end as day_number,
       case when id % 4 = 0 then null when id % 4 = 1 then '08:15' else '7:5' end as start_time,
       duration_minutes, case when id % 2 = 0 then category end as category
from items""",
    ),
    "item_patches": (
        ("items",),
        """
select case when id % 97 = 0 then -id else id end as item_id, id % 11 = 0 as to_candidate,
       case when id % 3 = 0 then cast(id % 8 as int) end as day_number,
       case when id % 5 = 0 then '9:30' when id % 5 = 1 then ' 14:00 ' when id % 5 = 2 then '24:00' end as start_time,
       case when id % 4 = 0 then true end as is_confirmed
from items""",
    ),
    "patch_sequence": (
        ("items",),
        """
select id as item_id, 1 as at, confirm_required as to_candidate, null as day_number, null as start_time,
       not confirm_required as is_confirmed from items
union all select id, 2, false, null, null, true from items where duration_minutes > 60
union all select id, 3, false, 2, '08:15', null from items where category = 'hotel' or duration_minutes > 90
union all select id, 4, category = 'hotel' and duration_minutes > 60, null, null, null from items""",
    ),
    "new_trips": (
        ("trips",),
        """
select id as request_id, username, name, start_date,
       case when id % 6 = 0 then start_date - 1 else end_date end as end_date
from trips""",
    ),
    "new_wishes": (
        ("part",),
        """
select p_partkey as request_id, cast(p_size as bigint) as list_id,
       case when p_partkey % 10 = 0 then '   ' else concat(' ', p_name, ' ') end as name,
       case when p_partkey % 3 = 0 then null else cast(p_retailprice as decimal(12,2)) end as price,
       case when p_partkey % 4 = 0 then null else cast(p_size as int) end as quantity,
       case when p_partkey % 5 = 0 then '' else p_type end as category,
       case cast(p_partkey % 6 as int) when 0 then 'need' when 1 then 'want' when 2 then 'maybe' when 3 then 'NEED'
            when 4 then 'soon' else null end as urgency,
       case cast(p_partkey % 5 as int) when 0 then ' Pending ' when 1 then 'PURCHASED' when 2 then 'open'
            when 3 then 'purchased' else null end as status
from part""",
    ),
    "edits": (
        ("items",),
        """
select id as item_id, location, booking_ref, notes, day_number, case when id % 2 = 0 then '09:45' else '' end
       as start_time, case when id % 7 = 0 then day_number - 2 else duration_minutes end as duration_minutes
from items""",
    ),
}


class Tables:
    """The benchmark tables and derived views of one folder, as DataFrame attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = str(folder).rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def with_table(self, name: str, rows: DataFrame) -> Tables:
        """The same tables, with ``rows`` as one of them and below the views that read it."""
        other = Tables(self.spark, self.folder)
        other._made[name] = rows
        return other

    def _make(self, name: str) -> DataFrame:
        # A view and a benchmark table never share a name.
        if name in RAW:
            from pyspark.sql import types as T

            return read_table(self.spark, f"{self.folder}/{name}.parquet", T.StructType.fromDDL(RAW[name]))
        needs, sql = VIEWS[name]
        for need in needs:
            getattr(self, need).createOrReplaceTempView(need)
        return self.spark.sql(sql)


def with_views(sql: str) -> str:
    """Put the views a check query names, and those they need, in front of it."""
    import re

    wanted: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            if need in VIEWS:
                visit(need)
        if name not in wanted:
            wanted.append(name)

    for name in VIEWS:
        if re.search(rf"(?i)\b(from|join)\s+{name}\b", sql):
            visit(name)
    blocks = [f"{name} as ({VIEWS[name][1].strip()}\n)" for name in wanted]
    own = sql.strip()
    for opening in ("with recursive ", "with "):
        if own.lower().startswith(opening):
            blocks.append(own[len(opening) :])
            return opening + ",\n".join(blocks)
    return ("with " + ",\n".join(blocks) + "\n" + own) if blocks else own
