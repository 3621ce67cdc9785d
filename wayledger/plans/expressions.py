"""Queries on the single-column expressions and the readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.functions import clock, money, text
from wayledger.plans.registry import query
from wayledger.session import shared_folder
from wayledger.sources.tables import fill_defaults, read_table, write_snapshot

_LAX = "regexp_full_match(start_time, '[0-9]{1,2}:[0-9]{2}')"
_MIN = f"""case when {_LAX} then cast(split_part(start_time, ':', 1) as int) * 60
  + cast(split_part(start_time, ':', 2) as int) end"""


#: The declared tables: the view each is made from and the key its snapshots are clustered by.
_STORED = {
    "trips": ("trips", "id"),
    "itinerary_items": ("items", "trip_id"),
    "wishlist": ("wishlist", "id"),
    "buylist_items": ("buylist_items", "list_id"),
    "buylist_budget": ("buylist_budget", "list_id"),
    "sauces": ("sauces", "list_id"),
}


@query(
    "read_tables",
    " union all ".join(
        f"select '{name}' as name, count(*) as n, count(distinct {key}) as keys from {view}"
        for name, (view, key) in (_STORED | {"trip_adjustments": ("items", "trip_id")}).items()
    ),
)
def _(t):
    """Every table written as a snapshot with its declared schema, read back and counted."""
    root, out = shared_folder(t.spark, "tables"), []
    log = t.items.select("id", "trip_id", F.lit("moved").alias("instruction"))
    frames = {name: (getattr(t, view), key) for name, (view, key) in _STORED.items()} | {"trip_adjustments": (log, "trip_id")}
    for name, (rows, key) in frames.items():
        write_snapshot(fill_defaults(rows, name), f"{root}/{name}", key, "id" if "id" in rows.columns else key)
        stored = read_table(t.spark, f"{root}/{name}", name)
        counts = stored.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys"))
        out.append(counts.select(F.lit(name).alias("name"), "n", "keys"))
    return reduce(DataFrame.unionByName, out)


@query("time_to_minutes", f"select request_id, {_MIN} as minutes from new_items")
def _(t):
    return t.new_items.select("request_id", clock.time_to_minutes(F.col("start_time")).alias("minutes"))


_CLOCK = """lpad(cast(greatest(0, least(1439, m)) // 60 as varchar), 2, '0') || ':' ||
  lpad(cast(greatest(0, least(1439, m)) % 60 as varchar), 2, '0')"""


@query(
    "minutes_to_time",
    f"select id, {_CLOCK} as time from (select id, sort_order * 400 - 100 as m from items)",
)
def _(t):
    return t.items.select("id", clock.minutes_to_time(F.col("sort_order") * 400 - 100).alias("time"))


@query(
    "shift_time",
    f"""select id, {_CLOCK} as time from (select id, {_MIN} + (day_number - 2) * 600 as m from items) where m is not null
    union all select id, null from (select id, {_MIN} + (day_number - 2) * 600 as m from items) where m is null""",
)
def _(t):
    shifted = clock.shift_time(F.col("start_time"), (F.col("day_number") - 2) * 600)
    return t.items.select("id", shifted.alias("time"))


@query(
    "valid_time",
    """select item_id, coalesce(regexp_full_match(trim(start_time), '[0-9]{2}:[0-9]{2}')
        and cast(split_part(trim(start_time), ':', 1) as int) < 24
        and cast(split_part(trim(start_time), ':', 2) as int) < 60, false) as page,
      coalesce(regexp_full_match(trim(start_time), '([01][0-9]|2[0-3]):[0-5][0-9]'), false) as strict,
      coalesce(regexp_full_match(start_time, '([01]?[0-9]|2[0-3]):[0-5][0-9]'), false) as suggestion,
      coalesce(regexp_full_match(start_time, '[0-9]{1,2}:[0-9]{2}'), false) as lax,
      coalesce(regexp_matches(start_time, '^[0-9]{1,2}:[0-9]{2}'), false) as export from item_patches""",
)
def _(t):
    checks = [clock.valid_time(F.col("start_time"), g).alias(g) for g in clock.GRAMMARS]
    return t.item_patches.select("item_id", *checks)


@query(
    "end_time",
    f"""select id, case when m is not null then {_CLOCK} end as end_time
    from (select id, {_MIN} + duration_minutes as m from items)""",
)
def _(t):
    return t.items.select("id", clock.end_time(F.col("start_time"), F.col("duration_minutes")).alias("end_time"))


@query("total_days", "select id, date_diff('day', start_date, end_date) + 1 as total_days from trips")
def _(t):
    return t.trips.select("id", clock.total_days(F.col("start_date"), F.col("end_date")).alias("total_days"))


@query(
    "money_text",
    """select id, 'NT$ ' || format('{:,}', cast(floor(price + 0.5) as bigint)) as price,
      'NT$ ' || format('{:,}', cast(floor(coalesce(actual_price, 0) + 0.5) as bigint)) as actual from buylist_items""",
)
def _(t):
    price, actual = (money.money_text(F.col(c)) for c in ("price", "actual_price"))
    return t.buylist_items.select("id", price.alias("price"), actual.alias("actual"))


@query(
    "ics_escape",
    r"""select id, replace(replace(replace(replace(notes, '\', '\\'), ';', '\;'), ',', '\,'), chr(10), '\n') as escaped
    from items""",
)
def _(t):
    return t.items.select("id", text.ics_escape(F.col("notes")).alias("escaped"))


@query(
    "csv_escape",
    r"""select id, case when contains(location, '"') or contains(location, ',')
        then '"' || replace(location, '"', '""') || '"' else location end as location,
      case when contains(notes, ',') or contains(notes, chr(10)) then '"' || replace(notes, '"', '""') || '"'
        else notes end as notes from items""",
)
def _(t):
    cells = [text.csv_escape(F.col(c)).alias(c) for c in ("location", "notes")]
    return t.items.select("id", *cells)


@query(
    "js_trim",
    r"""select list_id, md5(regexp_replace(text, '^[\t\n\x0B\f\r\p{Z}\x{FEFF}]+|[\t\n\x0B\f\r\p{Z}\x{FEFF}]+$', '', 'g'))
      as trimmed from (select list_id, chr(12288) || ' ' || text || chr(10) || chr(160) as text from pastes)""",
)
def _(t):
    padded = F.concat(F.lit("　 "), "text", F.lit("\n "))
    return t.pastes.select("list_id", F.md5(text.js_trim(padded)).alias("trimmed"))


@query(
    "js_parse_int",
    """select reply_id, pos, try_cast(regexp_extract(trim(day), '^[+-]?[0-9]+') as bigint) as day,
      try_cast(regexp_extract(trim(duration_minutes), '^[+-]?[0-9]+') as bigint) as minutes from reply_rows""",
)
def _(t):
    day, minutes = (text.js_parse_int(F.col(c)) for c in ("day", "duration_minutes"))
    return t.reply_rows.select("reply_id", "pos", day.alias("day"), minutes.alias("minutes"))
