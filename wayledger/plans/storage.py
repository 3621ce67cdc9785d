"""Queries that go through stored forms: bucketed tables, posting lists, document files, raw text."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayledger.operators import changes, exports, planning, search
from wayledger.plans import changes as change_plans
from wayledger.plans.exports import AS_OF, DOCUMENT_SQL
from wayledger.plans.registry import query
from wayledger.session import shared_folder
from wayledger.sources import documents, raw
from wayledger.sources.buckets import BucketedTable

BUCKETS = 64
#: Sub-folders of document files.
FOLDERS = 1_024


def _bucketed(t):
    """The items in buckets, and the tables with the stored items: batches are made from what the table holds."""
    table = BucketedTable(t.spark, f"{shared_folder(t.spark, 'bucketed')}/items", "itinerary_items", BUCKETS)
    table.create(t.items)
    return table, t.with_table("items", table.read())


@query("patch_items_in_buckets", change_plans.PATCH_SQL)
def _(t):
    """Only the buckets of the patched ids are rewritten."""
    table, t = _bucketed(t)
    patches = t.item_patches.drop("to_candidate")
    table.apply_requests(patches, changes.patch_items, "item_id")
    return table.read().select("id", "day_number", "start_time", "is_confirmed", "name")


@query("unschedule_items_in_buckets", change_plans.UNSCHEDULE_SQL)
def _(t):
    table, t = _bucketed(t)
    ids = t.items.where("confirm_required").select("id")
    table.apply_requests(ids, changes.unschedule_items)
    return table.read().select("id", "day_number", "start_time", "sort_order")


@query("schedule_items_in_buckets", change_plans.SCHEDULE_SQL)
def _(t):
    """Places come from the whole table, read by its narrow columns; the rows written are those of the touched buckets."""
    table, t = _bucketed(t)
    asked = t.items.where(F.col("day_number").isNull()).select(
        F.col("id").alias("item_id"), F.lit(1).alias("day_number"), F.lit("10:30").alias("start_time")
    )
    placed = changes.schedule_patches(t.items, asked)
    table.apply_requests(placed, changes.patch_items, "item_id")
    return table.read().select("id", "day_number", "start_time", "sort_order")


@query("apply_plans_in_buckets", change_plans.APPLY_SQL)
def _(t):
    table, t = _bucketed(t)
    updates = changes.reorder_updates(planning.reorder_plan(t.items, t.reorder_requests))
    table.apply_requests(updates, lambda rows, part: changes.apply_plans(rows, part)[0])
    return table.read().select("id", "start_time", "sort_order")


@query("delete_rows_in_buckets", change_plans.DELETE_SQL)
def _(t):
    table, t = _bucketed(t)
    gone = t.items.where((F.col("category") == "unknown") & F.col("day_number").isNull()).select("id")
    table.apply_requests(gone, changes.delete_rows)
    return table.read().select("id", "trip_id")


_SEARCHES = """searches as (select distinct lower(trim(x)) as sought from (
      select substring(name, 2, 4) as x from buylist_items union select tag from buylist_items
      union select substring(note, 1, 2) from buylist_items union select category from buylist_items
      union select substring(link, 3, 6) from buylist_items) as texts where x is not null)"""


@query(
    "buylist_search_many",
    f"""with {_SEARCHES} select sought as search_id, list_id, id from searches join buylist_items on
      contains(lower(coalesce(name, '')), sought) or contains(lower(coalesce(note, '')), sought)
      or contains(lower(coalesce(tag, '')), sought) or contains(lower(coalesce(category, '')), sought)""",
)
def _(t):
    """Parts of the table's own texts, all searched at once through posting lists."""
    items = t.buylist_items
    parts = [F.substring("name", 2, 4), F.col("tag"), F.substring("note", 1, 2), F.col("category"), F.substring("link", 3, 6)]
    texts = items.select(F.explode(F.array(*parts)).alias("text")).where("text is not null")
    texts = texts.select(F.lower(F.trim("text")).alias("text")).distinct()
    folder = shared_folder(t.spark, "search-index")
    search.write_index(search.build_index(items), folder)
    found = search.search(items, t.spark.read.parquet(folder), texts.select(F.col("text").alias("search_id"), "text"))
    return found.select("search_id", "list_id", "id")


def _files(t, parts, key: str, suffix: str):
    folder = shared_folder(t.spark, "documents")
    documents.write_documents(parts, F.col(key), folder, suffix, body="document", folders=FOLDERS)
    found = documents.read_documents(t.spark, folder, suffix, FOLDERS)
    return found.select(F.col("key").cast("long").alias(key), F.col("body").alias("document"))


def _whole(key: str, name: str) -> str:
    return f"select {key}, document from ({DOCUMENT_SQL[name]}) as parts"


@query("ics_files", _whole("trip_id", "ics_documents"))
def _(t):
    """One calendar file per trip, written by the document sink and read back."""
    return _files(t, exports.ics_documents(t.trips, t.items, AS_OF), "trip_id", ".ics")


@query("maps_csv_files", _whole("trip_id", "maps_csv_documents"))
def _(t):
    return _files(t, exports.maps_csv_documents(t.items), "trip_id", ".csv")


@query("buylist_files", _whole("list_id", "buylist_markdown"))
def _(t):
    return _files(t, exports.buylist_markdown(t.buylist_items), "list_id", ".md")


def _spoiled_trips(t):
    """Trips as an older writer left them: cut lines, arrays, wrong types, missing names, by id."""
    kind = F.col("id") % 9
    cut = F.when(kind == 0, F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "name": "cut')))
    cut = cut.when(kind == 1, F.lit("[1, 2]")).when(kind == 2, F.lit('{"id": 5, "username": "u", "name": "n", "start_date": "soon", "end_date": "2001-01-01"}'))
    cut = cut.when(kind == 3, F.lit('{"id": 6, "username": "u", "start_date": "2001-01-01", "end_date": "2001-01-01"}'))
    return raw.raw_lines(t.trips, cut)


_KINDS = """trip_kinds as (select *, case id % 9 when 0 then 'unreadable' when 1 then 'unreadable'
      when 2 then 'wrong_type:start_date' when 3 then 'missing_required:name' else 'ok' end as reason from trips)"""


def _loaded(t):
    folder = shared_folder(t.spark, "raw-trips")
    _spoiled_trips(t).write.text(folder)
    return raw.read_json_lines(t.spark, folder, "trips")


@query("raw_trips_by_reason", f"with {_KINDS} select reason, count(*) as n from trip_kinds group by reason")
def _(t):
    """Every line of a raw file is loaded or counted under the reason that it is not."""
    return raw.by_reason(_loaded(t))


@query(
    "raw_trips_loaded",
    f"""with {_KINDS} select id, username, name, cast(start_date as varchar) as start_date, cast(end_date as varchar) as end_date
    from trip_kinds where reason = 'ok'""",
)
def _(t):
    rows = _loaded(t).rows
    return rows.select("id", "username", "name", F.col("start_date").cast("string"), F.col("end_date").cast("string"))
