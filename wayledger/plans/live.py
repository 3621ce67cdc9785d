"""Queries on the change stream: each runs the stream over its source and reads the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayledger.operators.shopping import CATEGORIES
from wayledger.plans.registry import query
from wayledger.plans.shopping import BUDGET_SQL, budget_columns, rollup_sql
from wayledger.schemas import SCHEMAS
from wayledger.session import shared_folder
from wayledger.sources.fixtures import RAW, VIEWS
from wayledger.streaming import feed, totals


def _stream(t):
    """The change feed view over the events as a stream."""
    raw = feed.read_changes(t.spark, t.folder, RAW["events"], "events.parquet")
    raw.createOrReplaceTempView("events")
    return feed.change_feed(t.spark.sql(VIEWS["change_feed"][1]))


def _written(t, stream, purpose: str):
    folder = shared_folder(t.spark, purpose)
    sink = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    sink.trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return t.spark.read.parquet(f"{folder}/rows")


# Read from the declaration itself, as its schema needs a running session.
COLUMNS = [field.split()[0] for field in SCHEMAS["buylist_items"].split(", ")]
MONEY = ("price", "recurring_cost", "actual_price")


def _shown(df):
    """All columns of the table and what the change carries besides, in types that compare alike."""
    stamps = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("ts", "created_at")]
    money = [F.col(c).cast("double") for c in MONEY]
    rest = [c for c in COLUMNS if c not in (*MONEY, "created_at")]
    return df.select("event_id", "op", *stamps, *money, *rest)


_SHOWN = ", ".join(
    ["event_id", "op"]
    + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {c}" for c in ("ts", "created_at")]
    + [f"cast({c} as double) as {c}" for c in MONEY]
    + [c for c in COLUMNS if c not in (*MONEY, "created_at")]
)
_FEED = f"select {_SHOWN} from change_feed"


@query("change_feed", _FEED)
def _(t):
    return _shown(_written(t, _stream(t), "change-feed"))


@query("deduped_changes", _FEED)
def _(t):
    twice = _stream(t).unionByName(_stream(t))
    return _shown(_written(t, feed.deduped_changes(twice, "1 day"), "deduped-changes"))


_PRESENT = """last as (select *, row_number() over (partition by id order by ts desc, event_id desc) as newest
      from change_feed),
    live_items as (select * from last where newest = 1 and op <> 'delete')"""


def _run(t, budget=None, snapshot=None):
    lists = feed.LiveLists(t.spark, shared_folder(t.spark, "live-lists"))
    if snapshot is not None:
        lists.seed(snapshot, budget)
    lists.start(_stream(t), budget).awaitTermination()
    return lists


@query("current_items", f"with {_PRESENT} select {_SHOWN} from live_items")
def _(t):
    return _shown(_run(t).current_items())


@query(
    "current_items_from_snapshot",
    f"""with {_PRESENT} select id, list_id, name, cast(price as double) as price, bought, quantity from live_items
    union all
    select id, list_id, name, cast(price as double), bought, quantity from buylist_items
    where id not in (select id from change_feed)""",
)
def _(t):
    """The table as it was, brought up to date by the stream."""
    current = _run(t, snapshot=t.buylist_items).current_items()
    return current.select("id", "list_id", "name", F.col("price").cast("double"), "bought", "quantity")


def _totals(t, snapshot=None):
    live = totals.LiveTotals(t.spark, shared_folder(t.spark, "live-totals"))
    live.start(_stream(t), snapshot).awaitTermination()
    return live


_LIVE_BUDGET = BUDGET_SQL.format(items="live_items").replace("with sums", "sums", 1)
_TOUCHED_BUDGET = f"""with {_PRESENT}, touched as (select distinct list_id from change_feed),
    whole as (with {_LIVE_BUDGET})
    select * from whole where list_id in (select list_id from touched)"""
_LIVE_ROLLUP = f"with {_PRESENT}, {rollup_sql('live_items', CATEGORIES)}"


def _money(groups):
    return groups.withColumn("unbought_sum", F.col("unbought_sum").cast("double"))


@query("live_budget", _TOUCHED_BUDGET)
def _(t):
    """From keyed totals: a batch reads the states of its own items and categories."""
    return budget_columns(_totals(t).live_budget(t.buylist_budget))


@query("live_rollup", _LIVE_ROLLUP)
def _(t):
    """Categories of every list that the stream touched; the fixture's lists show all their items."""
    return _money(_totals(t).live_rollup())


_EVERY = """(select list_id, price, recurring_cost, this_month, bought from live_items union all
    select list_id, price, recurring_cost, this_month, bought from buylist_items
    where id not in (select id from change_feed))"""


@query(
    "live_budget_from_snapshot",
    f"""with {_PRESENT}, named as (select list_id from change_feed union select list_id from buylist_items),
    whole as (with {BUDGET_SQL.format(items=_EVERY).replace("with sums", "sums", 1)})
    select * from whole where list_id in (select list_id from named)""",
)
def _(t):
    """Budgets of all lists: the states begin with the table as it was."""
    return budget_columns(_totals(t, t.buylist_items).live_budget(t.buylist_budget))


@query("live_budget_from_log", _TOUCHED_BUDGET)
def _(t):
    """The same from the change log: the touched lists are reduced again after each batch."""
    return budget_columns(_run(t, t.buylist_budget).live_budget())


@query("live_rollup_from_log", _LIVE_ROLLUP)
def _(t):
    return _money(_run(t, t.buylist_budget).live_rollup())
