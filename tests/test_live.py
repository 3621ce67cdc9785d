"""The stream gives the batch result, over several micro-batches, replays and folds."""

import pytest
from pyspark.sql import functions as F

from wayledger.operators.shopping import budget_status, category_rollup
from wayledger.schemas import schema
from wayledger.sources.fixtures import RAW, VIEWS, Tables
from wayledger.streaming import feed, totals


@pytest.fixture
def source(spark, folder, tmp_path):
    """The events in six files, one per micro-batch."""
    events = Tables(spark, folder).events
    events.repartitionByRange(6, "event_id").write.parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def stream(spark, source):
    raw = spark.readStream.schema(RAW["events"]).option("maxFilesPerTrigger", 1).parquet(source)
    raw.createOrReplaceTempView("events")
    return feed.change_feed(spark.sql(VIEWS["change_feed"][1]))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_stream_equals_batch(spark, folder, source, tmp_path):
    tables = Tables(spark, folder)
    batch = feed.change_feed(tables.change_feed)
    lists = feed.LiveLists(spark, str(tmp_path / "live"), fold_every=4)
    lists.start(stream(spark, source), tables.buylist_budget).awaitTermination()
    kept = ["event_id", *schema("buylist_items").names]
    want = rows(feed.present(batch), *kept)
    assert rows(lists.current_items(), *kept) == want
    assert lists.epoch() == 1

    # A repeated micro-batch changes nothing, whether its epoch is folded or not.
    for epoch, number in ((0, 3), (1, 5)):
        again = spark.read.parquet(f"{lists.folder}/changes/epoch={epoch}/batch={number}").select(*batch.columns)
        copied = spark.createDataFrame(again.collect(), again.schema)
        lists.take(copied, number, tables.buylist_budget)
        assert rows(lists.current_items(), *kept) == want

    touched = batch.select("list_id").distinct()
    items = feed.present(batch)
    status = budget_status(tables.buylist_budget.join(touched, "list_id", "left_semi"), items)
    assert rows(lists.live_budget(), "list_id", "status", "total", "remaining") == rows(
        status, "list_id", "status", "total", "remaining"
    )
    shown = ("list_id", "category", "items", "unbought_sum", "place")
    assert rows(lists.live_rollup(), *shown) == rows(category_rollup(items), *shown)


def test_snapshot_then_stream(spark, folder, source, tmp_path):
    """Rows from before the first event stay until a change names them."""
    tables = Tables(spark, folder)
    lists = feed.LiveLists(spark, str(tmp_path / "live"), fold_every=2, buckets=5)
    # An item keeps its list, so ids of the fixture's two sources must not meet.
    snapshot = tables.buylist_items.withColumn("id", F.when(F.col("id") % 2 == 0, F.col("id") + 10**9).otherwise(-F.col("id")))
    lists.seed(snapshot, tables.buylist_budget)
    before = {r.list_id: r.status for r in lists.live_budget().collect()}
    assert before.keys() == {r.list_id for r in tables.buylist_items.select("list_id").distinct().collect()}
    lists.start(stream(spark, source), tables.buylist_budget).awaitTermination()
    history = feed.as_changes(snapshot).unionByName(feed.change_feed(tables.change_feed))
    columns = schema("buylist_items").names
    assert rows(lists.current_items(), *columns) == rows(feed.present(history), *columns)
    items = feed.present(history)
    want = rows(category_rollup(items), "list_id", "category", "items", "place")
    assert rows(lists.live_rollup(), "list_id", "category", "items", "place") == want


def test_redelivered_events_are_dropped(spark, folder, source, tmp_path):
    # The files come in any order, so the delay spans the whole month they cover.
    twice = feed.deduped_changes(stream(spark, source).unionByName(stream(spark, source)), "40 days")
    sink = twice.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
    sink.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    seen = spark.read.parquet(str(tmp_path / "out"))
    assert seen.count() == seen.select(F.countDistinct("event_id")).first()[0] == Tables(spark, folder).events.count()


STATUS = ("list_id", "status", "total", "remaining", "recurring")
SHOWN = ("list_id", "category", "items", "unbought", "unbought_sum", "place", "all_bought")


def check_totals(live, tables, history):
    """Budgets and categories equal those of the whole current table."""
    items = feed.present(history)
    named = history.select("list_id").distinct()
    status = budget_status(tables.buylist_budget.join(named, "list_id", "left_semi"), items)
    found = {r[0]: r for r in rows(live.live_budget(tables.buylist_budget), *STATUS)}
    want = {r[0]: r for r in rows(status, *STATUS)}
    # A list that only outdated versions named never counts for anything.
    held = {r.list_id for r in items.select("list_id").distinct().collect()}
    assert held <= found.keys()
    assert {k: v for k, v in want.items() if k in found} == {k: v for k, v in found.items() if k in want}
    assert all(v[1:] == ("none", 0, None, 0) for k, v in found.items() if k not in want)
    assert rows(live.live_rollup(), *SHOWN) == rows(category_rollup(items), *SHOWN)


def moved_feed(changes):
    """Items that change their list and category, go and come back; events in any order, some told twice."""
    other = F.when(F.col("event_id") % 7 == 0, F.col("list_id") % 3).otherwise(F.col("list_id"))
    changed = changes.withColumns({"list_id": other, "id": F.col("id") % 40})
    return changed.unionByName(changed.where("event_id % 5 = 0"))


@pytest.mark.parametrize("fold_every", [2, 100])
def test_totals_equal_the_batch(spark, folder, source, tmp_path, fold_every):
    tables = Tables(spark, folder)
    live = totals.LiveTotals(spark, str(tmp_path / "live"), fold_every)
    live.start(moved_feed(stream(spark, source))).awaitTermination()
    assert live.epoch() == 6 // fold_every
    history = moved_feed(feed.change_feed(tables.change_feed))
    check_totals(live, tables, history)

    # A batch that was written but not committed runs again after a restart, and moves nothing twice.
    last = max((tmp_path / "live/checkpoints/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink()
    live.start(moved_feed(stream(spark, source))).awaitTermination()
    check_totals(live, tables, history)


def test_totals_from_a_snapshot(spark, folder, source, tmp_path):
    tables = Tables(spark, folder)
    snapshot = tables.buylist_items.withColumn("id", F.col("id") % 400).dropDuplicates(["id"])
    live = totals.LiveTotals(spark, str(tmp_path / "live"), 4)
    live.start(moved_feed(stream(spark, source)), snapshot).awaitTermination()
    check_totals(live, tables, feed.as_changes(snapshot).unionByName(moved_feed(feed.change_feed(tables.change_feed))))


def test_a_batch_moves_only_its_own_states(spark, folder, source, tmp_path):
    """The states that a batch reads and writes are those of its items, not of their lists."""
    changes = stream(spark, source)
    live = totals.LiveTotals(spark, str(tmp_path / "live"))
    query = live.start(changes)
    query.awaitTermination()
    for progress in query.recentProgress:
        operators = progress["stateOperators"]
        items = next(o for o in operators if o["numRowsUpdated"] <= progress["numInputRows"])
        assert len(operators) == 2 and items["numRowsUpdated"] <= progress["numInputRows"]
    written = spark.read.parquet(f"{live.folder}/totals/epoch=0")
    batches = written.groupBy("batch").count().collect()
    assert len(batches) >= 5 and all(r["count"] <= query.recentProgress[0]["numInputRows"] * 2 for r in batches)


def test_items_and_sums_share_pages(spark, folder, source, tmp_path):
    """A batch pays a round trip to the state store for each page, not for each item; the totals are the same."""
    tables = Tables(spark, folder)
    snapshot = tables.buylist_items.withColumn("id", F.col("id") % 400).dropDuplicates(["id"])
    live = totals.LiveTotals(spark, str(tmp_path / "live"), pages=3)
    query = live.start(moved_feed(stream(spark, source)), snapshot)
    query.awaitTermination()
    updated = [o["numRowsUpdated"] for progress in query.recentProgress for o in progress["stateOperators"]]
    assert updated and max(updated) <= 3 * 2  # the first batch writes a page once from the snapshot, once from its changes
    check_totals(live, tables, feed.as_changes(snapshot).unionByName(moved_feed(feed.change_feed(tables.change_feed))))
