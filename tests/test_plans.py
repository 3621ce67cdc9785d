"""Physical plans over stored domain tables: pushed filters, read columns, shuffles."""

import datetime
import re

import pytest

from wayledger.operators import exports, itinerary, shopping, timeline
from wayledger.sources.fixtures import Tables
from wayledger.sources.tables import fill_defaults, read_table, write_snapshot


@pytest.fixture(scope="module")
def stored(spark, folder, tmp_path_factory):
    """The domain tables as Parquet snapshots, read back with their schemas."""
    tables, root = Tables(spark, folder), tmp_path_factory.mktemp("stored")
    kept = {}
    for view, table, key in (
        ("trips", "trips", "id"),
        ("items", "itinerary_items", "trip_id"),
        ("buylist_items", "buylist_items", "list_id"),
    ):
        write_snapshot(fill_defaults(getattr(tables, view), table), str(root / table), key)
        kept[view] = read_table(spark, str(root / table), table)
    return kept


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    """Plans as they are when no side is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"\bExchange\b", plan(df)))


def pushed(df):
    return re.findall(r"PushedFilters: \[(.*?)\]", plan(df))[0]


def read(df):
    return set(re.findall(r"(\w+):", re.findall(r"ReadSchema: struct<(.*?)>(?:\s|$)", plan(df))[0]))


def test_filters_reach_the_scan(stored):
    items, buylist = stored["items"], stored["buylist_items"]
    assert "IsNotNull(day_number)" in pushed(itinerary.items_scheduled(items))
    assert "IsNull(day_number)" in pushed(itinerary.items_candidates(items))
    assert "EqualTo(confirm_required,true)" in pushed(itinerary.items_unconfirmed_required(items))
    assert "EqualTo(this_month,true)" in pushed(shopping.buylist_this_month(buylist))
    assert "EqualTo(bought,true)" in pushed(shopping.repurchase_candidates(buylist))
    assert "EqualTo(trip_id,5)" in pushed(itinerary.items_by_day(items, trip_id=5))


def test_only_needed_columns_are_read(stored):
    items, trips = stored["items"], stored["trips"]
    assert read(timeline.conflict_flags(items)) == {"id", "trip_id", "day_number", "start_time", "duration_minutes"}
    assert read(itinerary.day_plan_counts(items)) == {"trip_id", "day_number"}
    assert read(itinerary.today_day(trips, datetime.date(2000, 1, 1))) == {"id", "start_date", "end_date"}


def test_shuffles(stored):
    items, trips, buylist = stored["items"], stored["trips"], stored["buylist_items"]
    assert shuffles(itinerary.checklist_order(items)) == 1
    assert shuffles(timeline.conflict_flags(items)) == 1
    assert shuffles(timeline.overlap_counts(items)) == 1
    assert shuffles(timeline.overlap_clusters(items)) == 1
    assert shuffles(timeline.timeline_columns(items)) == 1
    assert shuffles(itinerary.checklist_sections(items)) == 0
    assert shuffles(itinerary.trip_summary(trips, items)) == 2
    assert shuffles(shopping.price_urgency_matrix(buylist)) == 1
    assert shuffles(exports.maps_csv_documents(items)) == 1
    assert shuffles(exports.ics_documents(trips, items, datetime.datetime(2026, 1, 1))) == 2


def test_schedule_items_derives_the_items_once(spark, folder):
    """The window over the line items runs for the stored items only."""
    from wayledger.plans import load_all
    from wayledger.plans.registry import QUERIES

    load_all()
    plan = QUERIES["schedule_items"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "Window" in plan
