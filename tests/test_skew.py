"""Running values, lookups and document parts under one hot key."""

import random

import pytest
from pyspark.sql import functions as F

from wayledger.operators import exports
from wayledger.operators.skew import HotKeys, Running, hot_keys, ranked, running, spread_under
from wayledger.session import HOT_ROWS, PART_ROWS


@pytest.fixture
def hot(spark):
    spark.conf.set(HOT_ROWS, "40")
    yield
    spark.conf.unset(HOT_ROWS)


@pytest.fixture
def rows(spark):
    """A third of all rows under one key, another third under the null key."""
    chance = random.Random(7)
    keys = [1] * 200 + [None] * 200 + [k for k in range(2, 42) for _ in range(5)]
    data = [(k, i, chance.choice([None, *range(20)]), chance.randrange(100)) for i, k in enumerate(keys)]
    return spark.createDataFrame(data, "k long, id long, o int, v long")


def brute(data):
    out = {}
    groups = {}
    for r in data:
        groups.setdefault(r.k, []).append(r)
    for group in groups.values():
        group.sort(key=lambda r: (r.o is None, r.o, r.id) if r.o is not None else (True, 0, r.id))
        total, top = 0, None
        for position, r in enumerate(group, 1):
            before = top
            total += r.v
            top = r.v if top is None else max(top, r.v)
            out[r.id] = (position, total, before)
    return out


def test_running_values_match_brute_force(hot, rows):
    order = [F.col("o").asc_nulls_last(), F.col("id").asc()]
    specs = {"total": Running("sum", "v"), "before": Running("max", "v", inclusive=False)}
    placed = ranked(running(rows, ["k"], order, specs), ["k"], order)
    got = {r.id: (r["rank"], r.total, r.before) for r in placed.collect()}
    assert got == brute(rows.collect())


def test_hot_keys_are_measured(hot, rows):
    found = hot_keys(rows, ["k"])
    assert sorted((r.k or 0) for r in found.frame.collect()) == [0, 1]
    assert found.stretches == 11
    assert hot_keys(rows, ["k"], 500).frame is None


def test_one_hot_key_spans_several_stretches(hot, rows):
    from wayledger.operators.skew import _running_sorted

    heavy = rows.where("k = 1").withColumn("_one", F.lit(1))
    placed = _running_sorted(heavy, ["k"], [F.col("id")], {"n": Running("sum", "_one")}, 5)
    assert [r.n for r in placed.orderBy("id").collect()] == list(range(1, 201))
    assert heavy.repartitionByRange(5, "k", "id").select(F.spark_partition_id()).distinct().count() == 5


def test_no_hot_key_means_a_plain_window(spark, rows):
    assert hot_keys(rows, ["k"]) == HotKeys(["k"])


def test_spread_under_keeps_lonely_spine_rows(hot, spark, rows):
    spine = spark.createDataFrame([(k, f"s{k}") for k in (1, 2, 99)], "k long, label string")
    known = rows.where("k is not null").select("k", "id")
    joined = spread_under(spine, known, ["k"], "id", hot_keys(known, ["k"]))
    counts = {r.label: r.n for r in joined.groupBy("label").agg(F.count("id").alias("n")).collect()}
    assert counts == {"s1": 200, "s2": 5, "s99": 0}


@pytest.mark.parametrize("key", ["ics_documents", "maps_csv_documents", "buylist_markdown", "share_json"])
def test_long_documents_continue_in_parts(spark, folder, key):
    import __spark_entry__ as entry

    def texts(df):
        keys = [c for c in df.columns if c not in ("part", "document")]
        return {
            tuple(r[k] for k in keys): (r.n, r.text)
            for r in df.groupBy(*keys)
            .agg(F.count("*").alias("n"), F.expr("listagg(document, '') within group (order by part)").alias("text"))
            .collect()
        }

    whole = texts(entry.queries()[key](spark, folder))
    spark.conf.set(PART_ROWS, "2")
    try:
        parts = texts(entry.queries()[key](spark, folder))
    finally:
        spark.conf.unset(PART_ROWS)
    assert {k: t for k, (_, t) in parts.items()} == {k: t for k, (_, t) in whole.items()}
    assert max(n for n, _ in whole.values()) == 1 and max(n for n, _ in parts.values()) > 1


def test_written_map_rows_are_whole(spark, folder, tmp_path):
    from wayledger.sources.fixtures import Tables

    items = Tables(spark, folder).items
    exports.write_maps_csv(items, str(tmp_path / "maps"), folders=4)
    back = spark.read.csv(str(tmp_path / "maps"), header=True, quote='"', escape='"', multiLine=True)
    assert back.count() == exports.maps_csv_rows(items).count()


def test_a_hot_trip_is_split_in_the_join(spark):
    """Matching a third of all rows to their one trip is spread by the skew split."""
    import datetime

    from wayledger.operators import itinerary

    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        # The small test has few partitions and bytes, so what counts as skewed is lowered.
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    }
    day = datetime.date(2026, 1, 1)
    trips = spark.range(1, 4001).select("id", F.lit(day).alias("start_date"), F.date_add(F.lit(day), 3).alias("end_date"))
    trip = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 4000 + 1)
    items = spark.range(60_000).select("id", trip.alias("trip_id"), F.lit(1).alias("day_number"))
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        dated = itinerary.item_dates(trips, items)
        dated.write.format("noop").mode("overwrite").save()
        rows = dated.collect()
        plan = dated._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in options:
            spark.conf.unset(key)
    assert len(rows) == 60_000
    assert "skew=true" in plan
