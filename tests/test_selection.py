"""Order statistics and ranks against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from wayledger.operators import itinerary, selection, shopping
from wayledger.session import HOT_ROWS


@pytest.mark.parametrize("parts", [5, 16_384])
def test_nth_values(spark, monkeypatch, parts):
    monkeypatch.setattr(selection, "PARTS", parts)
    monkeypatch.setattr(selection, "LOWEST", -2_000)
    monkeypatch.setattr(selection, "HIGHEST", 2_000)
    draw = random.Random(2)
    lists = {1: [draw.randint(-2_000, 2_000) for _ in range(301)], 2: [7] * 200, 3: [-2_000, 2_000], 4: [0], None: list(range(50))}
    rows = [(key, i, value) for key, values in lists.items() for i, value in enumerate(values)]
    frame = spark.createDataFrame(rows, "list_id long, id long, v long")
    found = selection.nth_values(frame, "list_id", F.col("v"), F.expr("n div 2 + 1"), "id").collect()
    assert {r.list_id: (r.value, r.n) for r in found} == {k: (sorted(v)[len(v) // 2], len(v)) for k, v in lists.items()}
    none = selection.nth_values(frame.where("false"), "list_id", F.col("v"), F.lit(1), "id")
    assert none.count() == 0


def test_a_hot_list_of_one_price_spreads(spark):
    """Cells of hot lists equal the literal rule; rows are never joined on their price."""
    draw = random.Random(5)
    rows = [(i, 1, 9.5, "need") for i in range(400)] + [(1000 + i, 2, draw.randint(0, 30) / 4, draw.choice(["want", "maybe"])) for i in range(151)]
    rows += [(2000 + i, 3, 0.0, "need") for i in range(30)] + [(3000, 4, None, "need"), (3001, 4, 3.0, None)]
    frame = spark.createDataFrame(rows, "id long, list_id long, price double, urgency string")
    frame = frame.withColumns({"price": F.col("price").cast("decimal(12,2)"), "this_month": F.lit(True), "bought": F.lit(False)})
    spark.conf.set(HOT_ROWS, "20")
    try:
        result = shopping.price_urgency_matrix(frame)
        cells = {r.id: r.cell for r in result.collect()}
        plan = result._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(HOT_ROWS)
    prices = {}
    for _, key, price, _ in rows:
        prices.setdefault(key, []).append(price or 0)
    for id_, key, price, urgency in rows:
        median = sorted(prices[key])[len(prices[key]) // 2]
        high = "hi" if (price or 0) >= median and median > 0 else "lo"
        assert cells[id_] == f"{high}-{'need' if urgency in ('need', 'want') else 'low'}"
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("_price" in line for line in joins)


def test_rank_of_the_whole_list(spark):
    draw = random.Random(3)
    rows = [(i, f"trip {i}", draw.choice([None, "2025-01-01", "2025-03-04", "2024-12-31"])) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, name string, d string")
    trips = frame.select("id", "name", F.col("d").cast("date").alias("start_date"), F.col("d").cast("date").alias("end_date"))
    result = itinerary.trips_list(trips)
    order = sorted(rows, key=lambda r: r[0])
    order = sorted(order, key=lambda r: r[2] or "9999", reverse=True)
    assert {r.id: r["rank"] for r in result.collect()} == {r[0]: n for n, r in enumerate(order, 1)}
    assert "Window" not in result._jdf.queryExecution().executedPlan().toString()
    assert itinerary.trips_list(trips.where("false")).count() == 0
