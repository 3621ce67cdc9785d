"""Every registered query gives what its SQL gives, on whole tables."""

import os
import subprocess
import sys

import pytest
from checking import connect, spark_rows, sql_rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wayledger.plans.registry import ORACLES, QUERIES
from wayledger.session import HOT_ROWS

entry.queries()


# One query per way the hot-key path is used.
HOT = [
    "items_by_day",
    "checklist_order",
    "day_plan",
    "overlap_pairs",
    "overlap_counts",
    "conflict_flags",
    "overlap_clusters",
    "buylist_sort_default",
    "category_rollup",
    "price_urgency_matrix",
    "reorder_plan",
    "append_sort_order",
    "ics_documents",
    "buylist_markdown",
    "share_json",
]


@pytest.fixture(scope="module")
def db(folder):
    return connect(folder)


def test_every_query_is_checked():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, db, folder, key):
    result = QUERIES[key](spark, folder)
    assert spark_rows(result) == sql_rows(db, ORACLES[key])
    plan = result._jdf.queryExecution().executedPlan().toString()
    for bad in ("NestedLoop", "CartesianProduct", "Python"):
        assert bad not in plan


@pytest.mark.parametrize("key", HOT)
def test_query_with_every_key_hot(spark, db, folder, key):
    spark.conf.set(HOT_ROWS, "3")
    try:
        assert spark_rows(QUERIES[key](spark, folder)) == sql_rows(db, ORACLES[key])
    finally:
        spark.conf.unset(HOT_ROWS)


@pytest.mark.parametrize("key", ["trip_summary", "conflict_flags", "budget_status", "ics_documents", "suggested_items"])
def test_comparison_notices_a_fault(spark, db, folder, key):
    """A changed value, a lost row and a doubled row of the query's result must each be seen."""
    names, want = sql_rows(db, ORACLES[key])
    df = QUERIES[key](spark, folder)
    assert spark_rows(df) == (names, want)
    column = df.columns[-1]
    faults = {
        "changed": df.withColumn(column, F.lit(None).cast(df.schema[column].dataType)),
        "lost": df.limit(len(want) - 1),
        "doubled": df.unionByName(df.limit(1)),
        "renamed": df.withColumnRenamed(column, "other"),
    }
    for fault, broken in faults.items():
        assert spark_rows(broken) != (names, want), fault


def test_registering_needs_no_session():
    """The queries are listed before any session runs."""
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


def test_entry(spark):
    overview = entry.entry(spark)
    assert overview.count() == 1500
    assert "conflicts" in overview.columns
