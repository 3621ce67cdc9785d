"""With every key hot, the text of a document never meets in one task."""

import datetime
import re

import pytest

from wayledger.operators import exports
from wayledger.session import HOT_ROWS
from wayledger.sources.fixtures import Tables


@pytest.mark.parametrize("kind", ["ics", "maps", "markdown", "share"])
def test_no_exchange_by_document_above_its_text(spark, folder, kind):
    tables = Tables(spark, folder)
    spark.conf.set(HOT_ROWS, "3")
    try:
        made = {
            "ics": lambda: exports.ics_documents(tables.trips, tables.items, datetime.datetime(2026, 1, 1)),
            "maps": lambda: exports.maps_csv_documents(tables.items),
            "markdown": lambda: exports.buylist_markdown(tables.buylist_items),
            "share": lambda: exports.share_json(tables.buylist_items, tables.share_requests),
        }[kind]()
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(HOT_ROWS)
    depth = lambda line: len(re.match(r"[\s:+\-|*()0-9]*", line).group())
    above: list[tuple[int, str]] = []
    seen = 0
    for line in plan.splitlines():
        above = [(d, x) for d, x in above if d < depth(line)]
        if "listagg" in line:
            seen += 1
            for _, node in reversed(above):
                if "LeftAnti" in node:
                    break  # what goes on from here are the rows without hot keys
                assert not re.search(r"Exchange hashpartitioning\((trip_id|list_id)#\d+L?(, tag#\d+)?, \d+\)", node)
                assert "Window" not in node
        above.append((depth(line), line))
    assert seen
