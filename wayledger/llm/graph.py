"""Connected components and lookups by keys of which some may hold a large part of all rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.session import checkpointed

#: A key with more than this part of the rows is looked up in a broadcast table, so there are at most as many.
HOT_PARTS = 1_000


def hot_values(counts: DataFrame, key: str, rows: int) -> list[Any]:
    """Values of ``key`` whose ``n`` is over 1 in HOT_PARTS of the rows: never more than HOT_PARTS of them."""
    least = max(rows // HOT_PARTS, HOT_PARTS)
    return [row[0] for row in counts.where((F.col("n") > least) & F.col(key).isNotNull()).select(key).collect()]


def lookup(rows: DataFrame, key: str, mapping: DataFrame, hot: list[Any] | None = None) -> DataFrame:
    """Left join of ``rows`` to ``mapping``, which has one row per value of its column ``key``.

    Rows of the ``hot`` values (measured if not given; then ``rows`` should be cheap to read again) stay where they
    are and meet a broadcast part of the mapping with at most HOT_PARTS rows.
    """
    if hot is None:
        hot = hot_values(rows.groupBy(key).agg(F.count("*").alias("n")), key, rows.count())
    if not hot:
        return rows.join(mapping, key, "left")
    is_hot = F.col(key).isin(hot)
    calm = rows.where(~is_hot | F.col(key).isNull()).join(mapping.where(~is_hot), key, "left")
    return calm.unionByName(rows.where(is_hot).join(F.broadcast(mapping.where(is_hot)), key, "left"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); nodes of one component share a root.

    Each round maps every node to the least of itself and its neighbours and contracts the links by that; a node that
    isn't least among its neighbours goes, so the nodes at least halve.  The maps of the rounds are then applied one
    after another.
    """
    steps, edges = [], checkpointed(links.where("a <> b").select("a", "b").distinct())
    while (size := edges.count()) > 0:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n"))
        step = checkpointed(nearest.select(F.col("a").alias("node"), F.least("a", "least").alias("to"), "n"))
        hot = hot_values(step, "node", size)
        for end in ("a", "b"):
            edges = lookup(edges, end, step.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}")), hot)
        edges = edges.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = checkpointed(edges.where("a <> b").distinct())
        steps.append(step)
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).where(F.lit(False))
    roots = steps[0].select("node", F.col("to").alias("root"))
    for step in steps[1:]:
        found = lookup(roots, "root", step.select(F.col("node").alias("root"), "to"))
        roots = checkpointed(found.select("node", F.coalesce("to", "root").alias("root")))
    return roots
