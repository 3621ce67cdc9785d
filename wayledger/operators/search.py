"""Many searches of a shopping table at once, by posting lists of short pieces of text.

An item's search texts are its name, note, tag and category, lower-cased.  The index has one posting (gram, item) for each
distinct run of up to GRAM characters in any of them, and one under the empty gram.  A search takes the runs of
GRAM characters of its text, or the whole text where that is shorter, intersects the shortest of their lists, and
verifies what is left by ``contains`` on the item.  So it finds what a scan finds, and reads no other items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayledger.functions.text import js_trim
from wayledger.operators.skew import salted_lookup

GRAM = 3
#: Posting lists that are intersected for one search, the shortest ones.
LISTS = 3
FIELDS = ("name", "note", "tag", "category")


def search_texts() -> list[Column]:
    return [F.lower(F.coalesce(c, F.lit(""))) for c in FIELDS]


def _runs(text: Column, size: int) -> Column:
    """All runs of ``size`` characters of a text, none if it is shorter."""
    last = F.length(text) - size + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substring(text, at, size))


def build_index(items: DataFrame) -> DataFrame:
    """(gram, id): every short run of an item's search texts, each once."""
    runs = [_runs(text, size) for text in search_texts() for size in range(1, GRAM + 1)]
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *runs))
    return items.select(F.explode(grams).alias("gram"), "id")


def write_index(index: DataFrame, path: str) -> None:
    """Write the postings clustered by gram, so that readers skip the files of other grams; a common gram spans several."""
    clustered = index.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")
    clustered.write.mode("errorifexists").parquet(path)


def gram_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("gram").agg(F.count("*").alias("postings"))


def _sought(searches: DataFrame) -> DataFrame:
    """(search_id, sought, gram): the distinct runs that an item must hold; a blank search asks for the empty one."""
    sought = F.lower(js_trim(F.coalesce(F.col("text"), F.lit(""))))
    rows = searches.select("search_id", sought.alias("sought")).distinct()
    grams = F.when(F.length("sought") < GRAM, F.array("sought")).otherwise(F.array_distinct(_runs(F.col("sought"), GRAM)))
    return rows.select("search_id", "sought", F.explode(grams).alias("gram"))


def search(items: DataFrame, index: DataFrame, searches: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(search_id, item columns): the items that each text of ``searches`` (search_id, text) is found in.

    ``sizes`` are the index's ``gram_sizes``, if they are kept.  A search with a run that no item holds ends there.
    """
    sizes = gram_sizes(index) if sizes is None else sizes
    sized = _sought(searches).join(sizes, "gram", "left").fillna(0, ["postings"])
    # A search has as many rows as its text has runs.
    rank = F.row_number().over(Window.partitionBy("search_id", "sought").orderBy("postings", "gram"))
    shortest = sized.withColumn("_place", rank).where(F.col("_place") <= LISTS)
    asked = F.count("*").over(Window.partitionBy("search_id", "sought")).alias("asked")
    shortest = shortest.select("search_id", "sought", "gram", asked)
    hits = salted_lookup(index, shortest, ["gram"], "id", "inner")
    held = hits.groupBy("search_id", "sought", "id", "asked").agg(F.count("*").alias("held")).where("held = asked")
    found = held.select("search_id", "sought", "id").join(items, "id")
    exact = F.greatest(*[text.contains(F.col("sought")) for text in search_texts()], F.lit(False))
    return found.where(exact).select("search_id", *items.columns)
