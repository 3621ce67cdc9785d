"""Ordered computations within a key that stay distributed when a key is hot.

A key group of ordinary size is handled by a plain window.  Groups with more than
``spark.wayledger.hotRows`` rows (measured, not assumed) are range-sorted across the
cluster on (key, order), so that one key spans many tasks; each stretch of a key inside
one sorted partition is scanned on its own and the totals of the earlier stretches are
added from a carry table.  Both ways give the same values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayledger.session import HOT_ROWS, PART_ROWS, checkpointed, setting

BROADCAST_KEYS = 200_000
SALTS = 64


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is ``sum`` or ``max`` over the column ``value``."""

    kind: str
    value: str
    inclusive: bool = True

    def over(self, window) -> Column:
        last = Window.currentRow if self.inclusive else -1
        frame = window.rowsBetween(Window.unboundedPreceding, last)
        return self.total().over(frame)

    def total(self) -> Column:
        return F.sum(self.value) if self.kind == "sum" else F.max(self.value)

    def joined(self, local: Column, carry: Column) -> Column:
        if self.kind == "max":
            return F.greatest(local, carry)
        return F.when(local.isNull(), carry).otherwise(local + F.coalesce(carry, F.lit(0)))


@dataclass(frozen=True)
class HotKeys:
    """Values of ``keys`` above the row limit; ``frame is None`` when there are none."""

    keys: list[str]
    frame: DataFrame | None = None
    stretches: int = 1

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The rows of ordinary keys, and those of hot ones if any."""
        if self.frame is None:
            return df, None
        return match(df, self.frame, self.keys, "left_anti"), match(df, self.frame, self.keys, "left_semi")


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys, null equal to null, keeping the left columns' names."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, on, how)
    return joined.drop(*[f"_r_{k}" for k in keys]) if how in ("inner", "left") else joined


def hot_keys(df: DataFrame, keys: list[str], limit: int | None = None) -> HotKeys:
    """Measure the keys with more than ``limit`` rows: one pass over the key columns.

    A table of no more than ``limit`` rows in all is settled by its row count, which
    columnar files know without being read.  Counting per key is combined map-side.  At most ``rows / limit`` keys can pass, and the
    result is broadcast only when its counted size allows it.  Where ``df`` is costly to
    compute, measure the table it comes from instead: more rows per key than ``df`` has
    only make a key count as hot sooner.
    """
    limit = setting(df.sparkSession, HOT_ROWS) if limit is None else limit
    if df.count() <= limit:
        return HotKeys(keys)
    above = df.groupBy(*keys).count().where(F.col("count") > limit)
    if above.isEmpty():
        return HotKeys(keys)
    above = checkpointed(above)
    found, rows = above.agg(F.count("*"), F.sum("count")).first()
    frame = above.select(*keys)
    return HotKeys(keys, F.broadcast(frame) if found <= BROADCAST_KEYS else frame, rows // limit + 1)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    specs: dict[str, Running],
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add running values within ``keys`` in a total ``order``.

    ``hot`` may be measured on some of the ``keys`` only.
    """
    hot = hot or hot_keys(df, keys)
    cold, heavy = hot.split(df)
    window = Window.partitionBy(*keys).orderBy(*order)
    out = cold.withColumns({name: spec.over(window) for name, spec in specs.items()})
    return out if heavy is None else out.unionByName(_running_sorted(heavy, keys, order, specs, hot.stretches))


def _running_sorted(heavy, keys, order, specs, stretches) -> DataFrame:
    by = [*[F.col(k) for k in keys], *order]
    # Stretches hold about the row limit each, however many rows a single key has.
    placed = checkpointed(
        heavy.repartitionByRange(stretches, *by)
        .sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_stretch", F.shiftright("_at", 33))
    stretch = ["_stretch", *keys]
    within = Window.partitionBy(*stretch).orderBy("_at")
    local = placed.withColumns({name: spec.over(within) for name, spec in specs.items()})
    # One row per stretch and key, so this window stays small.
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*stretch).agg(*[s.total().alias(f"_t_{n}") for n, s in specs.items()])
    carries = totals.select(
        *stretch,
        *[
            (F.sum if s.kind == "sum" else F.max)(f"_t_{n}").over(before).alias(f"_c_{n}")
            for n, s in specs.items()
        ],
    )
    joined = match(local, carries, stretch, "inner")
    return joined.select(
        *heavy.columns, *[s.joined(F.col(n), F.col(f"_c_{n}")).alias(n) for n, s in specs.items()]
    )


def ranked(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", hot: HotKeys | None = None
) -> DataFrame:
    """1-based position of each row in its key group; ``order`` must be total."""
    hot = hot or hot_keys(df, keys)
    cold, heavy = hot.split(df)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    out = cold.withColumn(name, number)
    if heavy is None:
        return out
    ones = heavy.withColumn("_one", F.lit(1).cast("long"))
    counted = _running_sorted(ones, keys, order, {name: Running("sum", "_one")}, hot.stretches)
    return out.unionByName(counted.drop("_one"))


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "left") -> DataFrame:
    """Join many rows per key to one row per key, each key spread over ``SALTS`` tasks."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return match(left, right.withColumn("_salt", salts), ["_salt", *keys], how).drop("_salt")


def text_parts(
    placed: DataFrame, keys: list[str], position: str, text: str, extras: dict[str, Column] | None = None
) -> DataFrame:
    """Concatenate ``text`` per key, by 1-based ``position``, into parts of bounded length.

    An ordinary group gives one part, 0.  A longer one gives several; the document is
    their concatenation in ``part`` order, so no task ever holds more than one part.
    ``extras`` are aggregates computed per part.
    """
    return with_part(placed, position).groupBy(*keys, "part").agg(
        F.expr(f"listagg({text}, '') within group (order by {position})").alias("body"),
        *[value.alias(name) for name, value in (extras or {}).items()],
    )


def with_part(placed: DataFrame, position: str) -> DataFrame:
    size = setting(placed.sparkSession, PART_ROWS)
    return placed.withColumn("part", F.expr(f"cast(({position} - 1) div {size} as int)"))


def document_parts(
    placed: DataFrame,
    keys: list[str],
    position: str,
    text: str,
    hot: HotKeys,
    sums: dict[str, Column] | None = None,
    extras: dict[str, Column] | None = None,
) -> DataFrame:
    """``text_parts`` with ``_last`` and, over the whole document, the ``sums``.

    With hot keys these come from one row per key, made from the rows and looked up over spread parts, so the texts of
    a long document stay where they are; else from a window over parts that already lie by key.
    """
    sums, extras = sums or {}, extras or {}
    if hot.frame is None:
        every = Window.partitionBy(*keys)
        whole = {name: F.sum(name).over(every) for name in sums}
        parts = text_parts(placed, keys, position, text, sums | extras)
        return parts.withColumns({"_last": F.col("part") == F.max("part").over(every), **whole})
    size = setting(placed.sparkSession, PART_ROWS)
    totals = placed.groupBy(*keys).agg(F.max(position).alias("_rows"), *[v.alias(n) for n, v in sums.items()])
    joined = salted_lookup(text_parts(placed, keys, position, text, extras), totals, keys, "part", "inner")
    return joined.withColumn("_last", F.col("part") == F.expr(f"cast((_rows - 1) div {size} as int)")).drop("_rows")


def spread_under(spine: DataFrame, rows: DataFrame, keys: list[str], spread: str, hot: HotKeys) -> DataFrame:
    """Left join of one row per key to many rows per key.

    An outer join cannot split its right side, so the hot keys of ``rows`` are matched by
    an inner join salted by ``spread``; only their spine rows are repeated per salt.  Those
    that turn out to have no rows are added after it.
    """
    calm, heavy = hot.split(rows)
    if heavy is None:
        return spine.join(rows, keys, "left")
    calm_spine, heavy_spine = hot.split(spine)
    calm_join = calm_spine.join(calm, keys, "left")
    alone = match(heavy_spine, heavy.select(*keys).distinct(), keys, "left_anti")
    matched = salted_lookup(heavy, heavy_spine, keys, spread, "inner")
    return calm_join.unionByName(matched).unionByName(alone, allowMissingColumns=True)
