"""Overlaps of timed items within a trip day: conflicts, clusters, side-by-side columns."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayledger.functions import clock
from wayledger.operators.itinerary import needs_attention, trip_summary
from wayledger.operators.skew import HotKeys, Running, hot_keys, match, ranked, running, salted_lookup
from wayledger.session import HOT_ROWS, checkpointed, setting, shared_folder

DAY = ["trip_id", "day_number"]
CLUSTER = [*DAY, "cluster"]
#: Clusters up to so many rows are packed by one expression, whose cost grows with the square.
PACK_ROWS = 2_000


def timed(items: DataFrame) -> DataFrame:
    """Scheduled items with a readable time, as start and end minute.

    Items of negative length are left out: an item that ends before it begins overlaps nothing and has no column.
    ``quality.bad_duration`` finds them.
    """
    start = clock.time_to_minutes(F.col("start_time"))
    return (
        items.where(F.col("day_number").isNotNull() & start.isNotNull())
        .select(*DAY, "id", start.alias("s"), clock.overlap_minutes(F.col("duration_minutes")).alias("_d"))
        .where(F.col("_d") >= 0)
        .select(*DAY, "id", "s", (F.col("s") + F.col("_d")).alias("e"))
    )


def _facing(rows: DataFrame) -> DataFrame:
    """What surrounds each start minute of a day.

    ``rows`` carry the longest-reaching item, the first item and the lasting items of
    their minute.  Frames only grow with the sort order, in both directions, so the cost
    is one shuffle and two sorts.
    """
    ahead = Window.partitionBy(*DAY).orderBy("s")
    back = Window.partitionBy(*DAY).orderBy(F.col("s").desc())
    earlier = ahead.rangeBetween(Window.unboundedPreceding, -1)
    later = back.rangeBetween(Window.unboundedPreceding, -1)
    same = ahead.rangeBetween(0, 0)
    return rows.withColumns(
        {
            "reach": F.max("far").over(earlier),
            "next": F.min("first").over(later),
            "low": F.min("low").over(same),
            "high": F.max("high").over(same),
        }
    )


def _minute_columns(rows: DataFrame) -> DataFrame:
    lasting = F.when(F.col("e") > F.col("s"), F.col("id"))
    return rows.withColumns(
        {"far": F.struct("e", "id"), "first": F.struct("s", "id"), "low": lasting, "high": lasting}
    )


def _hot_days(items: DataFrame, limit: int | None = None) -> HotKeys:
    """Hot days by all scheduled items, which spares reading the times once more."""
    return hot_keys(items.where(F.col("day_number").isNotNull()), DAY, limit)


def _neighbours(items: DataFrame) -> DataFrame:
    """Each timed item with its surroundings.

    A hot trip day is first reduced to its start minutes, of which the time grammar allows
    at most 6,040, and the items look their minute up over salted keys.
    """
    cold, heavy = _hot_days(items).split(timed(items))
    out = _facing(_minute_columns(cold)).drop("far", "first")
    if heavy is None:
        return out
    minutes = (
        _minute_columns(heavy)
        .groupBy(*DAY, "s")
        .agg(
            F.max("far").alias("far"), F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high")
        )
    )
    facing = _facing(minutes).drop("far", "first")
    return out.unionByName(salted_lookup(heavy, facing, [*DAY, "s"], "id", "inner"))


def overlap_pairs(items: DataFrame) -> DataFrame:
    """One overlapping partner for each timed item that has any.

    The partner is the furthest-reaching earlier item, else the first lasting item of the
    same minute (for that one itself, the last), else the next item.  ``overlap_counts``
    tells how many there are in all.
    """
    lasts = F.col("e") > F.col("s")
    other = F.when(F.col("low") != F.col("id"), F.col("low")).otherwise(F.col("high"))
    partner = (
        F.when(F.col("reach.e") > F.col("s"), F.col("reach.id"))
        .when(lasts & (other != F.col("id")), other)
        .when(F.col("next.s") < F.col("e"), F.col("next.id"))
    )
    paired = _neighbours(items).withColumn("partner_id", partner)
    return paired.where(F.col("partner_id").isNotNull()).select(*DAY, "id", "partner_id")


def overlap_counts(items: DataFrame) -> DataFrame:
    """How many other items of its day each timed item overlaps.

    An item overlaps all that begin before its end, less those that end by its start; both
    numbers are running counts over the day's minutes, so no pair is ever formed.
    """
    cold, heavy = _hot_days(items).split(timed(items))
    counted = _running_marks(_marks(cold))
    opening, closing = F.col("opens") == 1, F.col("closes") == 1
    out = counted.groupBy(*DAY, "id").agg(
        F.max(F.when(opening, F.col("ended"))).alias("ended"),
        F.max(F.when(opening, F.col("points"))).alias("points"),
        F.max(F.when(closing, F.col("begun"))).alias("begun"),
        F.max("lasts").alias("lasts"),
    )
    if heavy is not None:
        sums = [F.sum(c).alias(c) for c in ("opens", "closes", "point")]
        minutes = _running_marks(_marks(heavy).groupBy(*DAY, "t").agg(*sums))
        starts = minutes.select(*DAY, F.col("t").alias("s"), "ended", "points")
        ends = minutes.select(*DAY, F.col("t").alias("e"), "begun")
        found = salted_lookup(heavy, starts, [*DAY, "s"], "id", "inner")
        found = salted_lookup(found, ends, [*DAY, "e"], "id", "inner").withColumn("lasts", F.col("e") > F.col("s"))
        out = out.unionByName(found.select(*out.columns))
    others = F.when(F.col("lasts"), F.col("begun") - F.col("ended") - 1).otherwise(
        F.col("begun") - F.col("ended") + F.col("points")
    )
    return out.select(*DAY, "id", others.alias("overlaps"))


def _marks(rows: DataFrame) -> DataFrame:
    """Two rows per item: where it begins and where it ends."""
    point = (F.col("e") <= F.col("s")).cast("int")
    opens = F.struct(F.col("s").alias("t"), F.lit(1).alias("opens"), F.lit(0).alias("closes"), point.alias("point"))
    closes = F.struct(F.col("e").alias("t"), F.lit(0).alias("opens"), F.lit(1).alias("closes"), F.lit(0).alias("point"))
    return rows.select(*DAY, "id", (F.col("e") > F.col("s")).alias("lasts"), F.inline(F.array(opens, closes)))


def _running_marks(marks: DataFrame) -> DataFrame:
    """Ends up to each minute, beginnings before it, and items without length in it."""
    order = Window.partitionBy(*DAY).orderBy("t")
    return marks.withColumns(
        {
            "ended": F.sum("closes").over(order.rangeBetween(Window.unboundedPreceding, 0)),
            "begun": F.coalesce(F.sum("opens").over(order.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "points": F.sum("point").over(order.rangeBetween(0, 0)),
        }
    )


def conflict_flags(items: DataFrame) -> DataFrame:
    """Whether each timed item overlaps any other of its day."""
    shared = (F.col("e") > F.col("s")) & (F.col("low") < F.col("high"))
    conflict = (F.col("reach.e") > F.col("s")) | (F.col("next.s") < F.col("e")) | shared
    return _neighbours(items).select(*DAY, "id", F.coalesce(conflict, F.lit(False)).alias("conflict"))


def overlap_clusters(items: DataFrame) -> DataFrame:
    """Number the groups of items that hang together in time, from 1 per day."""
    return _clusters(timed(items), _hot_days(items))


def _clusters(rows: DataFrame, hot: HotKeys) -> DataFrame:
    order = [F.col("s"), F.col("id")]
    reached = running(rows, DAY, order, {"_end": Running("max", "e", inclusive=False)}, hot)
    opens = F.when(F.col("_end").isNull() | (F.col("s") >= F.col("_end")), 1).otherwise(0)
    opened = reached.withColumn("_opens", opens.cast("long"))
    return running(opened, DAY, order, {"cluster": Running("sum", "_opens")}, hot).drop("_end", "_opens")


def timeline_columns(items: DataFrame) -> DataFrame:
    """First free column of each item among those it hangs together with.

    Small clusters are packed as one sorted array; those up to the hot-key limit item by item within their task.
    Beyond that limit clusters go minute by minute over their columns as distributed rows.
    """
    rows = timed(items)
    most = setting(items.sparkSession, HOT_ROWS)
    limit = min(PACK_ROWS, most)
    # No cluster outgrows its day, so the days are measured before anything is computed.
    if _hot_days(items, limit).frame is None:
        return _pack_arrays(_clusters(rows, HotKeys(DAY)))
    # Read several times below, so computed once.
    clusters = checkpointed(_clusters(rows, _hot_days(items)))
    small, large = hot_keys(clusters, CLUSTER, limit).split(clusters)
    out = _pack_arrays(small)
    if large is None:
        return out
    medium, huge = hot_keys(large, CLUSTER, most).split(large)
    out = out.unionByName(_pack_groups(medium))
    return out if huge is None else out.unionByName(_pack_minutes(huge))


# Per column only its furthest-reaching item can still block; a new item takes the first
# column whose item does not overlap it.
_PACK = """
aggregate(
  array_sort(collect_list(named_struct('s', s, 'id', id, 'e', e))),
  named_struct('cols', cast(array() as array<struct<s: int, e: int>>),
               'placed', cast(array() as array<struct<id: bigint, col: int>>)),
  (acc, x) -> element_at(transform(
    array(array_position(transform(acc.cols, o -> o.s < x.e and x.s < o.e), false)),
    p -> named_struct(
      'cols', if(p = 0, concat(acc.cols, array(named_struct('s', x.s, 'e', x.e))),
                 transform(acc.cols, (o, i) ->
                   if(i = p - 1 and x.e > o.e, named_struct('s', x.s, 'e', x.e), o))),
      'placed', concat(acc.placed, array(named_struct('id', x.id,
                 'col', cast(if(p = 0, size(acc.cols), p - 1) as int)))))), 1),
  acc -> named_struct('cols', size(acc.cols), 'placed', acc.placed))
"""


def _pack_arrays(rows: DataFrame) -> DataFrame:
    packed = rows.groupBy(*CLUSTER).agg(F.expr(_PACK).alias("p"))
    each = packed.select(*CLUSTER, F.col("p.cols").alias("cols"), F.explode("p.placed").alias("x"))
    return each.select(*CLUSTER, F.col("x.id").alias("id"), F.col("x.col").alias("col"), "cols")


class Columns:
    """First free columns for items in order of start: free columns wait in one heap, taken ones in another by their end."""

    def __init__(self):
        self.free: list[int] = []
        self.taken: list[tuple[int, int]] = []
        self.width, self.minute, self.opening = 0, None, 0

    def reopen(self, column: int, busy: int) -> None:
        """A column that was in use until ``busy``."""
        heapq.heappush(self.taken, (busy, column))
        self.width = max(self.width, column + 1)

    def place(self, start: int, end: int) -> int:
        while self.taken and self.taken[0][0] <= start:
            heapq.heappush(self.free, heapq.heappop(self.taken)[1])
        if start != self.minute:
            self.minute, self.opening = start, self.free[0] if self.free else self.width
        if end > start:
            at = heapq.heappop(self.free) if self.free else self.width
            heapq.heappush(self.taken, (end, at))
        else:
            # Without length it blocks nothing, and only what began earlier is in its way.
            at = self.opening
            if at == self.width:
                heapq.heappush(self.free, at)
        self.width = max(self.width, at + 1)
        return at

    def open(self) -> list[tuple[int, int]]:
        """All columns with the minute that each is in use until."""
        return [(column, busy) for busy, column in self.taken] + [(column, self.minute) for column in self.free]


def _pack_groups(rows: DataFrame) -> DataFrame:
    """Pack clusters of bounded size one by one."""

    def packed(cluster: pa.Table) -> pa.Table:
        cluster = cluster.sort_by([("s", "ascending"), ("id", "ascending")])
        columns = Columns()
        placed = [columns.place(*item) for item in zip(cluster["s"].to_pylist(), cluster["e"].to_pylist(), strict=True)]
        kept = cluster.select([*CLUSTER, "id"])
        kept = kept.append_column("col", pa.array(placed, pa.int32()))
        return kept.append_column("cols", pa.array([columns.width] * len(placed), pa.int32()))

    kinds = dict(rows.dtypes)
    fields = [f"{c} {kinds[c]}" for c in [*CLUSTER, "id"]]
    return rows.groupBy(*CLUSTER).applyInArrow(packed, ", ".join([*fields, "col int", "cols int"]))


def spans_of(minutes: list[tuple[int, int]], limit: int) -> list[list[int]]:
    """Neighbouring minutes (minute, rows) together as long as their rows stay within the limit."""
    out: list[list[int]] = []
    held = 0
    for minute, count in minutes:
        if not out or held + count > limit:
            out.append([])
            held = 0
        out[-1].append(minute)
        held += count
    return out


def _pack_minutes(rows: DataFrame) -> DataFrame:
    """Pack large clusters span of minutes by span, carrying which columns are in use.

    A span has as many minutes as the hot-key limit admits rows of one cluster.  Its rows are streamed in order behind the
    columns that are open, a task a cluster, which holds the open columns only.  A minute that alone has more rows, or
    more open columns than that, is packed over distributed rows: there the k-th lasting item takes the k-th column free
    by then, or a new one beyond the last; items without length never block and take the first free column, or a
    new one.  The list of minutes on the driver is bounded by the time grammar.
    """
    spark = rows.sparkSession
    limit = setting(spark, HOT_ROWS)
    folder = shared_folder(spark, "columns")
    last = rows.groupBy(*CLUSTER).agg(F.max("s").alias("until"))
    # Few files per minute, more where a minute holds many rows.
    spread = rows.join(last, CLUSTER).hint("rebalance", F.col("s"))
    spread.write.partitionBy("s").parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    most = rows.groupBy(*CLUSTER, "s").count().groupBy("s").agg(F.max("count").alias("most"))
    counts = sorted((r.s, r.most) for r in most.collect())
    column = [*CLUSTER, "until", "col"]
    state = rows.select(*CLUSTER, "until", F.lit(0).alias("col"), F.lit(0).alias("busy")).where(F.lit(False))
    rows_of, wide = dict(counts), 0
    for step, minutes in enumerate(spans_of(counts, limit)):
        if max(rows_of[minutes[0]], wide) <= limit:
            now = rows.where(F.col("s").between(minutes[0], minutes[-1]))
            seen = Observation()
            placed = _stream_span(now, state).observe(seen, F.max("n_open").alias("wide"))
            placed.write.parquet(f"{folder}/placed/step={step}-0")
            wide = seen.get["wide"] or 0
            # With the schema given, reading starts no job.
            state = spark.read.schema(placed.schema).parquet(f"{folder}/placed/step={step}-0").where("id is null")
            state = state.select(*column, F.col("e").alias("busy"))
            continue
        for at, minute in enumerate(minutes):
            _place(rows.where(F.col("s") == minute), state, minute).write.parquet(f"{folder}/placed/step={step}-{at}")
            placed = spark.read.parquet(f"{folder}/placed/step={step}-{at}")
            # Only clusters with items still to come keep their columns.
            taken = placed.select(*column, F.col("e").alias("busy")).unionByName(state).where(F.col("until") > minute)
            taken.groupBy(*column).agg(F.max("busy").alias("busy")).write.parquet(f"{folder}/state/step={step}-{at}")
            state = spark.read.parquet(f"{folder}/state/step={step}-{at}")
        wide = state.groupBy(*CLUSTER).count().agg(F.max("count")).first()[0] or 0
    kinds = {f.name: f.dataType for f in rows.schema} | {"col": T.IntegerType()}
    kept = T.StructType([T.StructField(c, kinds[c]) for c in [*CLUSTER, "id", "col"]])
    placed = spark.read.schema(kept).parquet(f"{folder}/placed").where("id is not null").select(*kept.names)
    widths = placed.groupBy(*CLUSTER).agg((F.max("col") + 1).alias("cols"))
    return placed.join(widths, CLUSTER).select(*CLUSTER, "id", "col", "cols")


def _stream_span(now: DataFrame, state: DataFrame) -> DataFrame:
    """The items of some minutes with their columns, and the columns open at the end of clusters that go on.

    Rows without id are open columns: what is in use until ``e``.
    """
    kinds = dict(now.dtypes)
    begun = now.select(*CLUSTER, "until", "id", "s", "e", F.lit(None).cast("int").alias("col"))
    open_ = state.select(*CLUSTER, "until", F.lit(None).cast(kinds["id"]).alias("id"), F.lit(None).cast("int").alias("s"), F.col("busy").alias("e"), "col")
    both = open_.unionByName(begun).repartition(*CLUSTER)
    # Nulls first: the open columns of a cluster come before its items.
    both = both.sortWithinPartitions(*CLUSTER, "s", "id")
    names = [*CLUSTER, "until", "id", "e", "col", "n_open"]
    fields = [f"{c} {kinds[c]}" for c in [*CLUSTER, "until", "id", "e"]]

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, until, columns, out, types = None, None, Columns(), [], None

        def close():
            if cluster is None:
                return
            # Nothing of the cluster may begin in this span; one that ends in it needs no columns any more.
            left = columns.open() if columns.minute is not None else [(column, busy) for busy, column in columns.taken]
            if columns.minute is None or columns.minute < until:
                out.extend((*cluster, until, None, busy, column, len(left)) for column, busy in left)

        for batch in batches:
            types = [batch.schema.field(c).type for c in names[:-2]]
            for row in zip(*(batch[c].to_pylist() for c in [*CLUSTER, "until", "id", "s", "e", "col"]), strict=True):
                *key, until_now, id_, start, end, column = row
                if tuple(key) != cluster:
                    close()
                    cluster, until, columns = tuple(key), until_now, Columns()
                if start is None:
                    columns.reopen(column, end)
                else:
                    out.append((*cluster, until, id_, end, columns.place(start, end), None))
            yield _span_batch(out, names, types)
            out.clear()
        close()
        if out:
            yield _span_batch(out, names, types)

    return both.mapInArrow(streamed, ", ".join([*fields, "col int", "n_open int"]))


def _span_batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    arrays = [pa.array(list(c), t) for c, t in zip(columns, [*types, pa.int32(), pa.int32()], strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def _place(now: DataFrame, state: DataFrame, minute: int) -> DataFrame:
    free = ranked(state.where(F.col("busy") <= minute), CLUSTER, [F.col("col")], "k").select(
        *CLUSTER, "k", F.col("col").alias("free_col")
    )
    sizes = state.groupBy(*CLUSTER).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("busy") <= minute).alias("f"),
        F.min(F.when(F.col("busy") <= minute, F.col("col"))).alias("first_free"),
    )
    sized = match(now, sizes, CLUSTER, "left").fillna(0, ["n", "f"])
    lasting = ranked(sized.where(F.col("e") > minute), CLUSTER, [F.col("id")], "k")
    fresh = F.col("n") + F.col("k") - F.col("f") - 1
    lasting = match(lasting, free, [*CLUSTER, "k"], "left").withColumn("at", F.coalesce("free_col", fresh))
    points = sized.where(F.col("e") <= minute).withColumn("at", F.coalesce("first_free", "n"))
    kept = [*CLUSTER, "until", "id", "e", F.col("at").cast("int").alias("col")]
    return lasting.select(*kept).unionByName(points.select(*kept))


def trip_overview(trips: DataFrame, items: DataFrame) -> DataFrame:
    """Trips with their scheduled, candidate, conflicting and unconfirmed-required counts."""
    conflicts = conflict_flags(items).groupBy("trip_id").agg(F.count_if("conflict").alias("conflicts"))
    attention = F.count_if(needs_attention()).alias("attention")
    joined = trip_summary(trips, items, attention).join(conflicts, "trip_id", "left")
    return joined.fillna(0, ["conflicts", "attention"])
