"""Totals of shopping lists that move by what each change adds and takes away.

Two keyed states carry the totals from batch to batch.  The first keeps the last version of every item, by event time and
then event id, and turns a change into moves: what the old version counted for goes, what the new one counts for
comes.  The second keeps the sums of a list's category and moves them.  Items and sums lie in pages by a hash of their key, one
state a page, as each state that is read or written costs a round trip to the state store.  A micro-batch reads and
writes the pages of its own items and categories only, whatever the lists hold; ``pages`` says how many there are.  Older
changes that arrive late or again move nothing.

A category outside the fixed order is placed by its first item, so its sums also keep its items' places.  The sums of one
category are spread over SALTS states by item, over PLACE_SALTS if it keeps places, so a hot list spreads as well.

Each batch writes the new sums of the categories that it moved to a folder of its own; a replayed batch rewrites it.
Batches are kept in epochs and folded like those of the change log.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wayledger.functions.money import or_zero
from wayledger.operators.shopping import CATEGORIES, active, budget_rows, category, default_order, flag, placed_categories
from wayledger.streaming.feed import TABLE, Epochs, as_changes

SALTS = 8
PLACE_SALTS = 4_096
PAGES = 16_384
_SUMS = ("n", "unbought", "unbought_cents", "total_cents", "recurring_cents")
_PLACE = ("o_bought", "o_idle", "o_urgency", "o_age", "o_id")
_PLACE_DDL = "o_bought INT, o_idle INT, o_urgency INT, o_age LONG, o_id LONG"
_GROUP = "list_id LONG, category STRING, salt INT"
_SUMS_DDL = ", ".join(f"{c} LONG" for c in _SUMS)
#: What an item counts for; ``placed`` says whether its place is kept.
_MOVE = f"{_GROUP}, {_SUMS_DDL}, {_PLACE_DDL}, placed BOOLEAN"
_TOTAL = f"{_GROUP}, {_SUMS_DDL}, {_PLACE_DDL}"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def versions(changes: DataFrame) -> DataFrame:
    """What each change makes its item count for: all sums are 0 and ``n`` is 0 for a deleted one."""
    live = F.col("op") != "delete"
    unbought = ~flag("bought")
    cents = lambda c, when: F.when(live & when, or_zero(F.col(c)) * 100).otherwise(0).cast("long")
    place = dict(zip(_PLACE, default_order(), strict=True))
    # A missing time sorts before all others, as it does in a sort.
    place["o_age"] = F.coalesce(place["o_age"], F.lit(-(1 << 63)))
    other = ~category().isin(CATEGORIES)
    return changes.select(
        "id",
        F.unix_micros("ts").alias("at"),
        "event_id",
        "list_id",
        category().alias("category"),
        F.pmod(F.xxhash64("id"), F.when(other, PLACE_SALTS).otherwise(SALTS)).cast("int").alias("salt"),
        live.cast("long").alias("n"),
        (live & unbought).cast("long").alias("unbought"),
        cents("price", unbought).alias("unbought_cents"),
        cents("price", active()).alias("total_cents"),
        cents("recurring_cost", active()).alias("recurring_cents"),
        *[value.alias(name) for name, value in place.items()],
        (live & other).alias("placed"),
    )


def paged(rows: DataFrame, keys: list[str], pages: int) -> DataFrame:
    return rows.withColumn("page", F.pmod(F.xxhash64(*keys), F.lit(pages)).cast("int"))


def _names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


def _rank(values: tuple) -> tuple:
    """Orders values that may be missing, these first."""
    return tuple((v is not None, v) for v in values)


class Paged(StatefulProcessor):
    """One state a page, a JSON array of objects; the initial state has it ready as ``entries``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("entries", "entries STRING")

    def _load(self) -> list[dict]:
        kept = self.state.get()
        return [] if kept is None else json.loads(kept[0])

    def _keep(self, entries: list[dict]) -> None:
        self.state.update((json.dumps(entries, ensure_ascii=False, separators=(",", ":")),))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.state.update((initialState["entries"],))

    def close(self) -> None:
        pass


class ItemMoves(Paged):
    """Keyed by page of items: the last version of each, and the moves from the one before to it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.names = _names(_MOVE)

    def _signed(self, version: dict, sign: int) -> Row:
        return Row(**{c: sign * version[c] if c in _SUMS else version[c] for c in self.names})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest: dict = {}
        for row in rows:
            at = _rank((row["at"], row["event_id"]))
            if row["id"] not in newest or at > newest[row["id"]][0]:
                newest[row["id"]] = at, row
        held = {version["id"]: version for version in self._load()}
        moved = False
        for id_, (at, row) in newest.items():
            old = held.get(id_)
            if old is not None and at <= _rank((old["at"], old["event_id"])):
                continue
            new = row.asDict()
            del new["page"]
            held[id_] = new
            moved = True
            if old is not None:
                yield self._signed(old, -1)
            yield self._signed(new, 1)
        if moved:
            self._keep(list(held.values()))


class GroupTotals(Paged):
    """Keyed by page of lists, categories and salts: the sums, and the places of the items of a category that needs one."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        group = lambda entry: tuple(entry[c] for c in ("list_id", "category", "salt"))
        held = {group(entry): entry for entry in self._load()}
        changed: dict[tuple, dict[tuple, int]] = {}
        for row in rows:
            of = group(row)
            places = changed.setdefault(of, {})
            entry = held.setdefault(of, dict(zip(("list_id", "category", "salt"), of, strict=True)) | dict.fromkeys(_SUMS, 0) | {"places": []})
            for name in _SUMS:
                entry[name] += row[name]
            if row["placed"]:
                place = tuple(row[c] for c in _PLACE)
                places[place] = places.get(place, 0) + row["n"]
        out = []
        for of, places in changed.items():
            entry = held[of]
            kept = {tuple(place) for place in entry["places"]}
            kept |= {place for place, change in places.items() if change > 0}
            kept -= {place for place, change in places.items() if change < 0}
            entry["places"] = list(kept)
            first = min(kept, key=_rank, default=(None,) * len(_PLACE))
            out.append(Row(**dict(zip(_names(_TOTAL), (*of, *[entry[c] for c in _SUMS], *first), strict=True))))
        self._keep(list(held.values()))
        yield from out


class LiveTotals(Epochs):
    """Budgets and categories of the lists of one deployment, current after every micro-batch."""

    def __init__(self, spark: SparkSession, folder: str, fold_every: int = 100, table: str = TABLE, pages: int = PAGES):
        """``pages`` stays as it was at the start."""
        super().__init__(spark, folder, fold_every)
        self.table = table
        self.pages = pages

    def _seed(self, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pages that rows from before the first event begin with; their sums are written as batch -1."""
        items = versions(as_changes(snapshot, self.table))
        place = F.when(F.col("placed"), F.struct(*_PLACE))
        places = F.collect_set(F.when(F.col("placed"), F.array(*[F.col(c).cast("long") for c in _PLACE]))).alias("places")
        sums = items.groupBy(*_names(_GROUP)).agg(*[F.sum(c).alias(c) for c in _SUMS], F.min(place).alias("first"))
        self._keep("totals", sums.select(*_names(_GROUP), *_SUMS, "first.*"), 0, -1)
        groups = items.groupBy(*_names(_GROUP)).agg(*[F.sum(c).alias(c) for c in _SUMS], places)

        def entries(rows: DataFrame, keys: list[str]) -> DataFrame:
            every = F.to_json(F.collect_list(F.struct(*rows.columns)), {"ignoreNullFields": "false"})
            return paged(rows, keys, self.pages).groupBy("page").agg(every.alias("entries"))

        return entries(items, ["id"]), entries(groups, _names(_GROUP))

    def start(self, changes: DataFrame, snapshot: DataFrame | None = None) -> StreamingQuery:
        """Process what the source holds now, then stop; run again to go on.

        ``snapshot`` is the table from before the first event; it is read when the first batch runs.
        """
        items = groups = None
        if snapshot is not None:
            items, groups = self._seed(snapshot)
            items, groups = items.groupBy("page"), groups.groupBy("page")
        moves = paged(versions(changes), ["id"], self.pages).groupBy("page").transformWithState(ItemMoves(), _MOVE, "Append", "None", items)
        moves = paged(moves, _names(_GROUP), self.pages).groupBy("page")
        totals = moves.transformWithState(GroupTotals(), _TOTAL, "Append", "None", groups)
        before = self.spark.conf.get(_PROVIDER)
        # Keyed states of several variables are kept by this store only; a query keeps the one that it began with.
        self.spark.conf.set(_PROVIDER, _ROCKS)
        try:
            sink = totals.writeStream.outputMode("append").foreachBatch(self.take)
            return sink.option("checkpointLocation", f"{self.folder}/checkpoints").trigger(availableNow=True).start()
        finally:
            self.spark.conf.set(_PROVIDER, before)

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """Write the new totals of one micro-batch; safe to repeat after a failure."""
        epoch = batch_id // self.fold_every
        if epoch < self.epoch():
            # Repeated after its epoch was folded: the states have to be moved all the same.
            batch.write.format("noop").mode("overwrite").save()
            return
        self._keep("totals", batch, epoch, batch_id)
        if (batch_id + 1) % self.fold_every == 0:
            self._keep("totals", self._last(), epoch + 1, batch_id)
            self._mark(epoch)

    def _last(self) -> DataFrame:
        """The newest sums of every list, category and salt."""
        written = T.StructType.fromDDL(_TOTAL).add("batch", T.LongType())
        rows = self.spark.read.schema(written).parquet(self._path("totals", self.epoch()))
        fields = [c for c in rows.columns if c not in (*_names(_GROUP), "batch")]
        newest = F.max_by(F.struct(*fields), "batch").alias("_newest")
        return rows.groupBy(*_names(_GROUP)).agg(newest).select(*_names(_GROUP), "_newest.*")

    def live_budget(self, budget: DataFrame) -> DataFrame:
        """Budget status of every list that a change or the snapshot named; a list without items has its empty state."""
        money = lambda c: (F.sum(c).cast("decimal(20,0)") / 100).cast("decimal(20,2)")
        totals = self._last().groupBy("list_id").agg(money("total_cents").alias("total"), money("recurring_cents").alias("recurring"))
        return budget_rows(budget.join(totals.select("list_id"), "list_id", "left_semi"), totals)

    def live_rollup(self) -> DataFrame:
        """Categories of every list with items, at their places."""
        groups = self._last().groupBy("list_id", "category").agg(
            F.sum("n").alias("items"),
            F.sum("unbought").alias("unbought"),
            (F.sum("unbought_cents").cast("decimal(20,0)") / 100).cast("decimal(20,2)").alias("unbought_sum"),
            F.min(F.when(F.col("o_id").isNotNull(), F.struct(*_PLACE))).alias("_first"),
        )
        return placed_categories(groups.where("items > 0"))
