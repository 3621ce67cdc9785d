"""Repair of the structure of conversations at least cost by an auction for shortest paths.

The rows of a conversation, in order of turn (nulls first, then role initial and a hash), are the layers of a lattice whose
nodes are the role of the last output row: none, system, user or assistant.  Arcs are the edits of a row: Keep 0, Rerole
to user or assistant 1, Delete 2, Insert of an empty user or assistant row 5; a truncated row that stays adds 5, blank and
duplicate rows can only go.  Output roles must spell ``(s?(ua)+)?`` by their initials; a role is of the kind of its first
letter.

Every node has a price, at first a lower bound of what is left to pay.  An auction extends a path from the entry over an
arc without slack and contracts it, raising the last node's price to its cheapest arc, where there is none.  When the path
reaches the end the entry's price is the least cost, and every node of a cheapest path has its exact price.  Among arcs
without slack the path takes the edit that comes first in ASCII, and a state and an edit fix the next state, so the
path is the least of all cheapest ones.

Long conversations are cut into blocks of BLOCK rows, each with its own auction: the prices at a block's start are the
costs at the end of the one before.  Rows are range-sorted over the cluster, so a conversation spreads over tasks: each
task gives the least costs between the border nodes of its first and last conversation, these are chained to prices at the
borders, and a second pass to the states there.  Rows travel without their texts; a text meets its edit at the end.

Null ids are an id like others; null roles and texts count as one space; repeated rows are duplicates.  No rows give no
conversations.  The digest of a conversation is one sequential hash, so its texts are streamed through one task in
constant memory; all else of a conversation of any length spreads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.llm.batches import bound_batches
from wayledger.llm.graph import hot_values, lookup
from wayledger.operators.skew import match
from wayledger.session import checkpointed

START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may follow each state; a system row may only be the first.
NEXT = (USER, USER, ASSISTANT, USER)
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
FAR = 1 << 60
#: Layers of one auction, whose steps may grow with the square of them.
BLOCK = 64
TASK_ROWS, LEAST_TASK_ROWS = 100_000, 5_000
#: Copies of one row that travel together.
COPIES = 1_000
WHITE = " \t\n\x0b\x0c\r"

Arc = tuple[str, int, int, int]


def _arcs(kind: int, fault: int, state: int) -> tuple[Arc, ...]:
    """Edits of a row in ASCII order: letter, layers forward, state after, cost."""
    follows = NEXT[state]
    out = [("D", 1, state, DELETE_COST), ("I", 0, follows, INSERT_COST)]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        if kind == follows or (kind == SYSTEM and state == START):
            out.append(("K", 1, kind, extra))
        if kind != follows:
            out.append(("R", 1, follows, REROLE_COST + extra))
    return tuple(out)


#: By the row's kind (0 for other roles), its fault and the state before.
ARCS = tuple(tuple(tuple(_arcs(k, f, s) for s in range(4)) for f in range(4)) for k in range(4))
#: The least that a row costs, whatever the state.
LEAST = tuple(tuple(min(a[3] for s in range(4) for a in ARCS[k][f][s] if a[1]) for f in range(4)) for k in range(4))

Row = tuple[int, int]
#: What is left to pay at the end of a conversation.
FINAL = (0, FAR, FAR, 0)


class Block:
    """The lattice of some rows with its prices; ``ends`` are the costs from each state after the last row."""

    def __init__(self, rows: list[Row], ends: tuple[int, ...], last: bool):
        self.rows, self.ends, self.last = rows, ends, last
        left = min(ends)
        prices = [[left] * 4 if last else list(ends)]
        for kind, fault in reversed(rows):
            left += LEAST[kind][fault]
            prices.append([left] * 4)
        prices.reverse()
        if not last:
            # From user and assistant there is no way back to system or start, nor from system to start.
            for state in (USER, ASSISTANT, SYSTEM):
                if all(end >= FAR for end in ends[min(state, USER):]):
                    for layer in prices:
                        layer[state] = FAR
            if ends[START] >= FAR and ends[USER] >= FAR and ends[ASSISTANT] >= FAR:
                at = len(rows)
                while at and not (rows[at - 1][0] == SYSTEM and rows[at - 1][1] in (SOUND, TRUNCATED)):
                    at -= 1
                for layer in prices[at:]:
                    layer[START] = FAR
        self.prices = prices

    def auction(self, entry: int) -> tuple[str, int] | None:
        """The edits of the least cheapest path from a state before the first row, and the state it ends in."""
        rows, prices, count = self.rows, self.prices, len(self.rows)
        layers, states, letters = [0], [entry], []
        while True:
            layer, state = layers[-1], states[-1]
            best, choice = FAR, None
            if layer < count:
                kind, fault = rows[layer]
                for arc in ARCS[kind][fault][state]:
                    value = arc[3] + prices[layer + arc[1]][arc[2]]
                    if value < best:
                        best, choice = value, arc
            else:
                best = self.ends[state]
                if self.last and INSERT_COST + prices[layer][NEXT[state]] < best:
                    best, choice = INSERT_COST + prices[layer][NEXT[state]], ("I", 0, NEXT[state], INSERT_COST)
            if prices[layer][state] < best or best >= FAR:
                prices[layer][state] = best
                if len(layers) > 1:
                    layers.pop(), states.pop(), letters.pop()
                elif best >= FAR:
                    return None
            elif choice is None:
                return "".join(letters), state
            else:
                letters.append(choice[0])
                layers.append(layer + choice[1])
                states.append(choice[2])


def blocks_to(rows: list[Row], ends: tuple[int, ...], last: bool, entry: int | None = None) -> list[Block]:
    """The settled blocks of a stretch of rows in order; the first from ``entry`` only, if that is known."""
    out: list[Block] = []
    for low in reversed(range(0, max(len(rows), 1), BLOCK)):
        block = Block(rows[low : low + BLOCK], ends, last and not out)
        for state in range(4) if low or entry is None else (entry,):
            block.auction(state)
        ends = tuple(block.prices[0])
        out.append(block)
    return out[::-1]


def least_edits(rows: list[Row], ends: tuple[int, ...] = FINAL, last: bool = True, entry: int = START) -> tuple[str, int]:
    """The edits of a stretch that begins in a state, least of the cheapest, and the state that it ends in."""
    letters, state = [], entry
    for block in blocks_to(rows, ends, last, entry):
        part, state = block.auction(state)
        letters.append(part)
    return "".join(letters), state


def cost_of(rows: list[Row], edits: str) -> int:
    cost, at = 0, 0
    for edit in edits:
        if edit == "I":
            cost += INSERT_COST
            continue
        cost += DELETE_COST if edit == "D" else REROLE_COST * (edit == "R") + TRUNCATED_COST * (rows[at][1] == TRUNCATED)
        at += 1
    return cost


def between_borders(rows: list[Row]) -> list[int]:
    """Least costs from each state before a stretch to each state after it, when the conversation goes on."""
    table = [[FAR] * 4 for _ in range(4)]
    for to in range(4):
        settled = blocks_to(rows, tuple(0 if s == to else FAR for s in range(4)), False)
        for state in range(4):
            table[state][to] = min(settled[0].prices[0][state], FAR)
    return [cost for line in table for cost in line]


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by the crc32 of ``conv_id:turn`` modulo 20; nulls of keys, roles and texts are one space."""
    space = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("fate", F.pmod(F.crc32(named.cast("binary")), F.lit(20))).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))})
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("time", times).drop("fate", "time")


def _named(rows: DataFrame) -> DataFrame:
    """Rows with ``name``, the same for equal role and text of one conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    whole = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("name", F.md5(whole.cast("binary")))


def sorted_rows(rows: DataFrame) -> DataFrame:
    """The rows without texts, range-sorted by conversation and turn; ``copies`` equal rows are one."""
    named = _named(rows)
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    named = named.select(
        "conv_id", "turn", "name", F.substring("role", 1, 1).alias("letter"), (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    grouped = named.groupBy("conv_id", "turn", "name", "letter", "blank", "cut").agg(F.count("*").alias("copies"))
    kind = F.instr(F.lit("sua"), F.col("letter")) * (F.col("letter") != "").cast("int")
    grouped = checkpointed(grouped.select("conv_id", "turn", "name", kind.alias("kind"), "blank", "cut", "copies"))
    size = grouped.count()
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    often = grouped.groupBy("name").agg(F.count("*").alias("n"), F.min(when).alias("first")).where("n > 1")
    often = checkpointed(often)
    found = lookup(grouped, "name", often.select("name", "first"), hot_values(often, "name", size))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNotNull() & (F.col("first") != when), DUPLICATE)
    found = found.withColumn("fault", fault.when(F.col("cut"), TRUNCATED).otherwise(SOUND))
    # The copies of one row travel in parts of bounded size.
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))).alias("part")
    found = found.select("conv_id", "turn", "name", "kind", "fault", "copies", parts)
    found = found.withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("part") * COPIES).cast("int"))
    later = F.when(F.col("part") > 0, F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)).otherwise(F.col("fault"))
    found = found.withColumn("fault", later)
    keys = ["conv_id", "turn", "kind", "name", "part"]
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(size // TASK_ROWS, min(wide, size // LEAST_TASK_ROWS), 1)
    return checkpointed(found.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).select("conv_id", "kind", "fault", "copies", "name"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Row], list[str]]]:
    """The conversations of one task: id, kinds with faults, and names, one after another."""
    conversation, rows, names = None, [], []
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("conv_id", "kind", "fault", "copies", "name"))
        for c, kind, fault, copies, name in zip(*columns, strict=True):
            if rows and c != conversation:
                yield conversation, rows, names
                rows, names = [], []
            conversation = c
            rows.append((kind, fault))
            names.append(name)
            if copies > 1:
                rows += [(kind, BLANK if fault == BLANK else DUPLICATE)] * (copies - 1)
                names += [name] * (copies - 1)
    if rows:
        yield conversation, rows, names


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_BORDER = pa.schema([("task", pa.int64()), ("conv_id", pa.int64()), ("costs", pa.list_(pa.int64())), ("first_kind", pa.int32()), ("last_kind", pa.int32())])
_EXIT = pa.schema([("task", pa.int64()), ("conv_id", pa.int64()), ("exits", pa.list_(pa.int32()))])
_STRETCH = pa.schema(
    [("conv_id", pa.int64()), ("stretch", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64())]
    + [("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("edits", pa.string())]
    + [("roles", pa.list_(pa.int32())), ("names", pa.list_(pa.string()))]
)
_STRETCH_DDL = (
    "conv_id long, stretch long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "edits string, roles array<int>, names array<string>"
)


@dataclass(frozen=True)
class Border:
    """What a stretch in the middle of a conversation knows of the others."""

    ends: tuple[int, ...]
    last: bool
    before: int | None
    entry: int = START


def _borders(rows: DataFrame) -> dict[tuple[int, int | None], Border]:
    """By task and conversation, for the conversations that lie in several tasks: two rows a task at most."""

    def bordering(batches):
        task, first, last = TaskContext.get().partitionId(), None, None
        for conversation, found, _ in _runs(batches):
            last = (conversation, found)
            first = last if first is None else first
        ends = [x for x in (first, last if last is not first else None) if x is not None]
        yield _batch([(task, c, between_borders(r), r[0][0], r[-1][0]) for c, r in ends], _BORDER)

    found = rows.mapInArrow(bordering, "task long, conv_id long, costs array<long>, first_kind int, last_kind int").collect()
    parts: dict[int | None, list] = {}
    for row in sorted(found, key=lambda r: r["task"]):
        parts.setdefault(row["conv_id"], []).append(row)
    borders: dict[tuple[int, int | None], Border] = {}
    for conversation, stretches in parts.items():
        ends, last = FINAL, True
        for at in range(len(stretches) - 1, -1, -1) if len(stretches) > 1 else ():
            row = stretches[at]
            borders[row["task"], conversation] = Border(ends, last, stretches[at - 1]["last_kind"] if at else None)
            if last:
                # At the end empty rows may follow, so costs end in what closes each state.
                ends = (0, 2 * INSERT_COST, INSERT_COST, 0)
            ends = tuple(min(row["costs"][4 * s + t] + ends[t] for t in range(4)) for s in range(4))
            last = False
    if not borders:
        return borders
    shared = rows.sparkSession.sparkContext.broadcast(borders)

    def leaving(batches):
        task, out = TaskContext.get().partitionId(), []
        for conversation, found, _ in _runs(batches):
            border = shared.value.get((task, conversation))
            if border is not None:
                exits = [least_edits(found, border.ends, border.last, s)[1] for s in range(4)] if not border.last else [0] * 4
                out.append((task, conversation, exits))
        yield _batch(out, _EXIT)

    entries: dict[int | None, int] = {}
    for row in sorted(rows.mapInArrow(leaving, "task long, conv_id long, exits array<int>").collect(), key=lambda r: r["task"]):
        key = row["task"], row["conv_id"]
        entry = entries.get(row["conv_id"], START)
        borders[key] = Border(borders[key].ends, borders[key].last, borders[key].before, entry)
        entries[row["conv_id"]] = row["exits"][entry]
    return borders


def stretches(rows: DataFrame) -> DataFrame:
    """For each conversation, in one or several stretches: faults, cost, edits, and the rows that its repair consists of.

    ``audit`` has the letters of all edits; ``edits`` those without D, with the output role (0 as it was) and the name
    of the row behind each.
    """
    ordered = sorted_rows(rows)
    shared = rows.sparkSession.sparkContext.broadcast(_borders(ordered))

    def repaired(batches):
        task, out, held = TaskContext.get().partitionId(), [], 0
        for conversation, found, names in _runs(batches):
            border = shared.value.get((task, conversation)) or Border(FINAL, True, None)
            audit, _ = least_edits(found, border.ends, border.last, border.entry)
            kinds = [kind for kind, _ in found] if border.before is None else [border.before, *(kind for kind, _ in found)]
            legal = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
            illegal = sum(pair not in legal for pair in zip(kinds, kinds[1:]))
            faults = [fault for _, fault in found]
            state, at, roles, kept = border.entry, 0, [], []
            for edit in audit:
                if edit == "D":
                    at += 1
                    continue
                state = found[at][0] if edit == "K" else NEXT[state]
                roles.append(0 if edit == "K" else state)
                kept.append(names[at] if edit != "I" else None)
                at += edit != "I"
            counts = [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
            out.append((conversation, task, *counts, illegal, cost_of(found, audit), audit, audit.replace("D", ""), roles, kept))
            held += len(found)
            if held >= 20_000:
                yield _batch(out, _STRETCH)
                out, held = [], 0
        yield _batch(out, _STRETCH)

    return checkpointed(ordered.mapInArrow(repaired, _STRETCH_DDL))


def repaired_rows(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of the repaired conversations with their edit: in order of ``stretch`` and ``at``."""
    pieces = found.select("conv_id", "stretch", "edits", F.posexplode(F.arrays_zip("roles", "names")).alias("at", "piece"))
    pieces = pieces.select("conv_id", "stretch", "at", F.expr("substring(edits, at + 1, 1)").alias("edit"), "piece.roles", "piece.names")
    kept = pieces.where("names is not null")
    texts = _named(rows).groupBy("name").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    own = kept.join(texts, kept["names"] == texts["name"])
    role = F.when(F.col("roles") == USER, "user").when(F.col("roles") == ASSISTANT, "assistant")
    own = own.select("conv_id", "stretch", "at", "edit", F.coalesce(role, "role").alias("role"), "text")
    new = pieces.where("names is null").select("conv_id", "stretch", "at", "edit", role.alias("role"), F.lit("").alias("text"))
    return own.unionByName(new)


def digests(repaired: DataFrame) -> DataFrame:
    """sha256 of each conversation's ``role:text`` lines, streamed in order."""
    bound_batches(repaired.sparkSession)
    order = ["conv_id", "stretch", "at"]
    lines = repaired.select(*order, F.concat("role", F.lit(":"), "text").alias("line"))
    tasks = int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.repartition(tasks, "conv_id").sortWithinPartitions(*order)

    def hashed(batches):
        conversation, running, out = None, None, []
        for batch in batches:
            for c, line in zip(batch["conv_id"].to_pylist(), batch["line"], strict=True):
                if running is not None and c == conversation:
                    running.update(b"\n")
                else:
                    if running is not None:
                        out.append((conversation, running.hexdigest()))
                    conversation, running = c, hashlib.sha256()
                running.update(line.as_buffer())
            yield _batch(out, schema)
            out = []
        yield _batch([(conversation, running.hexdigest())] if running is not None else [], schema)

    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    return lines.mapInArrow(hashed, "conv_id long, repaired_sha256 string")


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations``: the faults of its ``rows``, the repair's cost, edits and digest."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = stretches(rows)
    numbers = ["blank", "duplicate", "truncated", "illegal", "cost"]
    parts = F.array_sort(F.collect_list(F.struct("stretch", "audit")))
    whole = found.groupBy("conv_id").agg(*[F.sum(n).alias(n) for n in numbers], parts.alias("parts"))
    whole = whole.select("conv_id", *numbers, F.array_join(F.transform("parts", lambda p: p.audit), "").alias("audit"))
    gap = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.coalesce(gap, F.lit(0)).cast("long").alias("gaps"))
    out = ids
    for part in (gaps, whole, digests(repaired_rows(found, rows))):
        out = match(out, part, ["conv_id"], "left")
    filled = {n: F.coalesce(n, F.lit(0)) for n in ("gaps", *numbers)} | {"audit": F.coalesce("audit", F.lit(""))}
    nothing = F.lit(hashlib.sha256().hexdigest())
    out = out.withColumns(filled | {"repaired_sha256": F.coalesce("repaired_sha256", nothing)})
    return out.select("conv_id", "gaps", *numbers, "audit", "repaired_sha256")
