"""Repair of the roles of conversations at least cost, and rendering of the repaired turns.

A legal conversation is empty, or an optional system turn, then user and assistant turns by turns that end with the
assistant.  A turn may be kept, relabelled, or merged into the turn before it, and empty turns may be inserted before it
or at the end; the automaton's states are the role of the last turn.  Costs: keep 0, merge 1 (and a relabelling if the
role differs), insert 2, relabel 3 (1 for roles that are unknown or null).  Of equal costs the path that comes from the
earlier state in the order start, system, user, assistant is taken, and to reach a state keeping or relabelling comes
before merging.

The turns of all conversations are sorted over the cluster by conversation, turn (nulls first), role and text, so a
conversation of any length lies in one or more neighbouring tasks.  Each task gives the least costs from every state to
every state of the first and the last conversation it holds a part of; put together in order, these fix the states
between tasks, and a second pass over the same rows makes the paths.  Repeated rows are turns like others.  Null texts
count as empty.  A null conversation id is an id like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayledger.session import checkpointed

ROLES = ("system", "user", "assistant")
#: Other names of roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, INSERT, RELABEL, RELABEL_UNKNOWN = 1, 2, 3, 1
#: The states from which a turn of each role may follow.
FOLLOWS = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
UNKNOWN = 0
FAR = 1 << 50
TASK_ROWS = 20_000


def _insertions(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns after which ``role`` may follow ``state``."""
    reached: dict[int, tuple[int, ...]] = {state: ()}
    todo = [state]
    for at in todo:
        if at in FOLLOWS[role]:
            return reached[at]
        for extra in (SYSTEM, USER, ASSISTANT):
            if at in FOLLOWS[extra] and extra not in reached:
                reached[extra] = (*reached[at], extra)
                todo.append(extra)
    return None


def _step(state: int, role: int, to: int) -> tuple[int, str, tuple[int, ...]] | None:
    """The cheapest way for a turn of ``role`` from one state to another: cost, action, inserted roles."""
    change = 0 if role == to else RELABEL if role else RELABEL_UNKNOWN
    ways = []
    before = _insertions(state, to)
    if before is not None:
        ways.append((change + INSERT * len(before), "keep" if role == to else "relabel", before))
    if state == to:
        ways.append((MERGE + change, "merge", ()))
    return min(ways, key=lambda w: w[0]) if ways else None


#: By role of the turn, state before and state after.
STEPS = [[[_step(s, r, t) if t != START else None for t in range(4)] for s in range(4)] for r in range(4)]
COSTS = np.array([[[w[0] if w else FAR for w in row] for row in table] for table in STEPS])
#: Empty turns at the end.
ENDINGS = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else UNKNOWN


def walk(roles: list[int], entry: int) -> tuple[np.ndarray, np.ndarray]:
    """Least costs to each state after the turns, and for each turn and state the state before it."""
    costs = np.full(4, FAR)
    costs[entry] = 0
    came = np.empty((len(roles), 4), np.int8)
    for i, role in enumerate(roles):
        sums = costs[:, None] + COSTS[role]
        came[i] = sums.argmin(0)
        costs = np.minimum(sums.min(0), FAR)
    return costs, came


def trace(roles: list[int], came: np.ndarray, last: int) -> list[tuple[str, tuple[int, ...], int]]:
    """Action, roles inserted before and state after, for each turn of the path that ends in ``last``."""
    out = []
    for i in range(len(roles) - 1, -1, -1):
        before = int(came[i][last])
        _, action, inserted = STEPS[roles[i]][before][last]
        out.append((action, inserted, last))
        last = before
    return out[::-1]


def summary(roles: list[int]) -> list[list[int]]:
    """For each entry state and exit state: cost, turns begun and pieces written by that path."""
    out = []
    for entry in range(4):
        costs, came = walk(roles, entry)
        for last in range(4):
            turns = pieces = 0
            if costs[last] < FAR:
                for action, inserted, _ in trace(roles, came, last):
                    turns += len(inserted) + (action != "merge")
                    pieces += len(inserted) + 1
            out.append([int(costs[last]), turns, pieces])
    return out


def sorted_turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # The last column tells repeated rows apart, so that any number of them spreads; they are alike in all else.
    rows = rows.withColumns({"text_hash": F.xxhash64("text"), "copy": F.monotonically_increasing_id()})
    keys = ["conv_id", "turn", "role", "text_hash", "copy"]
    most = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(conversations.count() // TASK_ROWS, most))
    return checkpointed(rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).select("conv_id", "role", "text"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[str | None], list[str]]]:
    """The conversations of one task with their roles and texts, one after another."""
    conversation, roles, texts = None, [], []
    for batch in batches:
        for c, role, text in zip(*(batch[n].to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if roles and c != conversation:
                yield conversation, roles, texts
                roles, texts = [], []
            conversation = c
            roles.append(role)
            texts.append(text)
    if roles:
        yield conversation, roles, texts


def _chained(rows: pa.Table) -> pa.Table:
    """States and counts at the borders of one conversation's parts, in order."""
    parts = sorted(rows.to_pylist(), key=lambda r: r["task"])
    table = [np.array(r["sums"]).reshape(4, 4, 3) for r in parts]
    costs = [np.array([0, FAR, FAR, FAR])]
    came = []
    for sums in table:
        total = costs[-1][:, None] + sums[:, :, 0]
        came.append(total.argmin(0))
        costs.append(np.minimum(total.min(0), FAR))
    ends = costs[-1] + [INSERT * len(ENDINGS[s]) for s in range(4)]
    states = [int(ends.argmin())]
    for back in reversed(came):
        states.append(int(back[states[-1]]))
    states = states[::-1]
    out, turns, pieces = [], 0, 0
    for i, (row, sums) in enumerate(zip(parts, table, strict=True)):
        entry, last = states[i], states[i + 1]
        out.append((row["task"], row["conv_id"], entry, last, turns, pieces, i == len(parts) - 1))
        turns, pieces = turns + int(sums[entry][last][1]), pieces + int(sums[entry][last][2])
    names = ["task", "conv_id", "entry", "last", "turns", "pieces", "is_end"]
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), _BORDER_TYPES, strict=True)], names)


_BORDER = "task long, conv_id long, entry long, last long, turns long, pieces long, is_end boolean"
_BORDER_TYPES = [pa.int64()] * 6 + [pa.bool_()]
_PIECES = "conv_id long, out_turn long, piece long, role string, action string, rendered string"


def repair(conversations: DataFrame) -> DataFrame:
    """The pieces of the repaired conversations; in order of ``piece`` their ``rendered`` texts are the whole.

    ``conversations`` has conv_id, turn, role and text.  A piece is an input turn or an inserted empty one; pieces of
    one ``out_turn`` were merged.
    """
    rows = sorted_turns(conversations)

    def bordering(batches):
        task, first, last = TaskContext.get().partitionId(), None, None
        for conversation, roles, _ in _runs(batches):
            last = (conversation, [role_number(r) for r in roles])
            first = last if first is None else first
        ends = [x for x in (first, last if last is not first else None) if x is not None]
        sums = [[n for row in summary(numbers) for n in row] for _, numbers in ends]
        ids = pa.array([c for c, _ in ends], pa.int64())
        arrays = [pa.array([task] * len(ends), pa.int64()), ids, pa.array(sums, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["task", "conv_id", "sums"])

    borders = rows.mapInArrow(bordering, "task long, conv_id long, sums array<long>")
    # Two rows of seven numbers for each task.
    known = {(r["task"], r["conv_id"]): tuple(r)[2:] for r in borders.groupBy("conv_id").applyInArrow(_chained, _BORDER).collect()}
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def repaired(batches):
        task, out = TaskContext.get().partitionId(), []
        for conversation, roles, texts in _runs(batches):
            numbers = [role_number(r) for r in roles]
            border = shared.value.get((task, conversation))
            if border is None:
                costs, came = walk(numbers, START)
                ends = costs + [INSERT * len(ENDINGS[s]) for s in range(4)]
                last, turns, pieces, is_end = int(ends.argmin()), 0, 0, True
            else:
                entry, last, turns, pieces, is_end = border
                came = walk(numbers, entry)[1]
            begun = turns
            for (action, inserted, state), text in zip(trace(numbers, came, last), texts, strict=True):
                for role, kind, body in [*((r, "insert", "") for r in inserted), (state, action, text)]:
                    begun += kind != "merge"
                    lead = "\n" if kind == "merge" else ("<|end|>\n" if begun > 1 else "") + f"<|{ROLES[role - 1]}|>\n"
                    out.append([conversation, begun - 1, pieces, ROLES[role - 1], kind, lead + body])
                    pieces += 1
            for role in ENDINGS[last] if is_end else ():
                begun += 1
                out.append([conversation, begun - 1, pieces, ROLES[role - 1], "insert", f"<|end|>\n<|{ROLES[role - 1]}|>\n"])
                pieces += 1
            if is_end:
                out[-1][-1] += "<|end|>\n"
            if len(out) >= 5_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return rows.mapInArrow(repaired, _PIECES)


def _batch(rows: list[list]) -> pa.RecordBatch:
    types = [pa.int64()] * 3 + [pa.string()] * 3
    names = ["conv_id", "out_turn", "piece", "role", "action", "rendered"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types, strict=True)], names)
