"""Conversation structure repair against a brute-force search and plain Python damage."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from checking import connect, spark_rows, sql_rows
from pyspark.sql import functions as F

from wayledger.llm import structure
from wayledger.llm.queries import ORACLES, QUERIES

EMPTY = hashlib.sha256().hexdigest()


def cheapest(rows):
    """Least cost and least edits of (kind letter, fault) rows by search over all partial repairs in order of both."""
    heap = [(0, "", 0, "")]
    seen = set()
    while heap:
        cost, edits, at, last = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, edits
        # The first arrival at a node is the cheapest; of equal ones all go on, as a longer prefix may win later.
        if (cost, edits, at, last) in seen or cost > 200:
            continue
        seen.add((cost, edits, at, last))
        follows = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 5, edits + "I", at, follows))
        if at < len(rows):
            letter, fault = rows[at]
            heapq.heappush(heap, (cost + 2, edits + "D", at + 1, last))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if letter == follows or (letter == "s" and last == ""):
                    heapq.heappush(heap, (cost + extra, edits + "K", at + 1, letter))
                heapq.heappush(heap, (cost + 1 + extra, edits + "R", at + 1, follows))


def best_by_suffix(rows):
    """The same by plain recursion from the end, for longer sequences."""
    ends = {"": (0, ""), "a": (0, ""), "u": (5, "I"), "s": (10, "II")}
    for letter, fault in reversed(rows):
        extra = 5 * (fault == "truncated")
        stay = fault not in ("blank", "duplicate")

        def after(last, ends=ends, letter=letter, extra=extra, stay=stay):
            follows = "a" if last == "u" else "u"
            ways = [(ends[last][0] + 2, "D" + ends[last][1])]
            if stay:
                if letter == follows or (letter == "s" and last == ""):
                    ways.append((ends[letter][0] + extra, "K" + ends[letter][1]))
                ways.append((ends[follows][0] + 1 + extra, "R" + ends[follows][1]))
            return min(ways)

        plain = {s: after(s) for s in ("", "s", "u", "a")}
        one = {s: min(plain[s], (plain[f][0] + 5, "I" + plain[f][1])) for s, f in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u"))}
        ends = {s: min(one[s], (one[f][0] + 5, "I" + one[f][1])) for s, f in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u"))}
    return ends[""]


FAULTS = ["", "blank", "duplicate", "truncated"]


def coded(rows):
    return [("_sua".find(letter) if letter in "sua" and letter else 0, FAULTS.index(fault)) for letter, fault in rows]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_edits_are_the_least_of_the_cheapest(monkeypatch, block):
    monkeypatch.setattr(structure, "BLOCK", block)
    draw = random.Random(block)
    for size in [0, 1, 2, 3, 4, 5, 6, 7] * 12:
        rows = [(draw.choice("suuaax"), draw.choice(["", "", "", *FAULTS])) for _ in range(size)]
        cost, edits = cheapest(rows)
        assert best_by_suffix(rows) == (cost, edits)
        assert structure.least_edits(coded(rows)) == (edits, structure.least_edits(coded(rows))[1])
        assert structure.cost_of(coded(rows), edits) == cost
    for size in (40, 90, 200):
        rows = [(draw.choice("uaua" * 3 + "sx"), draw.choice([""] * 8 + FAULTS)) for _ in range(size)]
        assert structure.least_edits(coded(rows))[0] == best_by_suffix(rows)[1]


def test_prices_at_the_end_are_exact_costs():
    rows = coded([("u", ""), ("u", "truncated"), ("a", ""), ("x", ""), ("s", ""), ("a", "blank")])
    block = structure.Block(rows, structure.FINAL, True)
    edits, _ = block.auction(structure.START)
    assert block.prices[0][structure.START] == structure.cost_of(rows, edits)
    for layer, prices in enumerate(block.prices[:-1]):
        for state, price in enumerate(prices):
            arcs = structure.ARCS[rows[layer][0]][rows[layer][1]][state]
            assert all(price <= cost + block.prices[layer + step][to] for _, step, to, cost in arcs)


def expected(rows):
    """By conversation: the contract's columns from plain rows (conv_id, turn, role, text)."""
    given, ids = defaultdict(list), {r[0] for r in rows}
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        given[c] += [(turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
    out = {}
    for c in ids:
        found = given[c]
        if not found:
            out[c] = (0, 0, 0, 0, 0, 0, "", EMPTY)
            continue
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in found:
            body = text.strip(structure.WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        letters = [role[:1] for _, role, _ in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        cost, edits = best_by_suffix(list(zip(letters, faults)))
        at, last, lines = 0, "", []
        for e in edits:
            follows = "a" if last == "u" else "u"
            if e != "D":
                new = {"u": "user", "a": "assistant"}[follows] if e in "IR" else found[at][1]
                lines.append(f"{new}:{'' if e == 'I' else found[at][2]}")
                last = new[0]
            at += e != "I"
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c] = (gaps, *(faults.count(f) for f in FAULTS[1:]), illegal, cost, edits, digest)
    return out


def random_rows(seed, sizes):
    draw = random.Random(seed)
    rows = []
    for c, size in enumerate(sizes):
        for t in range(size):
            role = draw.choice(["user", "assistant"] * 4 + ["system", "tool", "useful", "", None, "User"]) if t % 3 else ["user", "assistant"][t % 2]
            text = draw.choice(["Fine.", f"Text {t}!", f"cut {t}", "", " \n", None, "All the same.", "Ends in white. \t", "odd\x0b end\x0c", "non-breaking.\xa0"])
            rows.append((c, t if draw.random() < 0.95 else t + 1000, role, text))
    return rows


@pytest.mark.parametrize(("task_rows", "copies"), [(100_000, 1_000), (20, 2)])
def test_report_against_plain_python(spark, monkeypatch, task_rows, copies):
    """Also with conversations over many tasks, one of them with a third of all rows, and repeated rows."""
    monkeypatch.setattr(structure, "TASK_ROWS", task_rows)
    monkeypatch.setattr(structure, "COPIES", copies)
    monkeypatch.setattr(structure, "BLOCK", 7 if copies == 2 else 64)
    rows = random_rows(3, [1, 1, 2, 3, 3, 4, 5, 6, 7, 8, 8, 9, 11, 150] * 2 + [0, 200])
    rows += [(None, 1, "user", "Nobody's."), (None, 2, "assistant", "Answer."), (77, None, "user", "No turn."), (78, None, None, None)]
    rows += [(79, 5, "assistant", "Repeated.")] * 9 + [(80, t, "user", "Same.") for t in range(30)]
    rows += [(c, 0, "user", "Alone.") for c in range(100, 160)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({c: F.lit("taken") for c in ("name", "kind", "fault", "stretch", "at", "audit", "roles")})
    found = {r.conv_id: tuple(r)[1:] for r in structure.report(frame, structure.damage(frame)).collect()}
    assert found == expected(rows)


def test_repaired_rows_are_legal(spark):
    rows = random_rows(9, [5, 9, 20])
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = defaultdict(list)
    for r in structure.repaired_rows(structure.stretches(frame), frame).collect():
        pieces[r.conv_id].append((r.stretch, r.at, r.edit, r.role, r.text))
    texts = {(r[0], " " if r[3] is None else r[3]) for r in rows}
    for c, found in pieces.items():
        found.sort()
        assert re.fullmatch("(s?(ua)+)?", "".join(p[3][0] for p in found))
        assert all((p[2] == "I" and p[4] == "") or (c, p[4]) in texts for p in found)


def test_tables_without_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert structure.report(none, structure.damage(none)).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "x")], none.schema)
    assert [tuple(r) for r in structure.report(one, one.where("false")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", EMPTY)]


def test_conversations(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_structure_repair"](spark, folder).collect()}
    assert found == expected(rows)


def test_conversations_against_sql(spark, folder):
    key = "op13_structure_repair"
    if key in ORACLES:
        assert spark_rows(QUERIES[key](spark, folder)) == sql_rows(connect(folder), ORACLES[key])
