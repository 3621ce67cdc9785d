"""Benchmark passages in documents, found by pigeonhole pieces and verified by Myers' bit-parallel distance.

Texts are taken as lower-cased words (A-Z only) of digits, letters and non-ASCII characters with one space between
them.  An item is cut into segments of about SEGMENT characters.  A segment of m characters may differ by m * PERCENT //
100 edits; cut into one piece more than that, at least one piece stands unchanged in every match.  One automaton finds
the pieces of all segments in a document, and each hit is verified over the window in which its segment could lie.

An item of which no segment is found is also looked for by its windows: PASSAGE characters that begin at every STRIDE
characters, with the same share of edits.  Every passage of PASSAGE + STRIDE - 1 characters or more covers a window, so
it is found wherever in the item it begins.

Patterns have at most 64 characters, so a column of the distance fits one machine word, and the hits of many texts are
verified together: each step takes the next character of all their windows at once.

The benchmark is a stated query set: its distinct items are taken in blocks of bounded size.  A task searches for one
block at a time.  Null or empty items and texts match nothing; segments shorter than a document's words are still found
inside longer words.  Texts are searched whole, within their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayledger.llm.batches import bound_batches
from wayledger.session import shared_folder

SEGMENT = 60
PERCENT = 8
PASSAGE = 40
STRIDE = 20
#: Characters of a pattern at most.
WORD_BITS = 64
#: UTF-8 bytes of items in one block, about.
BLOCK_BYTES = 4 << 20
#: Characters of texts searched together, about, and hits verified together.
SLICE_CHARS = 500_000
HITS = 4_096

MATCH = "item_id:long,n_segments:int,of_segments:int,edits:int,first_char:long,last_char:long"
_MATCH = pa.struct(
    [("item_id", pa.int64()), ("n_segments", pa.int32()), ("of_segments", pa.int32()), ("edits", pa.int32())]
    + [("first_char", pa.int64()), ("last_char", pa.int64())]
)
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def normal(text: str | None) -> str:
    return b" ".join((text or "").encode().translate(_WORD_BYTES).lower().split()).decode()


def cut(text: str, parts: int) -> list[tuple[int, str]]:
    """``parts`` stretches of about equal length with where they begin."""
    ends = [i * len(text) // parts for i in range(parts + 1)]
    return [(a, text[a:b]) for a, b in zip(ends, ends[1:])]


def windows(text: str) -> list[str]:
    """Overlapping windows over a text, the last at its end; none of a text that is no longer than one."""
    last = len(text) - PASSAGE
    return [text[a : a + PASSAGE] for a in [*range(0, last, STRIDE), last]] if last > 0 else []


def occurrences(patterns: np.ndarray, sizes: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, width: int):
    """For each row the least edit distance of its pattern to a substring of its window, and where the first one ends.

    ``patterns`` has WORD_BITS character numbers a row, of which ``sizes`` count; the window is ``text[low:high]`` and no
    longer than ``width``.  Character number 0 equals no pattern's.
    """
    one = np.uint64(1)
    top = one << (sizes - 1).astype(np.uint64)
    up, down = np.full(len(sizes), ~np.uint64(0)), np.zeros(len(sizes), np.uint64)
    score = sizes.astype(np.int64)
    best, end = score.copy(), np.zeros(len(sizes), np.int64)
    for step in range(width):
        at = low + step
        char = np.where(at < high, text[np.minimum(at, len(text) - 1)], 0)
        equal = np.packbits((patterns == char[:, None]) & (char[:, None] != 0), axis=1, bitorder="little").view(np.uint64)[:, 0]
        across = (((equal & up) + up) ^ up) | equal | down
        rise, fall = down | ~(across | up), across & up
        score += ((rise & top) != 0).astype(np.int64) - ((fall & top) != 0)
        better = score < best
        best[better], end[better] = score[better], step + 1
        rise = rise << one
        up = (fall << one) | ~(across | rise)
        down = rise & across
    return best, end


class Searcher:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items, segments, seeds = [], [], {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            parts = max(1, round(len(text) / SEGMENT), -(-len(text) // WORD_BITS))
            stretches = [(True, segment) for _, segment in cut(text, parts)]
            stretches += [(False, window) for window in windows(text)]
            for whole, segment in stretches:
                errors = len(segment) * PERCENT // 100
                for at, piece in cut(segment, errors + 1):
                    seeds.setdefault(piece, []).append((len(segments), at))
                segments.append((len(self.items), whole, errors, segment))
            self.items.append((item_id, parts))
        self.item = np.array([s[0] for s in segments], np.int64)
        self.whole = np.array([s[1] for s in segments], bool)
        self.errors = np.array([s[2] for s in segments], np.int64)
        self.sizes = np.array([len(s[3]) for s in segments], np.int64)
        # Characters are numbered by their order among those of the items; 0 is any other.
        every = np.unique(np.frombuffer("".join(s[3] for s in segments).encode("utf-32-le"), np.uint32))
        kind = np.uint8 if len(every) < 256 else np.uint16 if len(every) < 65_536 else np.uint32
        self.number = np.zeros(0x110000, kind)
        self.number[every] = np.arange(1, len(every) + 1)
        self.patterns = np.zeros((len(segments), WORD_BITS), kind)
        for i, (*_, segment) in enumerate(segments):
            self.patterns[i, : len(segment)] = self.number[np.frombuffer(segment.encode("utf-32-le"), np.uint32)]
        self.automaton = ahocorasick.Automaton()
        places = []
        for number, (piece, found) in enumerate(seeds.items()):
            self.automaton.add_word(piece, number)
            places += [(number, which, len(piece) + at - 1) for which, at in found]
        if seeds:
            self.automaton.make_automaton()
        # By piece: the segments that it is of, and how far its last character is behind their begin.
        table = np.array(places, np.int64).reshape(-1, 3)
        self.first = np.searchsorted(table[:, 0], np.arange(len(seeds) + 1))
        self.of_piece, self.behind = table[:, 1], table[:, 2]

    def _hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, segments and where in all texts together they would begin, each once."""
        lasts, pieces, upto, base = [], [], [], 0
        for text in texts:
            for last, piece in self.automaton.iter(text):
                lasts.append(base + last)
                pieces.append(piece)
            upto.append(len(lasts))
            base += len(text)
        of = np.repeat(np.arange(len(texts)), np.diff(upto, prepend=0))
        lasts, pieces = np.array(lasts, np.int64), np.array(pieces, np.int64)
        counts = self.first[pieces + 1] - self.first[pieces]
        at = np.repeat(self.first[pieces] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        # Begins may lie before the first text by some characters.
        span = base + 2 * WORD_BITS
        begins = np.repeat(lasts, counts) - self.behind[at] + WORD_BITS
        keys = np.unique((self.of_piece[at] * len(texts) + np.repeat(of, counts)) * span + begins)
        keys, begins = np.divmod(keys, span)
        return keys % len(texts), keys // len(texts), begins - WORD_BITS

    def find(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text the items that it holds a passage of, with the segments found and their total edits.

        An item found by its windows only has no segments; its edits are those of the window with the fewest.
        """
        plain = [normal(t) for t in texts]
        found: list[list[dict]] = [[] for _ in texts]
        if not len(self.item) or not any(plain):
            return found
        of, which, begin = self._hits(plain)
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        starts = np.cumsum(sizes) - sizes
        data = self.number[np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)]
        edits, ends = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        for low in range(0, len(which), HITS):
            at = slice(low, low + HITS)
            some = which[at]
            first = np.maximum(starts[of[at]], begin[at] - self.errors[some])
            last = np.minimum(starts[of[at]] + sizes[of[at]], begin[at] + self.sizes[some] + self.errors[some])
            width = int((last - first).max(initial=0))
            edits[at], end = occurrences(self.patterns[some], self.sizes[some], data, first, last, width)
            ends[at] = first + end
        near = np.flatnonzero(edits <= self.errors[which])
        # The best place of each segment in each text, the first of equals.
        order = near[np.lexsort((ends[near], edits[near], which[near], of[near]))]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(which[order]) != 0) | (np.diff(of[order]) != 0)
        best: dict[tuple[int, int], list[tuple[bool, int, int, int]]] = {}
        for i in order[fresh].tolist():
            text, segment = int(of[i]), int(which[i])
            stop = int(ends[i] - starts[text])
            place = (bool(self.whole[segment]), int(edits[i]), max(0, stop - int(self.sizes[segment])), stop)
            best.setdefault((text, int(self.item[segment])), []).append(place)
        for (text, item), places in best.items():
            whole = [p for p in places if p[0]]
            item_id, parts = self.items[item]
            used = whole or places
            total = sum(p[1] for p in whole) if whole else min(p[1] for p in places)
            match = {"item_id": item_id, "n_segments": len(whole), "of_segments": parts, "edits": total}
            found[text].append(match | {"first_char": min(p[2] for p in used), "last_char": max(p[3] for p in used)})
        return found


def _matches(items: list[tuple[int | None, str]], text: Column) -> Column:
    """The matches of one block of items in each text."""
    shared = SparkSession.active().sparkContext.broadcast(items)

    @F.arrow_udf(f"array<struct<{MATCH}>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searcher = Searcher(shared.value)
        for texts in batches:
            out, held, size = [], [], 0
            for text in texts:
                held.append(text.as_py())
                size += len(held[-1] or "")
                if size >= SLICE_CHARS:
                    out += searcher.find(held)
                    held, size = [], 0
            yield pa.array(out + searcher.find(held), pa.list_(_MATCH))

    return found(text)


def _blocks(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct items, about BLOCK_BYTES at a time."""
    bound_batches(benchmark.sparkSession)
    items = benchmark.select(F.col(item_column).cast("long").alias("item_id"), F.col(text_column).alias("text"))
    items = items.where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for number in range(blocks):
        yield [tuple(row) for row in items.where(block == number).orderBy("item_id", "text").collect()]


def leaks(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    item_column: str = "item_id", text_column: str = "text",
) -> DataFrame:
    """One row for each document and benchmark item that it holds a passage of: the columns to keep, then MATCH.

    Characters are counted in the normal form.  An item id with several texts counts as several items, which are
    reported one by one.  Each block of items is a branch with tasks of its own.
    """
    rows = documents.select(*keep, F.col(text).alias("_text"))
    parts = [rows.select(*keep, F.inline(_matches(items, F.col("_text")))) for items in _blocks(benchmark, item_column, text_column)]
    return reduce(DataFrame.unionByName, parts)


def without_leaks(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item_column: str = "item_id", text_column: str = "text"
) -> DataFrame:
    """The documents that hold no passage of a benchmark item; between blocks of items they are written and read again."""
    left = None
    for items in _blocks(benchmark, item_column, text_column):
        if left is not None:
            folder = shared_folder(documents.sparkSession, "leaks")
            left.write.parquet(folder)
            documents = documents.sparkSession.read.schema(documents.schema).parquet(folder)
        left = documents.where(F.size(_matches(items, F.col(text))) == 0)
    return left
