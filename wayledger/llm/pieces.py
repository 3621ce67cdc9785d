"""Unigram segmentation into vocabulary pieces: the best-scoring path over a double-array trie, and its inverse.

A text gets one leading space, spaces become the marker U+2581, and the pieces of the path with the highest sum of
log scores are taken; among equal sums the longer last piece wins.  Characters that no piece covers become one byte
piece per UTF-8 byte.  A marker that stands in the text itself is written as bytes too, so decoding gives back every
text exactly.  Null texts give null, empty texts no pieces, and decoding does the reverse.

Trie walk and path search run in numpy over many segments at once.  As no piece has a marker after another character,
paths of different segments (markers and what follows them) are independent, and a task remembers the paths of
segments it has met in a table of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from wayledger.llm.batches import bound_batches

MARK = "▁"
MARK_BYTES = MARK.encode()
#: Stands for a marker of the text itself; no UTF-8 text holds this byte.
OWN_MARK = 0xFF
#: Bytes of segments and ids that a task remembers, about.
REMEMBERED_BYTES = 64 << 20
#: Longer segments are searched one by one: all together they would take a step for each of their bytes.
LONG = 96
#: Texts taken at once, and new segments searched at once; the search needs some hundred bytes for each of theirs.
SLICE_BYTES = 2_000_000
SLICE_ROWS = 400
LEARN_BYTES = 400_000
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Pieces by id with their log scores; ``byte_ids`` has the id of each byte piece."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown_score: float


def load_vocabulary(path: str, scores: str = "rank") -> Vocabulary:
    """Read a piece file.

    ``scores="file"`` takes its scores as they are, for unigram files.  Files of merge pieces hold merge numbers
    instead of log scores; for them ``"rank"`` gives the piece of rank r the log probability that Zipf's law expects.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(size)]
    ordinary = np.array([i for i in range(size) if not special[i]])
    values = np.zeros(size, np.float32)
    if scores == "file":
        values[ordinary] = [model.get_score(int(i)) for i in ordinary]
    else:
        ranks = np.arange(1, len(ordinary) + 1)
        values[ordinary] = -np.log(ranks) - np.log((1 / ranks).sum())
    pieces = [b"" if special[i] else model.id_to_piece(i).encode() for i in range(size)]
    if any(MARK_BYTES in p.decode().lstrip(MARK).encode() for p in pieces):
        raise ValueError("a piece has a space marker after another character")
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    return Vocabulary(pieces, values, byte_ids, float(values[ordinary].min()) - 10)


class DoubleArray:
    """A byte trie in two arrays: the child of state s by byte b is ``base[s] + b`` if ``check`` there says s."""

    def __init__(self, words: dict[bytes, int]):
        ordered = sorted(words)
        size = 4 * sum(map(len, ordered)) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        first_free, todo = 1, [(0, 0, len(ordered), 0)]
        for state, low, high, depth in todo:
            if low < high and len(ordered[low]) == depth:
                value[state] = words[ordered[low]]
                low += 1
            groups: list[tuple[int, int, int]] = []
            while low < high:
                byte, start = ordered[low][depth], low
                while low < high and ordered[low][depth] == byte:
                    low += 1
                groups.append((byte, start, low))
            if not groups:
                continue
            first_free = taken.index(0, first_free)
            least = groups[0][0]
            slot = taken.index(0, max(first_free, least))
            while any(taken[slot - least + byte] for byte, _, _ in groups):
                slot = taken.index(0, slot + 1)
            base[state] = slot - least
            for byte, start, stop in groups:
                child = slot - least + byte
                taken[child], check[child] = 1, state
                todo.append((child, start, stop, depth + 1))
        used = int(np.flatnonzero(check >= 0).max(initial=0)) + 257
        self.base, self.check, self.value = base[:used], check[:used], value[:used]


class Segmenter:
    """Best paths over the trie of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.trie = DoubleArray({p: i for i, p in enumerate(vocabulary.pieces) if p})
        self.longest = max(map(len, vocabulary.pieces))
        lengths = np.ones(256, np.int64)
        lengths[0xC0:0xE0], lengths[0xE0:0xF0], lengths[0xF0:0xF8] = 2, 3, 4
        self.char_lengths = lengths
        self.mark_ids = vocabulary.byte_ids[np.frombuffer(MARK_BYTES, np.uint8)]
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        self.table = list(vocabulary.pieces)
        for byte, piece in enumerate(vocabulary.byte_ids):
            self.table[piece] = bytes([byte])

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "known_bytes": 0}

    def forget(self) -> None:
        self.known.clear()
        self.known_bytes = 0

    def _edges(self, data, starts, stops):
        """All pieces that match at a character start: their starts, ends and ids."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        origin, at, stop = starts, starts, stops
        state = np.zeros(len(starts), np.int32)
        found = []
        while len(origin):
            child = base[state] + data[at]
            live = check[child] == state
            origin, at, stop, state = origin[live], at[live] + 1, stop[live], child[live]
            piece = value[state]
            ends = piece >= 0
            found.append((origin[ends], at[ends], piece[ends]))
            live = at < stop
            origin, at, stop, state = origin[live], at[live], stop[live], state[live]
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    @staticmethod
    def _search_long(begin, end, piece, score, ends: set[int], back: np.ndarray, by: np.ndarray) -> None:
        """Best ways to each place of long segments, from edges by end and then longest first."""
        # By place: the sum of the best way there, but 0 where a segment begins.
        sums: dict[int, float] = {}
        most, at, was, which = -np.inf, -1, 0, 0
        for low, high, number, value in zip(begin.tolist(), end.tolist(), piece.tolist(), score.tolist(), strict=True):
            if high != at:
                if at >= 0:
                    back[at], by[at] = was, which
                    if at not in ends:
                        sums[at] = most
                most, at = -np.inf, high
            total = sums.get(low, 0.0) + value
            if total > most:
                most, was, which = total, low, number
        if at >= 0:
            back[at], by[at] = was, which

    def best(self, segments: list[bytes]) -> list[bytes]:
        """The ids of each segment's best path, as packed 32-bit numbers."""
        words = self.vocabulary
        data = np.frombuffer(b"".join(segments), np.uint8)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        last = np.cumsum(sizes)
        first = last - sizes
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        of = np.searchsorted(last, starts, "right")
        begin, end, piece = self._edges(data, starts, last[of])
        # A character that no piece covers alone may also be passed as unknown.
        width = self.char_lengths[data[starts]]
        single = np.zeros(len(data) + 1, bool)
        single[begin[end - begin == self.char_lengths[data[begin]]]] = True
        lone = ~single[starts]
        begin = np.concatenate([begin, starts[lone]])
        end = np.concatenate([end, (starts + width)[lone]])
        piece = np.concatenate([piece, np.full(int(lone.sum()), -1, np.int32)])
        score = np.where(piece < 0, words.unknown_score, words.scores[piece])
        # By position in the segment, then end, then longest first.
        segment = np.searchsorted(last, begin, "right")
        position = end - first[segment]
        long = sizes > LONG
        apart = long[segment]
        position[apart] = -1
        bits = int(max(self.longest, 4)).bit_length()
        places = bits + len(data).bit_length()
        if places + int(position.max() + 1).bit_length() < 63:
            # One sort of whole numbers, far faster than one by three keys.
            order = np.argsort(((position + 1) << places) | (end << bits) | ((1 << bits) - 1 - (end - begin)), kind="stable")
        else:
            order = np.lexsort((begin, end, position))
        begin, end, piece, score, position = begin[order], end[order], piece[order], score[order], position[order]
        count = int(apart.sum())
        sums = np.full(len(data) + 1, -np.inf)
        sums[first] = 0
        # A segment's end is the next one's start, so ends keep their sums apart from starts.
        reached, back, by = sums.copy(), np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int32)
        is_last = np.zeros(len(data) + 1, bool)
        is_last[last] = True
        self._search_long(begin[:count], end[:count], piece[:count], score[:count], set(last[long].tolist()), back, by)
        begin, end, piece, score, position = begin[count:], end[count:], piece[count:], score[count:], position[count:]
        steps = np.flatnonzero(np.diff(position, prepend=0))
        for low, high in zip(steps, [*steps[1:], len(begin)] if len(steps) else [], strict=True):
            to = end[low:high]
            total = sums[begin[low:high]] + score[low:high]
            firsts = np.flatnonzero(np.diff(to, prepend=-1))
            most = np.maximum.reduceat(total, firsts)
            hit = np.flatnonzero(total == np.repeat(most, np.diff([*firsts, len(to)])))
            hit = hit[np.diff(to[hit], prepend=-1) != 0]
            ends = to[hit]
            reached[ends], back[ends], by[ends] = total[hit], begin[low:high][hit], piece[low:high][hit]
            inner = ends[~is_last[ends]]
            sums[inner] = reached[inner]
        # Back from all ends at once.
        at, whose, taken = last, np.arange(len(segments)), []
        while len(at):
            taken.append((whose, back[at], by[at]))
            at = back[at]
            more = at > first[whose]
            at, whose = at[more], whose[more]
        whose, begin, piece = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = np.argsort(begin, kind="stable")
        whose, begin, piece = whose[order], begin[order], piece[order]
        # Unknown characters become one piece for each byte.
        counts = np.where(piece >= 0, 1, np.where(data[begin] == OWN_MARK, 3, self.char_lengths[data[begin]]))
        each = np.repeat(np.arange(len(piece)), counts)
        k = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
        lead = begin[each]
        spelled = words.byte_ids[data[np.minimum(lead + k, len(data) - 1)]]
        marks = self.mark_ids[np.minimum(k, 2)]
        ids = np.where(piece[each] >= 0, piece[each], np.where(data[lead] == OWN_MARK, marks, spelled))
        packed = ids.astype("<i4").tobytes()
        stop = 4 * np.cumsum(np.bincount(whose, weights=counts, minlength=len(segments))).astype(np.int64)
        return [packed[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]

    def _learn(self, segments: list[str]) -> None:
        """Find the paths of new segments, some MB at a time."""
        low, size = 0, 0
        raw = [s.encode() for s in segments]
        for high, word in enumerate(raw, 1):
            size += len(word)
            if size >= LEARN_BYTES or high == len(raw):
                self.known.update(zip(segments[low:high], self.best(raw[low:high]), strict=True))
                low, size = high, 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text, some MB of text at a time; null texts give none."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= SLICE_BYTES:
                out += self._encode_group(group)
                group, size = [], 0
        return out + self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        known = self.known
        plain = [MARK + t.replace(" ", MARK) if t and MARK not in t else "" for t in texts]
        segments = [_SEGMENT.findall(t) for t in plain]
        new = {s for found in segments for s in found if s not in known}
        if self.known_bytes > REMEMBERED_BYTES:
            self.forget()
            new = {s for found in segments for s in found}
        if new:
            self._learn(list(new))
            # The text, four bytes for each of at most as many ids, and what the table needs.
            self.known_bytes += sum(5 * len(s) + 200 for s in new)
        own = (self._encode_apart(t) if MARK in t else None for t in texts)
        return [apart if apart is not None else b"".join(map(known.__getitem__, found)) for apart, found in zip(own, segments, strict=True)]

    def _encode_apart(self, text: str) -> bytes:
        """A text that holds a marker of its own."""
        raw = (" " + text).encode().replace(MARK_BYTES, bytes([OWN_MARK])).replace(b" ", MARK_BYTES)
        segments = re.findall(rb"(?:\xe2\x96\x81)+(?:(?!\xe2\x96\x81).)*", raw, re.DOTALL)
        return b"".join(self.best(segments))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; what is no valid text becomes replacement characters."""
        table, out, spelled = self.table, [], set(self.vocabulary.byte_ids.tolist())
        if not spelled.isdisjoint(ids):
            # Byte pieces are literal; only markers inside ordinary pieces are spaces.
            for i in ids:
                out.append(table[i] if i in spelled else table[i].replace(MARK_BYTES, b" "))
            text = b"".join(out)
        else:
            text = b"".join(map(table.__getitem__, ids)).replace(MARK_BYTES, b" ")
        text = text.decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def _sliced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The rows of the batches in slices, so that no task holds a batch's texts and ids several times over."""
    for batch in batches:
        for low in range(0, len(batch), SLICE_ROWS):
            yield batch.slice(low, SLICE_ROWS)


class Pieces:
    """Encode and decode columns with one vocabulary, whose trie is built once and sent to the tasks."""

    def __init__(self, spark: SparkSession, path: str | None = None, scores: str = "rank"):
        bound_batches(spark)
        # Bounded by the vocabulary, whatever the data.
        shared = spark.sparkContext.broadcast(Segmenter(load_vocabulary(path or default_model(), scores)))

        def lists_of(texts: pa.Array, packed: list[bytes]) -> pa.ListArray:
            sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = np.frombuffer(b"".join(packed), "<i4")
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=texts.is_null())

        @F.arrow_udf("array<int>")
        def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            segmenter = shared.value
            for texts in _sliced(batches):
                yield lists_of(texts, segmenter.encode(texts.to_pylist()))
            # Workers live on between tasks; what was remembered should not.
            segmenter.forget()

        @F.arrow_udf("struct<ids:array<int>,round_trip:boolean>")
        def checked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            segmenter = shared.value
            for texts in _sliced(batches):
                plain = texts.to_pylist()
                packed = segmenter.encode(plain)
                back = (segmenter.decode(np.frombuffer(p, "<i4").tolist()) for p in packed)
                same = [(t or "") == b for t, b in zip(plain, back, strict=True)]
                yield pa.StructArray.from_arrays([lists_of(texts, packed), pa.array(same, pa.bool_())], ["ids", "round_trip"])
            segmenter.forget()

        @F.arrow_udf("string")
        def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            segmenter = shared.value
            for lists in _sliced(batches):
                offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                spans = zip(offsets[:-1].tolist(), offsets[1:].tolist(), lists.is_valid().to_pylist(), strict=True)
                yield pa.array([segmenter.decode(ids[a:b].tolist()) if ok else None for a, b, ok in spans], pa.string())

        self._encoded, self._decoded, self._checked = encoded, decoded, checked
        self.byte_ids = [int(i) for i in shared.value.vocabulary.byte_ids]

    def encode(self, text: Column) -> Column:
        return self._encoded(text)

    def decode(self, ids: Column) -> Column:
        return self._decoded(ids)

    def checked(self, text: Column) -> Column:
        """(ids, round_trip): the ids and whether decoding them gives the text back, in one visit to Python."""
        return self._checked(text)
