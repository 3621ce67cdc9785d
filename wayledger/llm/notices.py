"""Short licence notices in whole texts, exact or with a bounded number of edits.

A text is taken as lower-cased words (A-Z only) with one space between them.  A notice of m characters may differ by
m // 10 edits; cut into one piece more than that, at least one piece stands unchanged in every match.  One automaton
finds the pieces of all notices, and each hit is checked where it puts the notice: first for the words as they are,
else by the regex library's bounded-error matching, whose match must begin and end with a word.  Of overlapping
inexact matches of one notice the one with fewer edits, then the earlier, is reported; exact places all are.

Null and empty texts have no words and no spans.  Texts of any length are searched whole, within their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from wayledger.llm.batches import bound_batches

#: Phrases and labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
NOTICES = BASE | {
    "licensed under the apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "spdx license identifier": "spdx",
    "without warranty of any kind": "no-warranty",
}
SPAN = "label:string,phrase:string,first_word:long,n_words:int,edits:int,found:string"
RESULT = f"struct<n_words:long,spans:array<struct<{SPAN}>>>"

#: Of ASCII, only digits and lower-case letters are parts of words.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else 0x20 for b in range(256))


def edit_budget(phrase: str) -> int:
    return len(phrase) // 10


def pieces(phrase: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of about equal length with where they begin."""
    cuts = [i * len(phrase) // (errors + 1) for i in range(errors + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


@dataclass
class Notice:
    phrase: str
    label: str
    errors: int
    pattern: regex.Pattern


class Finder:
    """The automaton over the pieces of some notices; built once per Python worker."""

    def __init__(self, notices: dict[str, str]):
        self.notices, seeds = [], {}
        for phrase, label in notices.items():
            k = edit_budget(phrase)
            pattern = regex.compile(rf"(?b)(?<= )(?:{regex.escape(phrase, literal_spaces=True)}){{e<={k}}}(?= )")
            for at, piece in pieces(phrase, k):
                seeds.setdefault(piece, []).append((len(self.notices), at))
            self.notices.append(Notice(phrase, label, k, pattern))
        self.automaton = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def _match(self, words: str, which: int, at: int) -> tuple[int, int, int] | None:
        """Start, end and edits of the notice that should begin near ``at``."""
        notice = self.notices[which]
        size, k = len(notice.phrase), notice.errors
        if at > 0 and words[at - 1] == " " and words[at + size : at + size + 1] == " " and words.startswith(notice.phrase, at):
            return at, at + size, 0
        if not k:
            return None
        found = notice.pattern.search(words, max(0, at - k - 1), at + size + k + 1)
        return found and (*found.span(), sum(found.fuzzy_counts))

    def find(self, text: str | None) -> tuple[int, list[dict]]:
        """The number of words and the spans of one text, by first word and phrase."""
        parts = (text or "").encode().lower().translate(_WORD_BYTES).split()
        if not parts:
            return 0, []
        words = (b" " + b" ".join(parts) + b" ").decode()
        tried, found = set(), set()
        for last, (size, places) in self.automaton.iter(words):
            for which, offset in places:
                at = last + 1 - size - offset
                if (which, at) not in tried:
                    tried.add((which, at))
                    if match := self._match(words, which, at):
                        found.add((which, *match))
        spans, closest = [], {}
        for which, start, stop, edits in sorted(found, key=lambda x: (x[0], x[3], x[1])):
            mine = closest.setdefault(which, [])
            if not edits or not any(a < stop and start < b for a, b in mine):
                mine.append((start, stop))
                spans.append((start, which, stop, edits))
        out, counted, words_before = [], 0, -1
        for start, which, stop, edits in sorted(spans):
            words_before += words.count(" ", counted, start)
            counted = start
            notice = self.notices[which]
            place = {"label": notice.label, "phrase": notice.phrase, "first_word": words_before, "edits": edits}
            out.append(place | {"n_words": words.count(" ", start, stop) + 1, "found": words[start:stop]})
        return len(parts), out


def notice_spans(spark: SparkSession, text: Column, notices: dict[str, str] | None = None) -> Column:
    """For each text its number of words and the spans of notices: label, phrase, place in words, edits, words found."""
    bound_batches(spark)
    # The notices are a parameter of the caller's program, not a table.
    wanted = spark.sparkContext.broadcast(NOTICES if notices is None else notices)
    kind = pa.list_(
        pa.struct(
            [("label", pa.string()), ("phrase", pa.string()), ("first_word", pa.int64())]
            + [("n_words", pa.int32()), ("edits", pa.int32()), ("found", pa.string())]
        )
    )

    @F.arrow_udf(RESULT)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(wanted.value)
        for texts in batches:
            results = [finder.find(t.as_py()) for t in texts]
            counts = pa.array([n for n, _ in results], pa.int64())
            yield pa.StructArray.from_arrays([counts, pa.array([s for _, s in results], kind)], ["n_words", "spans"])

    return found(text)
