"""Language of every word by a linear-chain conditional random field, and of a text by its words.

Words are the runs of letters of the lower-cased text.  A word speaks for the languages by its byte n-grams of 2 to 4
with a space on either side, so that those at its ends are prefixes and suffixes, and by itself if it is in the lexicon;
the weights of all, and of the transitions between the languages of neighbouring words, are learnt together.
Forward-backward gives each word's probability of each language.  A text's language is the one with the largest expected
share of words, and that share is the score.

Labels say a text's language only, so training text that switches is made from the sample: texts are cut into stretches of
a few words, and the stretches of all texts of a task are strung together in a seeded order.  The sample is at most about
``rows_per_language`` texts of each language, taken by a hash of the id; its frequent n-grams and words are the features.
Weights follow the full gradient, a sum over the sample's partitions.

Words are worked on in numpy, a slice of texts at a time: texts are cut into blocks of BLOCK words, one step per word for
all blocks together; each block's product of transitions carries the states from block to block.  Texts are taken whole.

Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing was learnt.  Rows with a
null id or language are not learnt from.  Equal shares go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayledger.llm.batches import bound_batches
from wayledger.llm.training import SAMPLE_TASKS, partition_sums
from wayledger.session import checkpointed

UNKNOWN = "und"
ORDERS = (2, 3, 4)
BITS = 18
#: The sample's bound for each language, and the features taken from it.
ROWS_PER_LANGUAGE = 250
GRAMS = 30_000
LEXICON = 4_000
FEWEST = 3
#: Words of a stretch of made code-switched text: 1 to so many.
STRETCH = 40
STEPS = 25
PENALTY = 1e-3
BLOCK = 64
#: Bytes of words scored at once, about.
SLICE_BYTES = 250_000

_NO_WORD = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")
_SPACE = 0x20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PLACES = 32
#: A word's code is the sum of one fixed random number for each of its bytes and their places.
_WORD_CODES = np.random.default_rng(7).integers(1, 1 << 63, (_PLACES, 256), np.uint64) * np.uint64(2) + np.uint64(1)


def spelled(text: str | None) -> bytes:
    """The words of a text, each behind one space; nothing if there is no letter."""
    if not text or _LETTER.search(text) is None:
        return b""
    found = _NO_WORD.sub(" ", text.lower()).strip()
    return b" " + found.encode() if found else b""


@dataclass
class Words:
    """Places of words in their bytes, and the features there; grams that span two words have number 0."""

    starts: np.ndarray
    grams: list[np.ndarray]
    codes: np.ndarray


def words_of(data: np.ndarray) -> Words:
    """Words of bytes in which each has one space before it, and the last one after it too."""
    starts = np.flatnonzero(data[:-1] == _SPACE)
    inner, code, grams = data != _SPACE, data.astype(np.uint64), []
    whole = np.ones(len(data), bool)
    for order in range(2, max(ORDERS) + 1):
        code = (code[:-1] << np.uint64(8)) | data[order - 1 :]
        if order > 2:
            # No space between the first and the last byte.
            whole = whole[:-1] & inner[order - 2 : -1]
        else:
            whole = whole[:-1]
        mixed = (code + np.uint64(order << 56)) * _MULTIPLIER
        number = (mixed ^ (mixed >> np.uint64(29))) * _MULTIPLIER >> np.uint64(64 - BITS)
        grams.append(np.where(whole, np.maximum(number.astype(np.int32), 1), 0))
    place = np.arange(len(data) - 1) - np.repeat(starts, np.diff(np.append(starts, len(data) - 1)))
    codes = np.add.reduceat(_WORD_CODES[place % _PLACES, data[:-1]], starts) if len(starts) else np.empty(0, np.uint64)
    return Words(starts, grams, codes)


def summed(words: Words, table: np.ndarray, size: int) -> np.ndarray:
    """For each word the sum of its grams' rows of a table."""
    total = np.zeros((size - 1, table.shape[1]), np.float32)
    for order, numbers in zip(range(2, max(ORDERS) + 1), words.grams, strict=True):
        total[: size - order + 1] += table[numbers]
    return np.add.reduceat(total, words.starts, axis=0)


def _places(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of up to ``width`` of each sequence: first item, number of items, and whether it is the sequence's first."""
    blocks = -(-sizes // width)
    of = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = np.repeat(np.cumsum(sizes) - sizes, blocks) + number * width
    return first, np.minimum(np.repeat(sizes, blocks) - number * width, width), number == 0


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row or matrix by its largest number; scales cancel out."""
    axes = tuple(range(1, x.ndim))
    return x / x.max(axis=axes, keepdims=True)


def marginals(unary: np.ndarray, transitions: np.ndarray, start: np.ndarray, sizes: np.ndarray, width: int = BLOCK):
    """Forward-backward over sequences that lie one after another, all of at least one word.

    Gives each word's probabilities and the sum over all neighbouring pairs of theirs.
    """
    emit = np.exp(np.maximum(unary - unary.max(axis=1, keepdims=True), -40).astype(np.float64))
    move, count = np.exp(transitions), unary.shape[1]
    first, length, opens = _places(sizes, width)
    order = np.argsort(-length, kind="stable")
    first, length, opens = first[order], length[order], opens[order]
    alive = [int(np.searchsorted(-length, -step)) for step in range(width)]
    # The product of each block's steps.
    product = np.broadcast_to(np.eye(count), (len(first), count, count)).copy()
    for step in range(width):
        n = alive[step]
        if not n:
            break
        moved = product[:n] @ move if step else np.where(opens[:, None, None], np.exp(start), move)
        product[:n] = _scaled(moved * emit[first[:n] + step][:, None, :])
    # From block to block, all sequences together.
    blocks = -(-sizes // width)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    begin = np.cumsum(blocks) - blocks
    into, out = np.empty((len(first), count)), np.ones((len(first), count))
    state = np.ones((len(sizes), count))
    for step in range(int(blocks.max(initial=0))):
        live = np.flatnonzero(blocks > step)
        at = place[begin[live] + step]
        into[at] = state[live]
        state[live] = _scaled((into[at][:, None, :] @ product[at])[:, 0, :])
    state = np.ones((len(sizes), count))
    for step in range(int(blocks.max(initial=0)) - 1, -1, -1):
        live = np.flatnonzero(blocks > step)
        at = place[begin[live] + step]
        out[at] = state[live]
        state[live] = _scaled((product[at] @ out[at][:, :, None])[:, :, 0])
    # Within all blocks.
    ahead, behind = np.empty_like(emit), np.empty_like(emit)
    state = into
    for step in range(width):
        n = alive[step]
        if not n:
            break
        here = first[:n] + step
        moved = state[:n] @ move if step else np.where(opens[:, None], np.exp(start), state @ move)
        ahead[here] = state[:n] = _scaled(moved * emit[here])
    state = out
    for step in range(width - 1, -1, -1):
        n = alive[step]
        if not n:
            continue
        here = first[:n] + step
        behind[here] = state[:n]
        state[:n] = _scaled((state[:n] * emit[here]) @ move.T)
    each = ahead * behind
    each /= each.sum(axis=1, keepdims=True)
    inside = np.ones(len(emit), bool)
    inside[np.cumsum(sizes) - sizes] = False
    after = np.flatnonzero(inside)
    right = emit[after] * behind[after]
    total = np.einsum("ni,ij,nj->n", ahead[after - 1], move, right, optimize=True)
    pairs = move * (ahead[after - 1].T @ (right / total[:, None]))
    return each, pairs


@dataclass
class LanguageModel:
    languages: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    entries: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def unary(self, data: np.ndarray) -> np.ndarray:
        words = words_of(data)
        total = summed(words, self.grams, len(data))
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, words.codes), len(self.lexicon) - 1)
            known = np.flatnonzero(self.lexicon[at] == words.codes)
            total[known] += self.entries[at[known]]
        return total

    def of_words(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the probabilities of its words."""
        raw = [spelled(t) for t in texts]
        sizes = np.fromiter((r.count(b" ") for r in raw), np.int64, len(raw))
        if not sizes.sum() or not self.languages:
            return [np.empty((0, len(self.languages)))] * len(texts)
        data = np.frombuffer(b"".join(raw) + b" ", np.uint8)
        each, _ = marginals(self.unary(data), self.transitions, self.start, sizes[sizes > 0])
        return np.split(each, np.cumsum(sizes)[:-1])

    def _sliced(self, batches: Iterator[pa.Array]) -> Iterator[list[np.ndarray]]:
        for texts in batches:
            held, size = [], 0
            for text in texts:
                held.append(text.as_py())
                size += len(held[-1] or "")
                if size >= SLICE_BYTES:
                    yield self.of_words(held)
                    held, size = [], 0
            yield self.of_words(held)

    def predict(self, spark: SparkSession, text: Column) -> Column:
        """(lang, score, n_words) of whole texts."""
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf("struct<lang:string,score:double,n_words:long>")
        def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shared.value
            for found in model._sliced(batches):
                shares = [each.mean(axis=0) if len(each) else None for each in found]
                langs = [UNKNOWN if s is None else model.languages[int(s.argmax())] for s in shares]
                scores = [0.0 if s is None else min(1.0, float(s.max())) for s in shares]
                columns = [pa.array(langs), pa.array(scores, pa.float64()), pa.array(map(len, found), pa.int64())]
                yield pa.StructArray.from_arrays(columns, ["lang", "score", "n_words"])

        return judged(text)

    def stretches(self, spark: SparkSession, text: Column) -> Column:
        """Stretches of words of one language: lang, first_word, n_words and their mean probability."""
        kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())]))
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf("array<struct<lang:string,first_word:long,n_words:long,score:double>>")
        def listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shared.value
            for found in model._sliced(batches):
                yield pa.array([model._runs(each) for each in found], kind)

        return listed(text)

    def _runs(self, each: np.ndarray) -> list[dict]:
        if not len(each):
            return []
        best = each.argmax(axis=1)
        borders = np.flatnonzero(np.diff(best, prepend=-1))
        return [
            {"lang": self.languages[int(best[a])], "first_word": int(a), "n_words": int(b - a), "score": float(each[a:b, best[a]].mean())}
            for a, b in zip(borders, [*borders[1:], len(best)], strict=True)
        ]


def sample_of(documents: DataFrame, keep: Column, rows_per_language: int, seed: int = 0) -> tuple[list[str], DataFrame]:
    """The languages and a bounded sample (language number, text) of the rows that ``keep`` admits."""
    spark = documents.sparkSession
    bound_batches(spark)
    lang = F.col("lang").cast("string")
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.coalesce(keep, F.lit(False)))
    counts = {r[0]: r[1] for r in rows.groupBy(lang.alias("name")).count().collect()}
    languages = sorted(counts)
    place = F.pmod(F.xxhash64(F.lit(seed), F.lit("language"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    number, taken = F.lit(None).cast("int"), F.lit(False)
    for i, name in enumerate(languages):
        number = F.when(lang == name, i).otherwise(number)
        taken = taken | ((lang == name) & (place < rows_per_language / counts[name]))
    return languages, rows.where(taken).select(number.alias("label"), F.col("text").cast("string").alias("text"), place.alias("place"))


def strung(batches: Iterator[pa.RecordBatch], seed: int) -> tuple[bytes, np.ndarray]:
    """The stretches of all texts in a seeded order, as words with their label."""
    rows = sorted((r for b in batches for r in zip(*(b[c].to_pylist() for c in ("place", "label", "text")), strict=True)), key=str)
    draw = np.random.default_rng(seed)
    parts = []
    for _, label, text in rows:
        words = spelled(text).split()
        low = 0
        while low < len(words):
            size = int(draw.integers(1, STRETCH + 1))
            parts.append((label, words[low : low + size]))
            low += size
    order = draw.permutation(len(parts))
    words = [w for i in order for w in parts[i][1]]
    labels = np.array([parts[i][0] for i in order for _ in parts[i][1]], np.int32)
    return b"".join(b" " + w for w in words), labels


def train(documents: DataFrame, keep: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Fit on a sample of the documents whose ``lang`` is known and that ``keep`` admits."""
    languages, sample = sample_of(documents, keep, rows_per_language)
    count, size = len(languages), 1 << BITS
    empty = LanguageModel(languages, np.zeros((size, count), np.float32), np.empty(0, np.uint64), np.zeros((0, count)), np.zeros((count, count)), np.zeros(count))
    if count < 2:
        return empty
    spark = documents.sparkSession

    def listed(batches):
        data, labels = strung(batches, 0)
        arrays = [pa.array([data], pa.binary()), pa.array([labels.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays if len(labels) else [a.slice(0, 0) for a in arrays], ["data", "labels"])

    rows = checkpointed(sample.repartition(SAMPLE_TASKS, "place").mapInArrow(listed, "data binary, labels binary"))

    def parts(batch):
        for data, labels in zip(batch["data"], batch["labels"], strict=True):
            yield np.frombuffer(data.as_py() + b" ", np.uint8), np.frombuffer(labels.as_py(), np.int32)

    def counted(batch):
        total = np.zeros(size)
        for data, _ in parts(batch):
            for numbers in words_of(data).grams:
                total += np.bincount(numbers, minlength=size)
        return total

    counts = partition_sums(rows, counted, "f4")
    if counts is None:
        return empty
    counts[0] = 0
    used = np.flatnonzero(counts >= FEWEST)
    used = np.sort(used[np.lexsort((used, -counts[used]))[:GRAMS]])
    place = np.zeros(size, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    lexicon = _frequent_words(rows, parts)
    shared = spark.sparkContext.broadcast((place, lexicon))
    n_grams, n_words = len(used) + 1, len(lexicon)
    cut = np.cumsum([n_grams * count, n_words * count, count * count, count])

    def unpacked(flat):
        grams, entries, transitions, start, _ = np.split(flat, cut)
        return grams.reshape(n_grams, count), entries.reshape(n_words, count), transitions.reshape(count, count), start

    weights, squares = np.zeros(cut[-1]), np.full(cut[-1], 1e-8)
    for _ in range(STEPS):
        state = spark.sparkContext.broadcast(weights.astype(np.float32))

        def slope(batch, state=state):
            (place, lexicon), flat = shared.value, state.value.astype(np.float64)
            grams, entries, transitions, start = unpacked(flat)
            total = [np.zeros_like(x) for x in (grams, entries, transitions, start)]
            seen = 0
            for data, labels in parts(batch):
                found = words_of(data)
                numbers = [place[g] for g in found.grams]
                unary = summed(Words(found.starts, numbers, found.codes), grams.astype(np.float32), len(data))
                at = np.minimum(np.searchsorted(lexicon, found.codes), max(n_words - 1, 0))
                known = np.flatnonzero(lexicon[at] == found.codes) if n_words else np.empty(0, np.int64)
                unary[known] += entries[at[known]]
                each, pairs = marginals(unary, transitions, start, np.array([len(labels)]))
                error = each.copy()
                error[np.arange(len(labels)), labels] -= 1
                owner = np.repeat(np.arange(len(labels)), np.diff(np.append(found.starts, len(data) - 1)))
                for column in range(count):
                    of_byte = error[owner, column]
                    for g in numbers:
                        total[0][:, column] += np.bincount(g, of_byte[: len(g)], n_grams)
                    if n_words:
                        total[1][:, column] += np.bincount(at[known], error[known, column], n_words)
                np.subtract.at(pairs, (labels[:-1], labels[1:]), 1)
                total[2] += pairs
                total[3] += error[0]
                seen += len(labels)
            return np.concatenate([*(x.ravel() for x in total), [seen]])

        gradient = partition_sums(rows, slope, "f4")
        gradient = gradient[:-1] / gradient[-1] + PENALTY * weights / max(len(used), 1)
        # The shared number of all grams that were not taken stays without weight.
        gradient[:count] = 0
        squares += gradient**2
        weights = weights - 0.3 * gradient / np.sqrt(squares)
        state.unpersist()
    grams, entries, transitions, start = unpacked(weights)
    table = np.zeros((size, count), np.float32)
    table[used] = grams[1:]
    return LanguageModel(languages, table, lexicon, entries.astype(np.float32), transitions, start)


def _frequent_words(rows: DataFrame, parts) -> np.ndarray:
    """Codes of the LEXICON most frequent words of the sample, sorted."""

    def coded(batches):
        for batch in batches:
            for data, _ in parts(batch):
                codes, times = np.unique(words_of(data).codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(times)], ["code", "n"])

    counts = rows.mapInArrow(coded, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)
    best = counts.orderBy(F.desc("n"), "code").limit(LEXICON).collect()
    return np.sort(np.array([r["code"] for r in best], np.int64).view(np.uint64))
