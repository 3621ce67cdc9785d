"""Alignment of two tokenizers' tokens of the same text by lockstep merging of their byte offsets.

Tokenizer A is a byte-level BPE that encodes the text behind one space, B a piece model that puts the space there itself;
neither knows special tokens.  If the joined bytes of both are the text's, their tokens are merged: a link for each
pair of tokens whose byte ranges overlap, a cut where tokens of both end at one byte.  Null and empty texts, and texts
that one of the two doesn't give back byte by byte, have no tokens.

The documents of a batch are merged together.  A lane is a run of LANE tokens of A with the token of B that its first byte
lies in, so a document has one or more; every link belongs to the lane of its A token.  One state vector holds the A and
B pointers of all lanes.  Each step emits a link per lane, a cut where both tokens end, moves the pointers whose token
ends first, and drops the lanes that are through.

How many documents hold an id pair linked is counted by Spark from each document's distinct pairs, which are written once
to the shared folder, as encoding costs far more than reading them.  The counts of pairs have a size bound only in the
vocabularies' product; they are broadcast up to BROADCAST_PAIRS and joined by shuffle beyond that.

Repeated rows are documents of their own, ids may be null.  Texts are taken whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayledger.llm.batches import bound_batches
from wayledger.llm.graph import hot_values, lookup
from wayledger.session import checkpointed, shared_folder

#: Tokens of A that one lane merges.
LANE = 256
#: UTF-8 bytes of texts merged at once, about; a longer text is merged alone.
SLICE_BYTES = 1_000_000
#: Pair counts of 24 bytes or so each that go to every executor.
BROADCAST_PAIRS = 4_000_000
#: Beyond these the categories of characters differ between the versions of Unicode that libraries know.
_LATER = re.compile("[^\x00-ɏ]")


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable ones stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Coders:
    """Both tokenizers with the bytes of their tokens, by id."""

    def __init__(self, byte_file: bytes, piece_file: bytes):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self._byte_file = byte_file.decode()
        self._slow = None
        model = json.loads(self._byte_file)
        special = {t["content"] for t in model.get("added_tokens", []) if t.get("special")}
        alphabet = byte_alphabet()
        vocabulary = {bytes(map(alphabet.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in special}
        # Ids are numbered in merge order, so the same merges follow from ids as ranks.
        self._fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = token
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        self.bytes_b = []
        for i in range(self._pieces.get_piece_size()):
            piece = self._pieces.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self._pieces.is_byte(i) else piece.replace("▁", " ").encode())
        for name, tokens in (("a", self.bytes_a), ("b", self.bytes_b)):
            setattr(self, f"sizes_{name}", np.fromiter(map(len, tokens), np.int64, len(tokens)))
            # Ids as text, followed by each sign that may come after one.
            width = len(str(len(tokens)))
            spelled = [f"{i}{sign}".encode() for sign in ",|;" for i in range(len(tokens))]
            setattr(self, f"spelled_{name}", np.array(spelled, f"S{width + 1}"))

    def encode_a(self, text: str) -> list[int]:
        if _LATER.search(text) is None:
            return self._fast.encode_ordinary(text)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self._byte_file)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self._pieces.encode(texts, num_threads=1)

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B for each text; none where either doesn't give back its bytes."""
        ids_a, ids_b = [], []
        for text, b in zip(texts, self.encode_b(texts), strict=True):
            a = self.encode_a(" " + text) if text else []
            whole = (" " + text).encode()
            same = text and b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))
            ids_a.append(a if same else [])
            ids_b.append(b if same else [])
        return ids_a, ids_b


@dataclass
class Merged:
    """Links and cuts of a batch as places among all its A tokens and all its B tokens, in order."""

    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def merge(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, lane: int = LANE) -> Merged:
    """Merge all documents of a batch; ends count bytes over the whole batch, ``starts_a`` has each document's first A token.

    Documents without tokens have none in either list, all others end at the same byte in both.
    """
    sizes = np.diff(np.append(starts_a, len(ends_a)))
    lanes = -(-sizes // lane)
    number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    a = np.repeat(starts_a, lanes) + number * lane
    stop = np.minimum(a + lane, np.repeat(starts_a + sizes, lanes))
    begins = np.where(a > 0, ends_a[a - 1], 0) if len(a) else a
    b = np.searchsorted(ends_b, begins, "right")
    links, cuts = [], []
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        links.append((a, b))
        both = end_a == end_b
        cuts.append((a[both], b[both]))
        b = b + (end_b <= end_a)
        a = a + (end_a <= end_b)
        live = a < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    joined = [np.concatenate([pair[i] for pair in found]) if found else np.empty(0, np.int64) for found in (links, cuts) for i in (0, 1)]
    link_a, link_b, cut_a, cut_b = joined
    # A step of a lane is at one byte, so the sum of both places orders the links.
    order, turn = np.argsort(link_a + link_b, kind="stable"), np.argsort(cut_a, kind="stable")
    return Merged(link_a[order], link_b[order], cut_a[turn], cut_b[turn])


def group_digests(coders: Coders, a: np.ndarray, b: np.ndarray, merged: Merged, cuts_of: np.ndarray) -> list[str]:
    """sha256 of each document's groups as text; ``cuts_of`` counts the groups of each document."""
    group_a = np.searchsorted(merged.cut_a, np.arange(len(a)))
    group_b = np.searchsorted(merged.cut_b, np.arange(len(b)))
    # The tokens of a group stand together: its A tokens, then its B tokens.
    before_b = np.append(0, merged.cut_b + 1)[group_a] if len(a) else group_a
    place_a = np.arange(len(a)) + before_b
    place_b = np.arange(len(b)) + merged.cut_a[group_b] + 1 if len(b) else group_b
    sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    sign_a[merged.cut_a], sign_b[merged.cut_b] = 1, 2
    spelled_a = coders.spelled_a[sign_a * len(coders.bytes_a) + a]
    spelled_b = coders.spelled_b[sign_b * len(coders.bytes_b) + b]
    width = max(coders.spelled_a.itemsize, coders.spelled_b.itemsize)
    every = np.zeros(len(a) + len(b), f"S{width}")
    every[place_a], every[place_b] = spelled_a, spelled_b
    lengths = np.char.str_len(every)
    text = every.tobytes().translate(None, b"\0")
    ends = np.concatenate([[0], np.cumsum(lengths)])
    last = np.cumsum(cuts_of) - 1
    out, low = [], 0
    for i, groups in zip(last.tolist(), cuts_of.tolist(), strict=True):
        if not groups:
            out.append("")
            continue
        high = int(ends[merged.cut_a[i] + merged.cut_b[i] + 2])
        # Without the sign after the last token.
        out.append(hashlib.sha256(text[low : high - 1]).hexdigest())
        low = high
    return out


_ALIGNED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64())]
    + [("groups_sha256", pa.string()), ("ids_a", pa.list_(pa.int32())), ("ids_b", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
)
_ALIGNED_DDL = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "ids_a array<int>, ids_b array<int>, times array<int>"
)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def align(coders: Coders, doc_ids: list[int | None], texts: list[str], first_row: int = 0) -> pa.RecordBatch:
    """The aligned documents: counts, digest, and the distinct linked id pairs with how often each is linked."""
    ids_a, ids_b = coders.tokens(texts)
    n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
    a, b = (np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())) for lists, n in ((ids_a, n_a), (ids_b, n_b)))
    ends_a, ends_b = np.cumsum(coders.sizes_a[a]), np.cumsum(coders.sizes_b[b])
    starts_a = np.cumsum(n_a) - n_a
    merged = merge(ends_a, ends_b, starts_a)
    count = len(texts)
    # Documents of each link and cut.
    links_to, cuts_to = (np.searchsorted(found, np.cumsum(n_a)) for found in (merged.link_a, merged.cut_a))
    n_links, n_groups = np.diff(links_to, prepend=0), np.diff(cuts_to, prepend=0)
    pairs = a[merged.link_a] * len(coders.bytes_b) + b[merged.link_b]
    codes = np.repeat(np.arange(count), n_links) * (len(coders.bytes_a) * len(coders.bytes_b)) + pairs
    distinct, times = np.unique(codes, return_counts=True)
    of = distinct // (len(coders.bytes_a) * len(coders.bytes_b))
    pair = distinct % (len(coders.bytes_a) * len(coders.bytes_b))
    sizes = np.bincount(of, minlength=count)
    rows = pa.array(np.arange(first_row, first_row + count))
    arrays = [rows, pa.array(doc_ids, pa.int64()), *(pa.array(n) for n in (n_a, n_b, n_groups, n_links))]
    arrays.append(pa.array(group_digests(coders, a, b, merged, n_groups), pa.string()))
    arrays += [_lists(pair // len(coders.bytes_b), sizes), _lists(pair % len(coders.bytes_b), sizes), _lists(times, sizes)]
    return pa.RecordBatch.from_arrays(arrays, schema=_ALIGNED)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts, about SLICE_BYTES at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            text = text.as_py() or ""
            if texts and size + len(text) > SLICE_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
    if texts:
        yield ids, texts


#: The coders of this worker, by the files' digest: building them takes a good part of a second.
_BUILT: dict[str, Coders] = {}


def _coders(files: Broadcast) -> Coders:
    key, byte_file, piece_file = files.value
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Coders(byte_file, piece_file)
    return _BUILT[key]


def _files(spark: SparkSession, byte_path: str | None, piece_path: str | None) -> Broadcast:
    given = default_files()
    contents = []
    for path in (byte_path or given[0], piece_path or given[1]):
        with open(path, "rb") as file:
            contents.append(file.read())
    # Bounded by the vocabularies, whatever the data.
    return spark.sparkContext.broadcast((hashlib.sha256(b"".join(contents)).hexdigest(), *contents))


def aligned(documents: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """One row per document with its counts, digest and distinct linked id pairs, read back from the shared folder.

    ``row`` tells documents apart, as their ids may repeat.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    files = _files(spark, byte_path, piece_path)

    def found(batches):
        coders, row = _coders(files), TaskContext.get().partitionId() << 33
        for doc_ids, texts in _sliced(batches):
            yield align(coders, doc_ids, texts, row)
            row += len(texts)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = shared_folder(spark, "alignment")
    rows.mapInArrow(found, _ALIGNED_DDL).write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, documents, best): how many documents link a pair of ids, and whether no pair of its A id has more."""
    counts = checkpointed(links.groupBy("a", "b").agg(F.count("*").alias("documents")))
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    found = counts.join(most, "a")
    return checkpointed(found.select(_pair(), "documents", (F.col("documents") == F.col("most")).alias("best")))


def _pair():
    return (F.col("a").cast("long") * (1 << 31) + F.col("b")).alias("pair")


def report(found: DataFrame) -> DataFrame:
    """The documents of ``aligned`` with how many of their links are of a pair that is best for its A id, and the sum of counts.

    A document's links become one row before anything moves, as its distinct pairs lie in one task.
    """
    links = found.select("row", F.inline(F.arrays_zip("ids_a", "ids_b", "times"))).toDF("row", "a", "b", "times")
    counts = pair_counts(links)
    rows = links.select("row", "times", _pair())
    if counts.count() <= BROADCAST_PAIRS:
        scored = rows.join(F.broadcast(counts), "pair")
    else:
        scored = lookup(rows, "pair", counts, hot_values(counts.withColumnRenamed("documents", "n"), "pair", rows.count()))
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    totals = scored.groupBy("row").agg(best, F.sum(F.col("documents") * F.col("times")).alias("count_sum"))
    out = found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(totals, "row", "left")
    sums = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")


def token_links(documents: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Every link of every document: doc_id, its place, and the bytes, ids and place of both tokens."""
    spark = documents.sparkSession
    bound_batches(spark)
    files = _files(spark, byte_path, piece_path)
    names = ["doc_id", "link", "place_a", "place_b", "a", "b", "first_byte", "end_byte"]

    def listed(batches):
        coders = _coders(files)
        for doc_ids, texts in _sliced(batches):
            for doc_id, a, b in zip(doc_ids, *coders.tokens(texts), strict=True):
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                ends_a, ends_b = np.cumsum(coders.sizes_a[a]), np.cumsum(coders.sizes_b[b])
                merged = merge(ends_a, ends_b, np.zeros(min(len(a), 1), np.int64))
                x, y = merged.link_a, merged.link_b
                first = np.maximum(ends_a[x] - coders.sizes_a[a[x]], ends_b[y] - coders.sizes_b[b[y]])
                columns = [np.arange(len(x)), x, y, a[x], b[y], first, np.minimum(ends_a[x], ends_b[y])]
                arrays = [pa.array([doc_id] * len(x), pa.int64()), *(pa.array(c, pa.int64()) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(listed, ", ".join(f"{n} long" for n in names))
