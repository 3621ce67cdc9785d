"""Sharding, notices, pieces and benchmark leaks against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayledger.llm import leaks, notices, sharding
from wayledger.llm.pieces import MARK, Pieces, Segmenter, default_model, load_vocabulary
from wayledger.llm.queries import QUERIES

ROWS = [
    (1, "General public license. All rights reserved.", "x"),
    (2, None, "x"),
    (3, "", "y"),
    (None, "no id here", None),
    (5, "Twice the same row", "z"),
    (5, "Twice the same row", "z"),
    (7, "long " * 60_000, "z"),
    (8, f"a marker {MARK} of its own {MARK}{MARK} \U0001f642\0", "z"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, an empty and a long text, a repeated row and columns named like the operators' own."""
    extra = ["shard", "slot", "_bucket", "_at", "class", "key", "ids", "score", "found", "spans", "label", "head"]
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.withColumns({name: F.lit("taken") for name in extra})


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_shards_hold_every_row_once(edge, buckets):
    rows = sharding.shuffle_into_shards(edge, ["doc_id", "text"], 3, buckets).collect()
    assert sorted(str(r.doc_id) + str(r.text) for r in rows) == sorted(str(r[0]) + str(r[1]) for r in ROWS)
    sizes = []
    for shard in range(3):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
        sizes.append(len(slots))
    assert max(sizes) - min(sizes) <= 1


def test_shards_of_documents(spark, folder):
    rows = QUERIES["op5_shards"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    counts = [sum(r.shard == s for r in rows) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in range(16) for i in range(counts[s])]
    again = QUERIES["op5_shards"](spark, folder).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_shuffle_is_uniform(spark):
    """Every place of a small table is taken by every row about equally often over many seeds."""
    table = spark.range(4).selectExpr("id as doc_id", "string(id) as text")
    seen = np.zeros((4, 4))
    for seed in range(30):
        for r in sharding.shuffle_into_shards(table, ["doc_id"], 1, 2, seed).collect():
            seen[r.doc_id, r.slot] += 1
    assert seen.min() >= 1


def test_write_shards(edge, tmp_path):
    shuffled = sharding.shuffle_into_shards(edge, ["doc_id", "text"], 2, 2)
    sharding.write_shards(shuffled, str(tmp_path / "shards"))
    assert edge.sparkSession.read.parquet(str(tmp_path / "shards")).count() == len(ROWS)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sharding.shuffle_into_shards(none, ["doc_id", "text"], 16, 4).count() == 0
    assert none.select(notices.notice_spans(spark, F.col("text"))).count() == 0
    model = Pieces(spark)
    assert none.select(model.decode(model.encode(F.col("text")))).count() == 0
    benchmark = spark.createDataFrame([], "item_id long, text string")
    rows = spark.createDataFrame(ROWS, SCHEMA)
    assert leaks.leaks(rows, benchmark).count() == 0
    assert leaks.without_leaks(rows, benchmark).count() == rows.count()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_base_notices_of_documents(spark, folder):
    rows = {r.doc_id: r for r in QUERIES["op6_notices"](spark, folder).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for doc_id, text in texts.items():
        words = WORD.findall(lowered(text))
        places = [(i, label) for p, label in notices.BASE.items() for q in [p.split()] for i in range(len(words)) if words[i : i + len(q)] == q]
        row = rows[doc_id]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert row.first_word == min((i for i, _ in places), default=None)
        assert row.last_word == max((i for i, _ in places), default=None)
        assert row.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(row.base_labels.split(",")) <= set(row.labels.split(",")) | {""}


def edits(pattern, text):
    """Least edit distance of the pattern to a substring."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
        before = row
    return min(before)


def test_notices_with_edits():
    finder, draw = notices.Finder(notices.NOTICES), random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for phrase, label in notices.NOTICES.items():
        for _ in range(20):
            chars, changes = list(phrase), draw.randint(0, notices.edit_budget(phrase))
            for _ in range(changes):
                chars[draw.choice([i for i, c in enumerate(chars) if c != " "])] = draw.choice(letters)
            changed = "".join(chars)
            _, spans = finder.find(f"some words {changed} and more")
            assert any(s["label"] == label for s in spans), (phrase, changed)
            for s in spans:
                assert s["edits"] >= edits(s["phrase"], s["found"]) - 1
    for text in ["all is well", "cc bc", "general publishing house", "xcc by", "reserved all rights"]:
        assert finder.find(text)[1] == []
    assert finder.find(None) == finder.find("") == finder.find("?!") == (0, [])
    assert len(finder.find("cc by " * 1000)[1]) >= 1000


@pytest.fixture(scope="module")
def segmenter():
    return Segmenter(load_vocabulary(default_model()))


def ids_of(packed):
    return np.frombuffer(packed, "<i4").tolist()


def test_pieces_are_the_best_path(segmenter):
    """Against the plain dynamic programme over all matching pieces."""
    words = segmenter.vocabulary
    table = {p: s for p, s in zip(words.pieces, words.scores, strict=True) if p}

    def best(raw):
        sums = [0.0] + [-np.inf] * len(raw)
        for end in range(1, len(raw) + 1):
            for start in range(max(0, end - 48), end):
                if raw[start:end] in table:
                    sums[end] = max(sums[end], sums[start] + table[raw[start:end]])
        return sums[-1]

    draw = random.Random(2)
    texts = ["".join(draw.choice("aeiou thernst\n1.") for _ in range(draw.randint(1, 60))) for _ in range(200)]
    for text, packed in zip(texts, segmenter.encode(texts), strict=True):
        score = sum(float(words.scores[i]) for i in ids_of(packed) if words.pieces[i])
        spelled = sum(10 for i in ids_of(packed) if not words.pieces[i])
        assert spelled or score == pytest.approx(best((MARK + text.replace(" ", MARK)).encode()), abs=1e-3)


def test_pieces_like_the_library(segmenter, spark, folder):
    """The library's own unigram model with the same scores; equal scores may be broken otherwise."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as proto

    model, words = proto.ModelProto(), segmenter.vocabulary
    with open(default_model(), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for i, piece in enumerate(model.pieces):
        if words.pieces[i]:
            piece.score, piece.type = float(words.scores[i]), 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    score = lambda ids: sum(float(words.scores[i]) for i in ids)
    for text, packed in zip(texts, segmenter.encode(texts), strict=True):
        ids, theirs = ids_of(packed), library.encode(text)
        assert ids == theirs or score(ids) == pytest.approx(score(theirs), abs=0.02)


def test_long_segments_take_the_same_paths(segmenter, monkeypatch):
    """Whether segments are searched together or one by one, and in seconds for a million characters without a space."""
    import time

    from wayledger.llm import pieces

    draw = random.Random(5)
    texts = ["".join(draw.choice("abcdeéß漢🙂 \n-") for _ in range(draw.randrange(1, 400))) for _ in range(80)]
    texts += ["a" * 300, "the" * 90, "x" * 97 + " " + "y" * 96, "é" * 200]
    found = {}
    for long in (0, 20, 96, 10**9):
        monkeypatch.setattr(pieces, "LONG", long)
        segmenter.forget()
        found[long] = segmenter.encode(texts)
    assert found[0] == found[20] == found[96] == found[10**9]
    monkeypatch.setattr(pieces, "LONG", 96)
    began = time.perf_counter()
    assert segmenter.decode(ids_of(segmenter.encode(["Donaudampfschiff" * 62_500])[0])) == "Donaudampfschiff" * 62_500
    assert time.perf_counter() - began < 60


def test_what_is_remembered_is_bounded_by_bytes(segmenter, monkeypatch):
    from wayledger.llm import pieces

    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", 20_000)
    segmenter.forget()
    for i in range(40):
        segmenter.encode([f"w{i}{'x' * 500} and more"])
        assert segmenter.known_bytes < 20_000 + 6_000
    segmenter.forget()


def test_buckets_of_records_without_text(spark):
    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert sharding.count_buckets(rows, sharding.record_bytes(F.col("text")), 50_000) >= 100_000 * sharding.RECORD_BYTES // 50_000


def test_pieces_round_trip(spark, edge, segmenter):
    model = Pieces(spark)
    rows = edge.select("text", model.encode(F.col("text")).alias("coded")).withColumn("back", model.decode(F.col("coded"))).collect()
    assert [r.back for r in rows] == [r.text for r in rows]
    assert {len(r.coded) for r in rows if r.text == ""} == {0}
    odd = ["  two  spaces ", MARK, f" {MARK} ", "\t\n", "ﷺ\u0000é", "a" * 5000]
    assert [segmenter.decode(ids_of(p)) for p in segmenter.encode(odd)] == odd


def test_pieces_of_documents(spark, folder):
    rows = QUERIES["op10_sentencepiece"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)


def test_distance_is_myers_equal_to_plain():
    """Rows of many patterns and windows of different lengths at once."""
    draw = random.Random(1)
    patterns = ["".join(draw.choice("abc ") for _ in range(draw.choice([1, 5, 40, 63, 64]))) for _ in range(300)]
    texts = ["".join(draw.choice("abc d") for _ in range(draw.randint(0, 90))) for _ in patterns]
    codes = {c: i for i, c in enumerate("abc ", 1)}
    table = np.zeros((len(patterns), leaks.WORD_BITS), np.uint8)
    for i, pattern in enumerate(patterns):
        table[i, : len(pattern)] = [codes[c] for c in pattern]
    data = np.array([codes.get(c, 0) for c in "".join(texts)], np.uint8)
    high = np.cumsum([len(t) for t in texts])
    low = high - [len(t) for t in texts]
    best, end = leaks.occurrences(table, np.array([len(p) for p in patterns]), data, low, high, 90)
    for pattern, text, found, at in zip(patterns, texts, best.tolist(), end.tolist(), strict=True):
        assert found == min(edits(pattern, text), len(pattern))
        assert edits(pattern, text[:at]) == found or not at


@pytest.mark.parametrize("block_bytes", [4 << 20, 600])
def test_documents_without_leaks(spark, folder, monkeypatch, block_bytes):
    """With the benchmark in one block and in several, documents stay or go alike, and rows of one id too."""
    monkeypatch.setattr(leaks, "BLOCK_BYTES", block_bytes)
    documents, benchmark = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    documents = documents.unionByName(documents.where("doc_id < 20"))
    gone = {r.doc_id for r in leaks.leaks(documents, benchmark).collect()}
    left = leaks.without_leaks(documents, benchmark)
    assert gone and left.columns == documents.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in documents.collect() if r.doc_id not in gone)


def test_leaks_against_all_windows(spark):
    draw = random.Random(4)
    words = ["".join(draw.choice("etaoins") for _ in range(draw.randint(1, 7))) for _ in range(60)]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(6, 60)))) for i in range(12)] + [(99, ""), (98, None), (3, "short one")]
    texts = []
    for number in range(48):
        base = [draw.choice(words) for _ in range(40)]
        item = draw.choice(items[:12])[1].split()
        if number % 3 == 0:
            # A part of an item, that holds a window but no whole segment.
            whole = " ".join(item)
            at = draw.randrange(max(1, len(whole) - 50))
            item = [whole[at : at + 50]]
        if draw.random() < 0.7:
            changed = " ".join(item)
            for _ in range(draw.randint(0, 6)):
                at = draw.randrange(len(changed))
                changed = changed[:at] + draw.choice(["", "q", "zz"]) + changed[at + 1 :]
            base[20:20] = [changed.upper() + ","]
        texts.append(" ".join(base))
    documents = spark.createDataFrame([*enumerate(texts), (None, None), (77, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = leaks.leaks(documents, benchmark).collect()
    found = {(r.doc_id, r.item_id, r.of_segments): r.n_segments for r in rows}
    want = {}
    for i, text in enumerate(texts):
        for item_id, item in items:
            plain = leaks.normal(item)
            if plain:
                parts = leaks.cut(plain, max(1, round(len(plain) / leaks.SEGMENT), -(-len(plain) // leaks.WORD_BITS)))
                near = lambda p, text=text: edits(p, leaks.normal(text)) <= len(p) * leaks.PERCENT // 100
                hits = sum(near(p) for _, p in parts)
                if hits or any(map(near, leaks.windows(plain))):
                    want[i, item_id, len(parts)] = hits
    assert found == want and len(want) > 20 and 0 in want.values()


def test_passages_from_every_word_of_an_item(spark, folder):
    """Whatever word of an item a passage of the stated length begins with, as it is and with an edit, it is found."""
    items = [(r.item_id, leaks.normal(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()][:12]
    least, draw, rows = leaks.PASSAGE + leaks.STRIDE - 1, random.Random(6), []
    for item_id, text in items:
        starts = [0, *(m.end() for m in re.finditer(" ", text))]
        for at in (a for a in starts if a + least <= len(text)):
            passage = text[at : at + least]
            place = draw.randrange(least)
            for quote in (passage, f"{passage[:place]}q{passage[place + 1 :]}"):
                rows.append((len(rows), item_id, f"Nothing known. {quote}, and no more of it."))
    documents = spark.createDataFrame(rows, "doc_id long, wanted long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = leaks.leaks(documents, benchmark)
    found = {(r.doc_id, r.item_id) for r in found.collect()}
    assert len(rows) > 200
    assert {(i, item_id) for i, item_id, _ in rows} <= found


def test_leaks_of_documents(spark, folder):
    """Whole items are planted; documents that share no four words in a row with an item are not reported."""
    rows = {(r.doc_id, r.item_id) for r in QUERIES["op1_benchmark_leaks"](spark, folder).collect()}
    documents = [(r.doc_id, leaks.normal(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, leaks.normal(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert {(d, i) for d, text in documents for i, item in items if item in text} <= rows
    grams = lambda x: {tuple(w[k : k + 4]) for w in [x.split()] for k in range(len(w) - 3)}
    texts, of_item = dict(documents), dict(items)
    assert all(grams(texts[d]) & grams(of_item[i]) for d, i in rows)
