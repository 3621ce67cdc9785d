"""The language field: inference against enumeration, slopes against differences, held-out and code-switched accuracy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayledger.llm import language
from wayledger.llm.queries import QUERIES


def by_enumeration(unary, transitions, start):
    size, count = unary.shape
    each, pairs, total = np.zeros((size, count)), np.zeros((count, count)), 0.0
    for path in itertools.product(range(count), repeat=size):
        weight = np.exp(start[path[0]] + sum(unary[t, s] for t, s in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        total += weight
        for t, s in enumerate(path):
            each[t, s] += weight
        for a, b in zip(path, path[1:]):
            pairs[a, b] += weight
    return each / total, pairs / total


@pytest.mark.parametrize("width", [1, 2, 3, 64])
def test_forward_backward(width):
    draw = np.random.default_rng(width)
    sizes = np.array([1, 5, 2, 7, 1, 4])
    unary, transitions, start = draw.normal(size=(sizes.sum(), 3)) * 2, draw.normal(size=(3, 3)), draw.normal(size=3)
    each, pairs = language.marginals(unary, transitions, start, sizes, width)
    low, want = 0, np.zeros((3, 3))
    for size in sizes.tolist():
        one, two = by_enumeration(unary[low : low + size], transitions, start)
        assert np.allclose(each[low : low + size], one)
        low, want = low + size, want + two
    assert np.allclose(pairs, want)


def test_long_sequences_do_not_underflow():
    draw = np.random.default_rng(3)
    each, pairs = language.marginals(draw.normal(size=(50_000, 4)) * 30, 5 * np.eye(4), np.zeros(4), np.array([49_000, 1_000]))
    assert np.allclose(each.sum(axis=1), 1) and pairs.sum() == pytest.approx(49_998)


def test_features_are_grams_and_whole_words():
    data = np.frombuffer(" the other éé the ".encode(), np.uint8)
    words = language.words_of(data)
    assert len(words.starts) == 4 and words.codes[0] == words.codes[3] != words.codes[1]
    table = np.random.default_rng(0).normal(size=(1 << language.BITS, 2)).astype(np.float32)
    table[0] = 0
    found = language.summed(words, table, len(data))
    for i, word in enumerate([" the ", " other ", " éé ", " the "]):
        raw, want = word.encode(), np.zeros(2)
        for n in language.ORDERS:
            for at in range(len(raw) - n + 1):
                alone = np.frombuffer(b" " + raw[at : at + n] + b" x ", np.uint8)
                # A gram alone has the number it has inside a text.
                number = language.words_of(alone).grams[n - 2][1]
                want += table[number]
        assert np.allclose(found[i], want, atol=1e-4)


def test_spelled():
    assert language.spelled("It's 3 Été—oui_non 中文 x") == " it s été oui non 中文 x".encode()
    assert language.spelled(None) == language.spelled("") == language.spelled("12 ² Ⅷ ... !") == b""


@pytest.fixture(scope="module")
def large():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark, large):
    documents = spark.read.parquet(f"{large}/documents.parquet")
    return language.train(documents, F.col("doc_id") % 2 == 0, 60)


def test_held_out_languages(spark, large):
    rows = QUERIES["op12_language"](spark, large).join(spark.read.parquet(f"{large}/documents.parquet"), "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out and r.n_words]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.99
    assert all(0 <= r.score <= 1 and (r.lang_pred == "und") == (r.n_words == 0) for r in rows)


def test_words_of_switching_text(spark, large, model):
    """Stretches of ten words of different languages, from texts that were not learnt from."""
    rows = spark.read.parquet(f"{large}/documents.parquet").where("doc_id % 2 = 1 and n_chars > 2000").collect()
    draw, right, total = random.Random(5), 0, 0
    by_lang = {lang: [language.spelled(r.text).decode().split() for r in rows if r.lang == lang] for lang in model.languages}
    for _ in range(40):
        text, labels = [], []
        for _ in range(6):
            lang = draw.choice(model.languages)
            words = draw.choice(by_lang[lang])
            low = draw.randrange(len(words) - 10)
            text += words[low : low + 10]
            labels += [model.languages.index(lang)] * 10
        each = model.of_words([" ".join(text)])[0]
        right += int((each.argmax(axis=1) == labels).sum())
        total += len(labels)
    assert right / total > 0.95
    assert (np.diag(model.transitions) > (model.transitions.sum(axis=1) - np.diag(model.transitions)) / 3).all()


def test_stretches_and_odd_texts(spark, model):
    texts = [None, "", "12 ?!", "é", "the " * 100_000, "x" * 300_000, "the and of the with and the der und die das nicht mit der und", " \n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("taken") for c in ("lang", "score", "label", "place")})
    rows = frame.select("doc_id", model.predict(spark, F.col("text")).alias("p"), model.stretches(spark, F.col("text")).alias("s")).collect()
    for r in rows:
        words = language.spelled(texts[r.doc_id]).split()
        assert r.p.n_words == len(words) == sum(s.n_words for s in r.s)
        assert [s.first_word for s in r.s] == list(np.cumsum([0, *(s.n_words for s in r.s)]))[: len(r.s)]
        assert (r.p.lang, r.p.score) == ("und", 0) if not words else r.p.lang in model.languages
    assert [s.lang for s in rows[6].s] == ["en", "de"]


@pytest.mark.parametrize("rows", [[], [(1, "some words", "en")], [(1, "a b", "en"), (2, "c d", "de"), (3, None, "fr")], [(None, "a", "en"), (1, "a", None)]])
def test_little_to_learn_from(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(frame, F.lit(True))
    asked = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    found = [r[0] for r in asked.select(model.predict(spark, F.col("text"))).collect()]
    known = {r[2] for r in rows if r[0] is not None and r[2] is not None}
    assert found[0].lang in (known or {"und"}) and found[1].lang == "und"


def test_same_model_every_time(spark, large):
    documents = spark.read.parquet(f"{large}/documents.parquet")
    one, two = (language.train(documents, F.col("doc_id") % 5 == 0, 20) for _ in range(2))
    assert np.allclose(one.transitions, two.transitions) and np.allclose(one.grams, two.grams, atol=1e-5)
