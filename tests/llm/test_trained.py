"""The classifiers: parts against plain numpy, held-out accuracy, and tables without anything to learn from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayledger.llm import quality, toxicity, training
from wayledger.llm.queries import QUERIES


@pytest.fixture(scope="module")
def large():
    return "/root/testdata/sf0.01"


@pytest.mark.parametrize(("key", "label"), [("op4_quality", "quality"), ("op9_toxicity", "toxic")])
def test_held_out_accuracy(spark, large, key, label):
    """On some hundred labels; the README has the accuracy on larger tables."""
    scored = QUERIES[key](spark, large)
    rows = scored.join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50
    assert np.mean([r.predicted == r[label] for r in held]) > 0.9
    assert scored.count() == spark.read.parquet(f"{large}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", training.fold(F.col("id"), 5).alias("fold")).collect()
    assert all(r.fold == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def tables(spark, documents, labels):
    return (
        spark.createDataFrame(documents, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1), (2, 0, 0)], [(9, 1, 1), (8, 0, 0)], [(None, 1, 1), (1, None, None)]])
def test_little_to_learn_from(spark, labels):
    rows = [(1, "some words here"), (2, None), (3, ""), (None, "x"), (1, "some words here")]
    documents, labels = tables(spark, rows, labels)
    for train in (quality.train, toxicity.train):
        model = train(documents, labels, F.lit(True))
        scores = [r[0] for r in documents.select(model.score(spark, F.col("text"))).collect()]
        assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
        none = documents.limit(0)
        assert none.select(model.score(spark, F.col("text"))).count() == 0


def test_votes_and_bounds_of_the_sample(spark):
    documents = spark.range(2000).selectExpr("id as doc_id", "string(id) as text")
    labels = spark.range(2000).selectExpr("id as doc_id", "int(id % 2) as toxic", "'taken' as text", "'taken' as _label", "'x' as place")
    labels = labels.unionByName(labels.where("doc_id < 100").withColumn("toxic", F.lit(1)))
    sample = training.labelled_sample(documents, labels, "toxic", F.col("doc_id") != 7, 300).collect()
    assert 200 < sum(r.label == 0 for r in sample) < 400 and 200 < sum(r.label == 1 for r in sample) < 400
    assert all(r.label == (int(r.text) % 2 or int(r.text) < 100) for r in sample)
    assert all(r.text != "7" for r in sample)


def test_grams_are_exact():
    text = "Idiot ÉÉ"
    raw = f" {text} ".encode().lower()
    want = sorted(int.from_bytes(raw[i : i + n]) | n << 56 for n in toxicity.ORDERS for i in range(len(raw) - n + 1))
    assert sorted(toxicity.grams(text).tolist()) == want == sorted(toxicity.grams("iDIOT ÉÉ").tolist())
    assert len(toxicity.grams(None)) == len(toxicity.grams("")) == 0


WORDS = "the of trash idiot and moron thing other hest with".split()


def toxic_rows(seed, count):
    import random

    draw = random.Random(seed)
    rows = []
    for i in range(count):
        toxic = i % 4 == 0
        rows.append((int(toxic), " ".join(draw.choice(WORDS if toxic else ["the", "of", "and", "thing", "other", "hest"]) for _ in range(draw.randrange(3, 30)))))
    return rows


def by_hand(rows, shares):
    """Ratios, weights and intercept of the same model in plain Python and dense numpy."""
    n = [sum(label == k for label, _ in rows) for k in (0, 1)]
    sets = [set(toxicity.grams(t).tolist()) for _, t in rows]
    held = {}
    for (label, _), found in zip(rows, sets, strict=True):
        for g in found:
            held.setdefault(g, [0, 0])[label] += 1
    s = toxicity.SMOOTHING
    ratio = {g: np.log((p + s) / (n[1] + 2 * s)) - np.log((q + s) / (n[0] + 2 * s)) for g, (q, p) in held.items() if p + q >= toxicity.FEWEST_TEXTS}
    weight = {g: abs(r) * np.sqrt(held[g][1] / n[1] + held[g][0] / n[0]) for g, r in ratio.items()}
    kept = sorted(sorted(ratio, key=lambda g: (-weight[g], g))[: toxicity.FEATURES])
    x = np.zeros((len(rows), len(kept)))
    for i, (_, text) in enumerate(rows):
        found = toxicity.grams(text).tolist()
        for j, g in enumerate(kept):
            x[i, j] = np.sqrt(found.count(g) / max(len(found), 1)) * ratio[g]
    y = np.array([label for label, _ in rows])
    w, b, squares = np.zeros(len(kept)), 0.0, np.full(len(kept) + 1, 1e-8)
    for _ in range(toxicity.STEPS):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) / np.where(y, n[1], n[0]) / 2
        slope = np.append(x.T @ error + toxicity.PENALTY * w, error.sum())
        squares += slope**2
        step = toxicity.RATE * slope / np.sqrt(squares)
        w, b = w - step[:-1], b - step[-1]
    return kept, [ratio[g] for g in kept], w, b + np.log(shares[1] / shares[0]) / 2


@pytest.mark.parametrize("features", [40, 2_000])
def test_ratios_and_weights_against_numpy(spark, monkeypatch, features):
    monkeypatch.setattr(toxicity, "FEATURES", features)
    rows = toxic_rows(1, 80)
    sample = spark.createDataFrame(rows, "label int, text string").repartition(5)
    model = toxicity.fit(sample, (600, 200))
    kept, ratios, weights, intercept = by_hand(rows, (600, 200))
    # Of n-grams that weigh the same to the last digit either may be kept.
    if features > len(kept) or len(kept) < features:
        assert model.features.codes.tolist() == kept
    assert np.allclose(np.sort(model.features.ratios), np.sort(ratios))
    assert np.allclose(np.sort(model.weights), np.sort(weights), atol=1e-9) and model.intercept == pytest.approx(intercept)


def test_scores_do_not_depend_on_the_batch(spark, monkeypatch):
    rows = toxic_rows(2, 60)
    model = toxicity.fit(spark.createDataFrame(rows, "label int, text string"), (45, 15))
    texts = [t for _, t in rows] + [None, "", " ", "\xff ÿ", "trash " * 50_000]
    together = model.odds(texts)
    assert np.allclose(together, [model.odds([t])[0] for t in texts])
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 100)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    found = [r[0] for r in frame.select(model.score(spark, F.col("text"))).collect()]
    assert np.allclose(found, 1 / (1 + np.exp(-together)))
    assert model.odds(["moron idiot trash the of"])[0] > 0 > model.odds(["the of and thing other"])[0]


def has_insult(text):
    import re

    insults = set("trash idiot clown scum worthless moron pathetic loser disgusting stupid".split())
    return not insults.isdisjoint(re.findall("[a-z]+", (text or "").lower()))


@pytest.fixture(scope="module")
def toxic_model(spark, large):
    documents, labels = (spark.read.parquet(f"{large}/{n}.parquet") for n in ("documents", "labels"))
    return toxicity.train(documents, labels, training.fold(F.col("doc_id"), 5) != 0)


def test_held_out_texts_with_insults_are_caught(spark, large, toxic_model):
    """Planted insults in texts that were not learnt from; the labels also mark texts without any, at random."""
    rows = spark.read.parquet(f"{large}/documents.parquet").where(training.fold(F.col("doc_id"), 5) == 0).collect()
    odds = toxic_model.odds([r.text for r in rows])
    bad = np.array([has_insult(r.text) for r in rows])
    assert bad.sum() > 5 and (odds[bad] >= 0).mean() >= 0.8
    assert (odds[~bad] >= 0).mean() <= 0.01


@pytest.mark.parametrize("size", [100_000, 1_000_000, 3_000_000])
def test_long_clean_texts(spark, large, toxic_model, size):
    rows = spark.read.parquet(f"{large}/documents.parquet").collect()
    clean = " ".join(r.text for r in rows if r.text and not has_insult(r.text))
    assert toxic_model.odds([(clean * (size // len(clean) + 1))[:size]])[0] < 0


def test_statistics_of_odd_texts():
    size = len(quality.statistics(None))
    for text in ["", " \n", "a", "?", "é" * 1000, "word " * 5000, "x" * 200_000]:
        found = quality.statistics(text)
        assert len(found) == size and np.isfinite(found).all()
    assert not quality.statistics("").any()
    # The character classes share out all bytes.
    assert quality.statistics("Ab 1,!|#é\n")[:11].sum() == pytest.approx(1)


def test_pools_are_isotonic_regression():
    draw = np.random.default_rng(0)
    scores, counts = np.sort(draw.uniform(size=40)), draw.integers(1, 9, 40).astype(float)
    ones = draw.binomial(counts.astype(int), scores).astype(float)
    steps, shares = quality.pooled(scores, ones, counts)
    assert (np.diff(shares) > 0).all() and (np.diff(steps) > 0).all()
    # The minimax formula of isotonic regression.
    share = lambda a, b: ones[a : b + 1].sum() / counts[a : b + 1].sum()
    want = [max(min(share(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(sorted(set(np.round(want, 9))), np.round(shares, 9))


def test_cosines_approximate_the_kernel():
    draw = np.random.default_rng(1)
    points = draw.normal(size=(30, 25))
    features = quality.cosines(points, np.zeros(25), np.ones(25))[:, :-1]
    squares = ((points[:, None] - points[None]) ** 2).sum(2)
    assert np.abs(features @ features.T - np.exp(-squares / 2 / quality.WIDTH**2)).max() < 0.25


def test_quality_fit_against_numpy(spark):
    """The whole fit: standardised statistics, weighted ridge by dense normal equations, isotonic steps of binned scores."""
    import random

    draw, rows = random.Random(3), []
    for i in range(160):
        good = i % 3 > 0
        words = ["lorem", "ipsum", "dolor", "sit", "amet.", "Consectetur"] if good else ["AAA!!", "1234", "###", "a", "?"]
        text = " ".join(draw.choice(words) for _ in range(draw.randrange(1, 40)))
        rows.append((int(good), text, draw.random()))
    share = 0.7
    sample = spark.createDataFrame(rows, "label int, text string, place double").repartition(6)
    model = quality.fit(sample, share)
    x, y, place = np.array([quality.statistics(t) for _, t, _ in rows]), np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    mean, spread = x.mean(0), np.sqrt(np.maximum((x**2).mean(0) - x.mean(0) ** 2, 1e-12))
    assert np.allclose(model.mean, mean) and np.allclose(model.spread, spread)
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    ends = np.array([quality.CALIBRATION * place[y == k].max() for k in (0, 1)])[y]
    fitted = place > ends
    points = quality.cosines(x, mean, spread)
    a = points[fitted].T @ (points[fitted] * weight[fitted, None])
    b = points[fitted].T @ (weight[fitted] * y[fitted])
    want = np.linalg.solve(a + quality.RIDGE * a.trace() / len(a) * np.eye(len(a)), b)
    assert np.allclose(model.weights, want, atol=1e-6)
    raw = np.clip(points[~fitted] @ want, -0.5, 1.5)
    bins = np.minimum(((raw + 0.5) / 2 * quality.BINS).astype(int), quality.BINS - 1)
    total, ones, counts = (np.bincount(bins, w, quality.BINS) for w in (weight[~fitted] * raw, weight[~fitted] * y[~fitted], weight[~fitted]))
    some = counts > 0
    steps, shares = quality.pooled(total[some] / counts[some], ones[some], counts[some])
    assert np.allclose(model.steps, steps, atol=1e-6) and np.allclose(model.shares, shares, atol=1e-6)
    scores = np.array([r[0] for r in sample.select(model.score(spark, F.col("text"))).collect()])
    assert np.allclose(np.sort(scores), np.sort(np.interp(points @ want, steps, shares)), atol=1e-6)
