"""Near-duplicate classes against all pairs, and the helpers they are built on."""

import random

import numpy as np
import pytest
from checking import connect, new_shuffle_bytes, shuffle_files, spark_rows, sql_rows

from wayledger.llm import graph, near
from wayledger.llm.queries import ORACLES, QUERIES


def exact(texts, words, percent):
    """Components by comparing all pairs."""
    sets = [set(near.shingle_set(t, words).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(texts))]


def corpus(seed, groups, copies, size=60):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(groups):
        base = [draw.choice(words) for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(draw.randint(0, copies)):
            copy = list(base)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(size)] = draw.choice(words)
            texts.append(" ".join(copy))
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("words", [4, 5])
def test_against_all_pairs(spark, words):
    texts = corpus(words, 150, 4)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: r.component_id for r in near.near_classes(rows, forest=near.Forest(words=words)).collect()}
    assert [found[i] for i in range(len(texts))] == exact(texts, words, 80)


def test_one_large_group_over_many_tasks(spark):
    """Two groups hold most rows, and orders are cut into tasks of few rows, so neighbours lie in different tasks."""
    texts = corpus(1, 1, 0) * 200
    draw = random.Random(8)
    base = [f"v{i}" for i in range(100)]
    for _ in range(300):
        copy = list(base)
        for _ in range(draw.randint(1, 3)):
            copy[draw.randrange(100)] = f"u{draw.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += corpus(2, 60, 1)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    forest = near.Forest(task_rows=150)
    found = {r.id: r.component_id for r in near.near_classes(rows, forest=forest).collect()}
    assert [found[i] for i in range(len(texts))] == exact(texts, 5, 80)


@pytest.mark.parametrize("cell_bytes", [30_000, 4 << 20])
def test_pairs_in_a_large_template_family(spark, cell_bytes):
    """A page of one template each, in pairs: 97 shingles are everybody's, 11 the pair's and 12 the page's own."""
    template, texts = " ".join(f"t{i}" for i in range(101)), []
    for pair in range(250):
        for page in range(2):
            own = [f"p{pair}x{i}" for i in range(11)] + [f"q{pair}x{page}x{i}" for i in range(12)]
            texts.append(" ".join([template, *own]))
    random.Random(2).shuffle(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: r.component_id for r in near.near_classes(rows, forest=near.Forest(cell_bytes=cell_bytes)).collect()}
    want = exact(texts, 5, 80)
    assert len(set(want)) == 250
    assert sum(found[i] != w for i, w in enumerate(want)) == 0


def test_cells_against_all_pairs(spark):
    """Regions of every size are dealt to many cells."""
    texts = corpus(7, 60, 8, 30)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    forest = near.Forest(cell_bytes=5_000, round_orders=3)
    found = {r.id: r.component_id for r in near.near_classes(rows, forest=forest).collect()}
    assert [found[i] for i in range(len(texts))] == exact(texts, 5, 80)


def test_a_family_of_distinct_near_misses(spark, monkeypatch):
    """2,000 pages of one template with two changed words each: most pairs miss by little, and nothing is written per pair."""
    draw, template, texts = random.Random(6), [f"t{i}" for i in range(70)], []
    for _ in range(2_000):
        page = list(template)
        for at in draw.sample(range(70), 2):
            page[at] = f"c{draw.randrange(10**6)}"
        texts.append(" ".join(page))
    cells, links = [], []
    meet, compare = near._cells, near.links_in_cell

    def counted(*args):
        found = meet(*args)
        cells.append(found.count())
        return found

    monkeypatch.setattr(near, "_cells", counted)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: r.component_id for r in near.near_classes(rows).collect()}
    # A set goes to at most a few cells of each order that its region is in.
    assert max(cells) <= 3 * near.Forest().round_orders * len(texts)
    sets = [near.shingle_set(t, 5) for t in texts]
    links = compare([bytes([i >> 8, i & 255]) for i in range(len(sets))], sets, [-1] * len(sets), 80)
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = sorted((root(int.from_bytes(a)), root(int.from_bytes(b))))
        top[b] = a
    want = [root(i) for i in range(len(sets))]
    # Links that share no three values in any order may be missed.
    assert sum(found[i] != w for i, w in enumerate(want)) <= 2


@pytest.mark.parametrize("crossing", [False, True])
def test_links_in_a_cell(crossing):
    texts = corpus(11, 20, 5, 30)
    sets = [near.shingle_set(t, 5) for t in texts]
    draw = random.Random(3)
    sides = [draw.randrange(2) if crossing else -1 for _ in texts]
    names = [b"%03d" % i for i in range(len(texts))]
    top = {n: n for n in names}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in near.links_in_cell(names, sets, sides, 80):
        a, b = sorted((root(a), root(b)))
        top[b] = a
    want = list(range(len(texts)))
    alike = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    plain = [set(s.tolist()) for s in sets]
    for _ in range(len(texts)):
        for i in range(len(texts)):
            for j in range(i):
                if alike(plain[i], plain[j]) and (not crossing or sides[i] != sides[j]):
                    want[i] = want[j] = min(want[i], want[j])
    assert [int(root(n)) for n in names] == want


def test_finished_steps_leave_no_shuffle_files(spark):
    """The orders and the sets of all rounds lie on disk while their step runs, not until the end."""
    texts = corpus(5, 200, 4, 200)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, before = sum(near.shingle_set(t, 5).nbytes for t in texts), shuffle_files(spark)
    found = near.near_classes(rows)
    assert new_shuffle_bytes(spark, before, sets // 2) <= sets // 2
    assert {r.id: r.component_id for r in found.collect()} == dict(enumerate(exact(texts, 5, 80)))


def test_edge_rows(spark):
    texts = ["one two three four five six", None, "", " \n ", "One two THREE four five six", "a b", "a b", "b a", "x"]
    rows = [*enumerate(texts), (0, texts[0]), (None, "nobody's own words here"), (None, texts[0]), (50, "word " * 50_000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'t' as id", "'t' as class", "'t' as head")
    found = sorted(map(tuple, near.near_classes(documents).collect()), key=str)
    want = [
        (0, 2, 0, True), (0, 2, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 2, 0, False),
        (5, 1, 5, True), (6, 1, 5, False), (7, 1, 7, True), (8, 1, 8, True), (None, 1, None, True), (None, 2, 0, False),
        (50, 1, 50, True),
    ]
    assert found == sorted(want, key=str)
    assert near.near_classes(documents.where("false")).count() == 0


def test_documents_against_sql(spark, folder):
    key = "op7_near_duplicates"
    assert spark_rows(QUERIES[key](spark, folder)) == sql_rows(connect(folder), ORACLES[key])


def test_shingles():
    assert len(near.shingle_set("a b c d e a b c d e", 4)) == 5
    assert np.array_equal(near.shingle_set("A\tb\nC", 3), near.shingle_set("a b c", 3))
    assert len(near.shingle_set("a b", 4)) == 1
    assert not set(near.shingle_set("a b", 4)) & set(near.shingle_set("a b c d a b", 4))
    assert len(near.shingle_set(None, 4)) == len(near.shingle_set(" \x0b\x0c", 4)) == 0


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 62, 500).astype(np.uint64)
    other = np.concatenate([base[:400], draw.integers(0, 1 << 62, 100).astype(np.uint64)])
    same = np.mean(near.signature(np.unique(base), 2000) == near.signature(np.unique(other), 2000))
    assert abs(same - 400 / 600) < 0.05


@pytest.mark.parametrize("shape", ["path", "star", "trees"])
def test_components(spark, shape):
    draw = random.Random(4)
    order = list(range(400))
    draw.shuffle(order)
    links = {
        "path": list(zip(order, order[1:])),
        "star": [(7, i) for i in range(3000) if i != 7],
        "trees": [(i, draw.randrange(i)) for i in range(1, 600) if i % 50],
    }[shape]
    parent = {}

    def top(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    rows = spark.createDataFrame([*links, (5, 5), *links[:10]], "a long, b long")
    found = {r.node: r.root for r in graph.components(rows).collect()}
    assert len({(found[i], top(i)) for i in found}) == len({top(i) for i in found}) == len(set(found.values()))
    assert set(found) == {x for link in links for x in link}
    assert graph.components(rows.where("false")).count() == 0


def test_lookup_keeps_all_rows(spark):
    rows = spark.range(5000).selectExpr("id", "case when id < 3000 then 1 when id % 7 = 0 then null else id end as key")
    mapping = spark.range(4000).selectExpr("id as key", "id * 10 as value")
    found = {r.id: r.value for r in graph.lookup(rows, "key", mapping).collect()}
    key = {r.id: r.key for r in rows.collect()}
    assert found == {i: None if k is None or k >= 4000 else k * 10 for i, k in key.items()}
