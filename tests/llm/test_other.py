"""Url verdicts, chat repair, top-k search and the pipeline."""

import heapq
import random
from collections import defaultdict

import numpy as np
import pytest
from checking import connect, spark_rows, sql_rows
from pyspark.sql import functions as F

import corpus_pipeline
from wayledger.llm import chat, hosts, leaks, near, topk
from wayledger.llm.queries import ORACLES, QUERIES, RULES

URLS = [
    (1, "http://a.net/x"),
    (2, "HTTPS://WWW.Example.NET/en/1?q=/de/"),
    (3, "https://example.com/de/1#x"),
    (4, "https://example.com?x=://other.net/"),
    (5, None),
    (6, "no scheme here"),
    (7, "http://w.org/fr/"),
    (8, "ftp://net/"),
    (9, "http://net"),
    (10, ""),
    (1, "http://a.net/x"),
    (None, "http://myexample.com/de/"),
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, None, "t") for i, u in URLS], "page_id long, url string, html string, host string")
    rows = [(r.page_id, r.host, r.path, r.rule) for r in hosts.judge(pages, RULES).collect()]
    want = [
        (1, "a.net", "/x", "net/"), (1, "a.net", "/x", "net/"), (2, "www.example.net", "/en/1", "example.net/en/"),
        (3, "example.com", "/de/1", "example.com/de/"), (4, "example.com", "", None), (5, "", "", None), (6, "", "", None),
        (7, "w.org", "/fr/", "org/fr/"), (8, "net", "/", "net/"), (9, "net", "", None), (10, "", "", None),
        (None, "myexample.com", "/de/", None),
    ]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert hosts.judge(pages.where("false"), RULES).count() == 0


def exact_walk(weights, seeds, follow):
    """The walk's scores by solving its equations; weight of nodes without edges is lost."""
    names = sorted({x for pair in weights for x in pair} | set(seeds))
    at = {n: i for i, n in enumerate(names)}
    move = np.zeros((len(names), len(names)))
    for (a, b), w in weights.items():
        move[at[a], at[b]] = w
    move /= np.maximum(move.sum(1, keepdims=True), 1e-300)
    start = np.array([seeds.get(n, 0.0) for n in names]) * (1 - follow)
    return dict(zip(names, np.linalg.solve(np.eye(len(names)) - follow * move.T, start), strict=True))


def test_walk_is_personalised_pagerank(spark):
    """Against the exact solution, with a path of twelve links at the end of which scores are still right."""
    draw = random.Random(1)
    weights = defaultdict(float)
    for _ in range(300):
        a, b = draw.randrange(40), draw.randrange(40)
        if a != b:
            weights[f"n{a}", f"n{b}"] += draw.randint(1, 3)
    for i in range(12):
        weights[f"path{i}", f"path{i + 1}"] = 1.0
    seeds = {"n0": 1.0, "n7": 0.5, "path0": 1.0}
    settings = hosts.Spread(tolerance=1e-6)
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "source string, target string, weight double")
    start = spark.createDataFrame(list(seeds.items()), "node string, score double")
    found = {r.node: r.score for r in hosts.spread(edges, start, settings).collect()}
    want = exact_walk(weights, seeds, settings.follow)
    assert found.keys() == {n for n, v in want.items() if v > 1e-12}
    assert all(found[n] == pytest.approx(want[n], abs=5e-6) for n in found)
    assert hosts.spread(edges, start.where("false"), settings).count() == 0


def test_verdicts_are_those_of_the_converged_walk(spark):
    """Random links between hosts of which some are blocked or allowed by rule; verdicts equal the exact solution's."""
    draw = random.Random(8)
    names = [f"h{i}.com" for i in range(30)] + [f"b{i}.net" for i in range(4)] + [f"g{i}.org" for i in range(4)]
    links = {(a, b) for a, b in zip(names[:12], names[1:12])} | {(draw.choice(names), draw.choice(names)) for _ in range(60)}
    links |= {("h11.com", "b0.net"), ("g0.org", "h20.com")}
    weights = defaultdict(float)
    for a, b in links:
        if a != b:
            weights[a, b] += 1.0
    out = defaultdict(list)
    for a, b in weights:
        out[a].append(f'<a href="http://{b}/x">')
    pages = [(i, f"http://{n}/fr/", " ".join(out[n])) for i, n in enumerate(names)]
    rows = hosts.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES, hosts.Spread(tolerance=1e-6)).collect()
    settings = hosts.Spread()
    trust = exact_walk(weights, {n: 1.0 for n in names if n.endswith(".org")}, settings.follow)
    distrust = exact_walk({(b, a): w for (a, b), w in weights.items()}, {n: 1.0 for n in names if n.endswith(".net")}, settings.follow)
    for r in rows:
        t, d = trust.get(r.host, 0), distrust.get(r.host, 0)
        method = "block" if d > settings.threshold * (1 - settings.follow) and d > t else "allow"
        assert r.verdict == (method if r.rule is None else "block" if r.rule == "net/" else "allow")
    assert {"block", "allow"} <= {r.verdict for r in rows if r.rule is None}


def test_a_domain_with_most_hosts(spark, monkeypatch):
    """Subdomains of one blocked domain are looked up without meeting in one task, and distrust reaches them."""
    from wayledger.llm import graph

    monkeypatch.setattr(graph, "HOT_PARTS", 20)
    pages = [(i, f"http://s{i}.wide.example/", "") for i in range(300)] + [(900, "http://wide.example/", '<a href="http://bad.net/">')]
    pages += [(901, "http://bad.net/", ""), (902, "http://other.example/", "")]
    rows = {r.page_id: r for r in hosts.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert rows[900].verdict == "block" and rows[902].distrust == 0
    assert len({round(rows[i].distrust, 9) for i in range(300)}) == 1 and rows[0].distrust > 0


def test_distrust_comes_from_linking_to_blocked_hosts(spark):
    link = '<a href="{}">x</a><A HREF=http://else.where/>'
    pages = [
        (1, "http://bad.net/", ""),
        (2, "http://friend.com/", link.format("http://bad.net/page")),
        (3, "http://reader.com/", link.format("http://friend.com/")),
        (4, "http://good.org/fr/", link.format("http://fine.com/")),
        (5, "http://fine.com/", link.format("/own")),
        (6, "http://sub.bad.net.com/", None),
    ]
    rows = {r.page_id: r for r in hosts.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert {i: r.verdict for i, r in rows.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}
    assert rows[2].distrust > rows[3].distrust > 0 and rows[5].trust > 0


def test_verdicts_of_pages(spark, folder):
    rows = QUERIES["op2_url_verdicts"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/pages.parquet").count()
    verdict = {r.name: r.verdict for r in RULES}
    assert all(r.verdict == verdict.get(r.rule, r.verdict) for r in rows)


def cheapest(roles):
    """Least repair cost by a plain shortest path over single actions."""
    heap, done = [(0, 0, chat.START)], set()
    while heap:
        cost, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(roles) and state in (chat.START, chat.ASSISTANT):
            return cost
        for to in (1, 2, 3):
            if state in chat.FOLLOWS[to]:
                heapq.heappush(heap, (cost + chat.INSERT, i, to))
            if i < len(roles):
                change = 0 if roles[i] == to else chat.RELABEL if roles[i] else chat.RELABEL_UNKNOWN
                if state in chat.FOLLOWS[to]:
                    heapq.heappush(heap, (cost + change, i + 1, to))
                if state == to:
                    heapq.heappush(heap, (cost + chat.MERGE + change, i + 1, to))


def conversations(spark, seed, sizes):
    draw = random.Random(seed)
    names = ["system", "user", "assistant", "Human", "gpt", "narrator", None]
    rows = []
    for c, size in enumerate(sizes):
        for t in range(size):
            rows.append((c, draw.choice([t, t, t, None]), draw.choice(names), draw.choice([None, "", f"text {c} {t}", "same"])))
    rows += rows[:3]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rows


@pytest.mark.parametrize("task_rows", [7, 20_000])
def test_repair(spark, monkeypatch, task_rows):
    """Costs are least, sequences legal, and every text is there once; also with conversations over several tasks."""
    monkeypatch.setattr(chat, "TASK_ROWS", task_rows)
    frame, rows = conversations(spark, 5, [1, 2, 3, 40, 5, 6, 1, 80] * 3)
    rows += [(None, 1, "assistant", "lone")] * 2
    frame = frame.unionByName(spark.createDataFrame(rows[-2:], frame.schema)).withColumn("task", F.lit("taken"))
    pieces = defaultdict(list)
    for r in chat.repair(frame).collect():
        pieces[r.conv_id].append(r)
    given = defaultdict(list)
    for c, turn, role, text in rows:
        given[c].append((turn, role, text))
    assert pieces.keys() == given.keys()
    for c, found in pieces.items():
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found)))
        turns = [[r for r in found if r.out_turn == t] for t in range(found[-1].out_turn + 1)]
        state = chat.START
        for turn in turns:
            assert len({r.role for r in turn}) == 1 and [r.action == "merge" for r in turn] == [False] + [True] * (len(turn) - 1)
            to = chat.ROLES.index(turn[0].role) + 1
            assert state in chat.FOLLOWS[to]
            state = to
        assert state == chat.ASSISTANT
        whole = "".join(r.rendered for r in found)
        assert whole.count("<|end|>") == len(turns) and whole.endswith("<|end|>\n") and whole.startswith("<|")
        assert sorted(t or "" for _, _, t in given[c]) == sorted(
            r.rendered.removesuffix("<|end|>\n").split("|>\n", 2)[-1] if r.action != "merge" else r.rendered.removesuffix("<|end|>\n")[1:]
            for r in found if r.action != "insert"
        )
        # Roles in the order that ties are broken in: by turn, nulls first, and role; equal texts hash alike.
        ordered = sorted(given[c], key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
        numbers = [chat.role_number(r) for _, r, _ in ordered]
        cost, used = 0, [r for r in found if r.action != "insert"]
        for r, number in zip(used, numbers, strict=True):
            to = chat.ROLES.index(r.role) + 1
            cost += (0 if number == to else chat.RELABEL if number else chat.RELABEL_UNKNOWN) + (r.action == "merge")
        assert cost + chat.INSERT * (len(found) - len(used)) == cheapest(numbers)


def test_repair_of_nothing(spark):
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_repair_of_conversations(spark, folder):
    rows = QUERIES["op3_chat_repair"](spark, folder).collect()
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    assert sum(r.action != "insert" for r in rows) == table.count()


def test_top_k_against_all_products(spark):
    draw = np.random.default_rng(2)
    vectors = [(i, (draw.normal(size=12) * 0.3).tolist()) for i in range(400)]
    vectors += [(i, vectors[5][1]) for i in range(400, 460)]
    vectors += [(500, None), (501, []), (502, [float("nan")] * 12), (503, [None] * 12), (504, [float("inf")] * 12), (None, [1.0] * 12)]
    vectors += [(505, [0.5, 0.25]), (506, [0.0] * 12), (20, vectors[20][1]), (507, [3e9] * 12)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("shard", F.lit("taken"))
    whole = {i: np.floor(64 * np.pad(v, (0, 12 - len(v)))).astype(object) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in [i for i in whole if i % 20 == 0]:
        best = sorted((-int((whole[q] * v).sum()), i) for i, v in whole.items() if i != q)[:20]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    found = topk.top_k(frame, "vec_id", "embedding", F.col("id") % 20 == 0, 20, 64)
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("size", [3, 20, 21, 300])
def test_reading_stops_on_proof_only(size):
    draw = np.random.default_rng(size)
    matrix = draw.integers(-60, 60, (size, 8)) * (draw.uniform(size=(size, 8)) < 0.5)
    slots, dims = np.nonzero(matrix)
    values = matrix[slots, dims]
    levels = np.frexp(np.abs(values).astype(float))[1]
    segments = [
        {"slots": slots[levels == n].astype("<i4").tobytes(), "dims": dims[levels == n].astype("<i4").tobytes(), "values": values[levels == n].astype("<i8").tobytes()}
        for n in sorted(set(levels.tolist()), reverse=True)
    ]
    ids = np.arange(size)
    rows, found, scores = topk.best_in_shard(ids, segments, 8, ids, matrix, 5)
    for q in range(size):
        best = sorted((-int(matrix[q] @ matrix[i]), i) for i in range(size) if i != q)[:5]
        assert [(-s, i) for s, i in zip(scores[rows == q].tolist(), found[rows == q].tolist(), strict=True)] == best


def test_top_k_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, "vec_id", "embedding", F.col("id") % 20 == 0, 20, 64).count() == 0


def test_top_k_of_embeddings(spark, folder):
    assert spark_rows(QUERIES["op8_top_k"](spark, folder)) == sql_rows(connect(folder), ORACLES["op8_top_k"])


def test_pipeline(spark):
    """Each stage on what the one before kept; what goes and stays is checked against plain Python where it is exact."""
    folder = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if name != "toxicity" else None
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        kept[name] = [r.doc_id for r in rows]
        assert len(set(kept[name])) == len(kept[name])
        if name == "sentencepiece":
            assert all(r.round_trip for r in rows) and kept[name] == kept["decontamination"]
            break
        assert docs.columns == columns
        if name == "near_duplicates":
            sets = {i: set(near.shingle_set(t, 5).tolist()) for i, t in before.items()}
            alike = lambda a, b: sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            gone = before.keys() - set(kept[name])
            assert all(any(alike(i, j) for j in sets if j != i) for i in gone)
            assert not any(alike(i, j) for i in kept[name] for j in kept[name] if i < j)
        if name == "decontamination":
            items = [leaks.normal(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert before.keys() - set(kept[name]) == {i for i, t in before.items() if any(x in leaks.normal(t) for x in items)}
        docs = spark.createDataFrame(rows, docs.schema)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == sorted(kept["sentencepiece"])


def test_pipeline_on_odd_tables(spark, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "one two three four five six", "x"), (4, "w " * 30_000, None)]
    for count, name in ((len(rows), "odd"), (0, "none")):
        folder = str(tmp_path / name)
        docs = spark.createDataFrame(rows[:count], "doc_id long, text string, lang string")
        docs = docs.withColumns({c: F.lit("taken") for c in ("source", "n_chars", "ids", "score", "class", "_near_kept")})
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        found = docs
        for _, stage in corpus_pipeline.STAGES[2:]:
            found = stage(spark, found, folder)
        assert sorted((r.doc_id or 0, r.n_pieces or 0) for r in found.collect())[: max(count - 1, 0)][:2] == [(0, 6), (1, 0)][:count]
        corpus_pipeline.run(spark, folder).count()
