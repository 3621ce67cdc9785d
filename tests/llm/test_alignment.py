"""Token alignment against a plain merge of both tokenizers' own output."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayledger.llm import alignment
from wayledger.llm.queries import QUERIES


@pytest.fixture(scope="module")
def coders():
    contents = [open(path, "rb").read() for path in alignment.default_files()]
    return alignment.Coders(*contents)


@pytest.fixture(scope="module")
def plain():
    """Token ids and bytes from the libraries themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    byte_file, piece_file = alignment.default_files()
    a = Tokenizer.from_file(byte_file)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
    alphabet = alignment.byte_alphabet()

    def tokens(text):
        if not text:
            return [], []
        one = a.encode(" " + text, add_special_tokens=False).ids
        two = b.encode(text)
        first = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in one]
        pieces = [(i, b.id_to_piece(i)) for i in two]
        second = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
        whole = (" " + text).encode()
        same = b"".join(t for _, t in first) == whole == b"".join(t for _, t in second)
        return (first, second) if same else ([], [])

    return tokens


def by_hand(first, second):
    """Links as (place, place) and groups of places, by comparing byte ranges."""

    def ranges(tokens):
        at, out = 0, []
        for _, raw in tokens:
            out.append((at, at + len(raw)))
            at += len(raw)
        return out

    a, b = ranges(first), ranges(second)
    owner = {}
    for j, (low, high) in enumerate(b):
        for byte in range(low, high):
            owner[byte] = j
    links = sorted({(i, owner[byte]) for i, (low, high) in enumerate(a) for byte in range(low, high)})
    cuts = sorted({high for _, high in a} & {high for _, high in b})
    groups, low = [], 0
    for cut in cuts:
        mine = [",".join(str(t[0]) for t, (s, e) in zip(tokens, r) if low <= s and e <= cut) for tokens, r in ((first, a), (second, b))]
        groups.append("|".join(mine))
        low = cut
    return links, groups


ODD = [
    None, "", " ", "x", "  two  spaces ", "a ▁ marker", "tab\tnew\nline\r\n", "<|endoftext|> <s> </s> <unk> <0x41>", "é ü ñ 漢字 🙂‍🙂 \x00 \x85 \xa0",
    "ʼn Ǆ ɏ ɐ 中文 العربية", "don't we'll 12345 ### $$$ !!!", "word" * 400, " " * 700, "\n" * 300, "Ünïcödé" * 50,
]


def test_tokens_are_the_libraries_own(coders, plain):
    draw = random.Random(1)
    texts = [t or "" for t in ODD]
    texts += ["".join(chr(draw.randrange(1, 0x250)) for _ in range(30)) for _ in range(1500)]
    texts += ["".join(draw.choice("ab 1'st\n\t.é中🙂") for _ in range(40)) for _ in range(300)]
    for text, a, b in zip(texts, *coders.tokens(texts), strict=True):
        first, second = plain(text)
        assert (a, b) == ([i for i, _ in first], [i for i, _ in second]), repr(text)


@pytest.mark.parametrize("lane", [1, 5, 256])
def test_merge_against_byte_ranges(coders, plain, lane):
    texts = [t or "" for t in ODD]
    ids_a, ids_b = coders.tokens(texts)
    n_a, n_b = (np.array([len(ids) for ids in lists]) for lists in (ids_a, ids_b))
    a, b = (np.array([i for ids in lists for i in ids], np.int64) for lists in (ids_a, ids_b))
    found = alignment.merge(np.cumsum(coders.sizes_a[a]), np.cumsum(coders.sizes_b[b]), np.cumsum(n_a) - n_a, lane)
    want, at_a, at_b = [], 0, 0
    for text, x, y in zip(texts, n_a.tolist(), n_b.tolist(), strict=True):
        want += [(i + at_a, j + at_b) for i, j in by_hand(*plain(text))[0]]
        at_a, at_b = at_a + x, at_b + y
    assert list(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)) == want


def expected(rows, plain):
    documents, holders = [], Counter()
    for doc_id, text in rows:
        first, second = plain(text)
        links, groups = by_hand(first, second)
        pairs = Counter((first[i][0], second[j][0]) for i, j in links)
        holders.update(pairs.keys())
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if first else ""
        documents.append((doc_id, len(first), len(second), len(groups), len(links), pairs, digest))
    most = defaultdict(int)
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    return [
        (*row[:5], sum(n for p, n in row[5].items() if holders[p] == most[p[0]]), sum(n * holders[p] for p, n in row[5].items()), row[6])
        for row in documents
    ]


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_report_against_plain_python(spark, plain, monkeypatch, most):
    """Odd texts, repeated rows and null ids, with the pair counts broadcast and joined."""
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 2_000)
    rows = [*enumerate(ODD), (3, "x"), (3, "x"), (None, "no id"), (None, "no id"), (99, "one common word of 1 text. " * 300)]
    rows += [(100 + i, f"one common word of {i % 7} texts.") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("taken") for c in ("row", "pair", "n_a", "times", "a")})
    found = [tuple(r) for r in alignment.report(alignment.aligned(frame)).collect()]
    assert sorted(found, key=str) == sorted(expected(rows, plain), key=str)
    assert alignment.report(alignment.aligned(frame.where("false"))).count() == 0


def test_links_are_listed(spark, plain):
    text = "Überschall 漢 and more"
    frame = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = sorted(alignment.token_links(frame).collect())
    first, second = plain(text)
    assert [(r.place_a, r.place_b) for r in rows] == by_hand(first, second)[0]
    assert [r.link for r in rows] == list(range(len(rows)))
    # The byte ranges of the links, one after another, are the whole text.
    assert [r.first_byte for r in rows] == [0, *(r.end_byte for r in rows[:-1])] and rows[-1].end_byte == len(text.encode()) + 1


def test_documents(spark, folder, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = [tuple(r) for r in QUERIES["op11_token_alignment"](spark, folder).collect()]
    assert sorted(found) == sorted(expected(rows, plain))
