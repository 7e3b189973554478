from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tonegap.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(sides, text):
    """[(start, end, id)] of both tokenizers, or None; bytes of A by decoding token by token."""
    a, b = sides
    raw = (" " + text).encode()
    shown = alignment.byte_alphabet()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(shown[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return None
    out = []
    for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
        at, own = 0, []
        for i, p in zip(ids, parts):
            own.append((at, at + len(p), i))
            at += len(p)
        out.append(own)
    return out


def brute(sides, texts):
    """Every pair of tokens compared by their bytes."""
    each = [spans(sides, t) if t else None for t in texts]
    links = [[(x[2], y[2]) for x in s[0] for y in s[1] if x[0] < y[1] and y[0] < x[1]] if s else [] for s in each]
    counts = Counter(pair for own in links for pair in own)
    most: dict = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    rows = []
    for s, own in zip(each, links):
        if not s:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({x[1] for x in s[0]} & {y[1] for y in s[1]})
        groups, low = [], 0
        for high in ends:
            groups.append("|".join(",".join(str(x[2]) for x in side if low < x[1] <= high) for side in s))
            low = high
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        best = sum(counts[p] == most[p[1]] for p in own)
        rows.append((len(s[0]), len(s[1]), len(groups), len(own), best, sum(counts[p] for p in own), digest))
    return rows


TEXTS = [
    None,
    "",
    " ",
    "the quick brown fox",
    "The  quick\n\nbrown\tfox ",
    "Überraschung naïve café \U0001f600 日本語のテキスト ́",
    "<|endoftext|> <s> </s> <0x41> ▁mark",
    "nul \x00 byte",
    "antidisestablishmentarianism" * 3,
    "x" * 3000,
    "1234567890 3.14159 -- !!!??? ...",
    "the the the quick",
    "the quick brown fox",
    "una palabra más y otra más",
]


@pytest.mark.parametrize("hot", [0, 5, 1 << 18])
def test_is_brute_force_with_any_number_of_hot_pairs(spark, sides, hot):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = alignment.alignment_counts(docs, A, B, hot_pairs=hot).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute(sides, TEXTS)


def test_is_brute_force_on_documents(spark, sides):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 3000")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: tuple(r)[1:] for r in alignment.alignment_counts(docs, A, B).collect()}
    assert rows == dict(zip(texts, brute(sides, list(texts.values())))) and len(rows) > 50


def test_remembered_windows_are_bounded(sides, monkeypatch):
    monkeypatch.setattr(alignment, "CALL_CHARS", 100)
    own = alignment.Aligner(alignment.load_side(A), alignment.load_side(B))
    texts = [f"word{k} again{k} the word{k} again{k}" for k in range(300)] + ["y" * 5000 + " " + "y" * 5000, None, ""]
    want = list(own.documents(texts))
    assert len(want) == len(texts) and all(len(key) <= 4 * alignment.MEMO_TOKENS for key in own.memo)
    monkeypatch.setattr(alignment, "MEMO_BYTES", 3000)
    small = alignment.Aligner(own.a, own.b)
    got = []
    for found in small.documents(texts):
        got.append(found)
        assert small.bytes <= 3000 and len(small.memo) <= 9
    assert got == want and len(want[300][2]) == 2
    calls = []
    real = alignment.Aligner.align
    monkeypatch.setattr(alignment.Aligner, "align", lambda self, windows: calls.append(len(windows)) or real(self, windows))
    assert list(own.documents(texts[:300])) == want[:300]
    assert sum(calls) < 300  # few but the first of each text were new


def test_the_alignment_itself(spark, sides):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, groups string")
    for r in alignment.align_texts(docs, A, B).collect():
        text = TEXTS[r.doc_id]
        want = spans(sides, text) if text else None
        assert bool(r.groups) == bool(want)
        at = 0
        for g in r.groups:
            assert g.start == at and g.end > at
            at = g.end
            assert [list(g.a), list(g.b)] == [[x[2] for x in side if g.start < x[1] <= g.end] for side in want]
        assert not want or at == len((" " + text).encode())


def test_odd_rows(messy, nothing):
    rows = alignment.alignment_counts(messy.withColumn("pairs", messy.score), A, B).collect()
    assert len(rows) == messy.count()
    same = [tuple(r) for r in rows if r.doc_id == 2]
    assert len(same) == 2 and same[0] == same[1] and same[0][1] > 0
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in rows if r.doc_id in (3, 4))
    long = next(r for r in rows if r.doc_id == 6)
    assert long.n_a > 40_000 and long.n_groups > 40_000
    assert alignment.alignment_counts(nothing, A, B).collect() == []


def test_both_ways_of_encoding_are_one(sides):
    """Each plain character in different surroundings, and random strings of them."""
    side, rng = alignment.load_side(A), random.Random(6)
    chars = [chr(c) for c in range(0x250)]
    texts = [t for c in chars for t in (f"a{c}b", f" {c} 1{c}", f"{c}{c}x", f"1{c}2 {c}'s", f"\n{c} \n")]
    texts += ["".join(rng.choice(chars) for _ in range(rng.choice([3, 30, 300]))) for _ in range(2000)]
    texts += ["".join(rng.choice("etaoin shrdlu'sIT \n") for _ in range(200)) for _ in range(500)] + ["z" * 30_000, " " * 30_000 + "a"]
    assert all(len(t) <= alignment.PLAIN_CHARS and alignment._PLAIN.fullmatch(t) for t in texts)
    assert [list(x) for x in side.encode(texts)] == [e.ids for e in sides[0].encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [list(x) for x in side.encode(["日本", "a", "é 日"])] == [sides[0].encode(" " + t, add_special_tokens=False).ids for t in ("日本", "a", "é 日")]
