from __future__ import annotations

import random

import numpy as np

from tonegap.llm import minhash
from tonegap.llm.common import shingle_set, word_hashes


def brute(rows, words, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocab, k=rng.choice([1, 2, 5, 9, 20, 60, 200]))
        for _ in range(rng.choice([1, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, len(base) // 12])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(copy).replace("w1", "W1")))
    return rows


def test_same_as_brute_force(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words).collect()}
        assert got == brute(rows, words)


def test_a_large_group_of_near_copies(spark):
    """A bucket of many different texts: chains of links across blocks, none lost."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(330):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            copy[rng.randrange(60)] = f"x{rng.randrange(50)}"
        rows.append((1000 + i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 2).collect()}
    assert got == brute(rows, 2)


def test_messy_rows(messy, nothing):
    rows = minhash.near_duplicates(messy, 2).collect()
    assert len(rows) == messy.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by_id[1] == [(12, 1, True)] and by_id[2] == [(12, 1, False)] * 2
    assert by_id[3] == by_id[3] and by_id[3][0] == (0, 3, True) and by_id[4][0] == (0, 4, True) and by_id[5][0] == (0, 5, True)
    assert by_id[6] == [(2, 6, True)] and by_id[7] == [(1, 7, True)]
    assert sorted(by_id[None]) == [(0, None, True), (12, None, True)]
    assert minhash.near_duplicates(nothing, 2).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    memo = word_hashes()
    for share in (0.5, 0.8, 0.95):
        both = [f"s{k}" for k in range(int(1000 * share))]
        only = (1000 - len(both)) // 2
        a = minhash.registers(np.unique(np.array([memo[w.encode()] for w in both + [f"a{k}" for k in range(only)]], np.uint64)))
        b = minhash.registers(np.unique(np.array([memo[w.encode()] for w in both + [f"b{k}" for k in range(only)]], np.uint64)))
        filled = (a != 0) | (b != 0)
        assert abs((a == b)[filled].mean() - share) < 0.1
    assert rng is not None and len(shingle_set("a b c", 2, memo)) == 2
    empty = minhash.registers(np.zeros(0, np.uint64))
    assert not empty.any() and not minhash.borrowed(empty).any()
    one = minhash.borrowed(minhash.registers(np.array([5], np.uint64)))
    assert len(set(one.tolist())) == 1 and one[0]
