from __future__ import annotations

import random
from collections import Counter

import numpy as np

from tests.llm.conftest import LONG
from tonegap.llm import decontamination, neighbours
from tonegap.llm.common import sequence_hashes, word_hashes
from tonegap.llm.components import connected_components


def best(vectors, every=20, top=20):
    """Exact answers by the same sums."""
    out = {}
    for i, v in vectors.items():
        if i % every == 0:
            scored = [(-float(neighbours.inner_products(v[None], w[None])[0, 0]), j) for j, w in vectors.items() if j != i]
            out[i] = [(j, -s) for s, j in sorted(scored)[:top]]
    return out


def answers(df):
    out: dict = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_neighbours_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    hub = rng.normal(size=8)
    vectors = {i: (hub if i % 3 == 0 else rng.normal(size=8) * rng.uniform(0.2, 3)) for i in range(400)}
    rows = [(i, [float(x) for x in v], "k") for i, v in vectors.items()]
    rows += [rows[5], (1000, None, "k"), (1020, [], "k"), (1040, [0.0] * 8, "k"), (1060, [float("nan")] + [1.0] * 7, "k"), (1080, [None] + [1.0] * 7, "k"), (1100, [1.0] * 3, "k"), (None, [1.0] * 8, "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string")
    got, want = answers(neighbours.nearest(df)), best(vectors)
    assert set(got) == set(want)
    found = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert found >= 0.97 * 20 * len(want)
    assert got[0] == want[0]  # a copy of the hub: ties by id
    few = answers(neighbours.nearest(df.filter("vec_id < 7")))
    assert len(few[0]) == 6
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    got, want = answers(neighbours.nearest(df)), best(vectors)
    assert set(got) == set(want)
    assert np.mean([len({j for j, _ in got[i]} & {j for j, _ in want[i]}) / 20 for i in want]) >= 0.95


def test_recall_with_more_lists_than_a_beam(spark, monkeypatch):
    """Vectors without clusters in 1,250 lists: no fixed number of lists holds the neighbours."""
    monkeypatch.setattr(neighbours, "LIST_SIZE", 8)
    x = np.random.default_rng(5).normal(size=(10_000, 64))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = answers(neighbours.nearest(df, every=100))
    scores = x[::100] @ x.T
    scores[np.arange(100), np.arange(0, 10_000, 100)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([np.isin(w, [j for j, _ in got[100 * k]]).mean() for k, w in enumerate(want)]) >= 0.95


def test_a_query_reads_all_lists_within_its_ratio():
    """On 8,192 lists, queries that did not fit the ratio find their neighbours."""
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(8192, 16)), rng.normal(size=(200, 16))
    index = neighbours.Index(x, np.zeros((8192, 0), int), float((x**2).sum(1).max()), 16)
    index.centres = index.lifted(x)
    held = [(i, [int(j)]) for i, row in enumerate(q @ x.T) for j in np.argsort(-row)[:20]]
    ratio = index.ratio_for(q[:100], [h for h in held if h[0] < 100])
    probed = index.probed(q, ratio)
    assert np.mean([lists[0] in probed[i] for i, lists in held if i >= 100]) >= 0.95


def test_lists_are_even():
    points = np.random.default_rng(1).normal(size=(3000, 6))
    centres = neighbours.split_evenly(points, 50)
    assert centres.shape == (50, 6)


def shingles(words):
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def test_leaks_are_those_of_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(3000)]
    items = [(k, rng.choices(vocab, k=rng.choice([1, 4, 5, 6, 14, 30, 45, 60]))) for k in range(60)]
    docs = []
    for d in range(150):
        words = rng.choices(vocab, k=rng.choice([0, 3, 50, 300]))
        if d % 3 == 0:
            item = list(rng.choice(items)[1])
            if d % 2 and len(item) > 20:
                item[rng.choice([0, len(item) - 1])] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = item
        docs.append((d, " ".join(words)))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, ", ".join(w).upper()) for k, w in items], "item_id long, text string")).collect()}
    want = set()
    for d, text in docs:
        words = text.split()
        for k, item in items:
            own = shingles(item)
            for at in range(-2, len(words)):
                a = shingles(words[max(0, at) : max(0, at + len(item))])
                both = sum((a & own).values())
                if both >= 0.8 * (a.total() + own.total() - both):
                    want.add((d, k))
                    break
    assert got <= want and len(want - got) <= len(want) // 50
    assert {(d, k) for d, k in want if all(w in dict(docs)[d] for w in (" ".join(dict(items)[k]),))} <= got


def test_edits_inside_items_are_found(spark):
    """Substitutions, insertions and deletions inside items: the same as brute force, without an allowance."""
    rng = random.Random(3)
    vocab = [f"v{k}" for k in range(3000)]
    items = [rng.choices(vocab, k=rng.choice([50, 75, 100, 150, 300])) for _ in range(40)] + [["so"] * 40 + rng.choices(vocab, k=20)]
    docs, want = [], {}
    for d in range(240):
        k = rng.randrange(len(items))
        leak = list(items[k])
        for _ in range(rng.randrange(1, 2 + len(leak) // 40)):
            at = rng.randrange(5, len(leak) - 5)
            leak[at : at + d % 3 % 2 + (d % 3 == 0)] = [rng.choice(vocab)] * (d % 3 < 2)
        leak = leak[rng.randrange(3) :]
        doc = rng.choices(vocab, k=rng.randrange(40)) + leak + rng.choices(vocab, k=rng.randrange(40))
        docs.append((d, " ".join(doc)))
        own, best = shingles(items[k]), (0.0, 0)
        for at in range(-len(items[k]) // 4, len(doc)):
            a = shingles(doc[max(0, at) : max(0, at + len(items[k]))])
            both = sum((a & own).values())
            best = max(best, (both / (a.total() + own.total() - both), -max(0, at)))
        if best[0] >= 0.8:
            want[d, k] = -best[1], best[0]
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.first_word, r.similarity) for r in found.collect()} == want
    assert len(want) > 100


def test_messy_leaks(spark, messy, nothing):
    items = spark.createDataFrame([(1, "Quick BROWN fox, jumps over the lazy dog"), (1, "Quick BROWN fox, jumps over the lazy dog"), (2, None), (3, ""), (None, "the quick"), (4, "word " * 50)], "item_id long, text string")
    rows = decontamination.contaminated(messy, items).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.first_word) for r in rows) == [(0, 1, 1), (1, 1, 1), (2, 1, 1), (2, 1, 1), (6, 4, 0)]
    assert decontamination.contaminated(nothing, items).count() == 0 and decontamination.contaminated(messy, items.limit(0)).count() == 0


def test_all_prints_within_the_radius_are_found():
    rng = random.Random(4)
    index = decontamination.ItemIndex([(k, " ".join(f"t{rng.randrange(900)}" for _ in range(rng.choice([15, 40])))) for k in range(40)])
    prints = index.prints.copy()
    for k in range(len(prints)):
        for bit in rng.sample(range(64), rng.randrange(8)):
            prints[k] ^= np.uint64(1 << bit)
    for size in range(len(index.shapes)):
        windows, found = index.near(prints, np.full(len(prints), size))
        own = {(w, k) for w, k in zip(windows.tolist(), found.tolist())}
        sizes = np.array([len(index.items[i][1]) for i in index.owner])
        for k in range(len(prints)):
            same = decontamination.fingerprints(decontamination.pair_sums(index.items[index.owner[k]][1]), sizes[k], index.shapes[size][0], 1)
            if len(same) > index.offsets[k] and same[index.offsets[k]] == index.prints[k]:
                assert (k, k) in own


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {r.node: r.comp for r in connected_components(df).collect()} == {k: find(k) for k in root}
    assert connected_components(df.limit(0)).count() == 0


def test_shingles_of_short_texts():
    memo = word_hashes()
    values = np.array([memo[w] for w in (b"a", b"b")], np.uint64)
    assert len(sequence_hashes(values, 5)) == 1 and len(sequence_hashes(values[:0], 5)) == 0
    assert len(LONG) > 100_000
