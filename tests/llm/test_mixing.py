from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tonegap.llm import mixing

SCHEMA = "doc_id long, text string, source string, rate string, copies string, row int"


def shares(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    """Targets by filling up and sharing again, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    rest, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        wanted = {s: rest * weight[s] / total for s in open_}
        above = {s for s in open_ if wanted[s] > most * sizes[s]}
        if not above:
            return target | wanted
        for s in above:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= above
    return target


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = []
    for k in range(6000):
        source = rng.choice(["a", "a", "a", "B", "é", "", None, f"s{rng.randrange(9)}"])
        rows.append((k, " ".join(["w"] * rng.randrange(1, 60)), source, "x", "y", k))
    return spark.createDataFrame(rows, SCHEMA), rows


def test_word_count(spark):
    texts = [None, "", "  ", "a", " a", "a ", "\ta\x0bb\x0cc\rd\ne ", "a b c", "x" * 100_000, " y" * 50_000, "\x1c a"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.n for r in got.select("k", mixing.word_count(F.col("t")).alias("n")).orderBy("k").collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_targets_are_those_of_sharing_again(corpus):
    docs, rows = corpus
    sizes: dict = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(r[1].split())
    plan = mixing.mix_plan(docs).collect()
    want = shares(sizes)
    source = {r[0]: r[2] for r in rows}
    taken: dict = {}
    for r in plan:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s], rel=1e-12)
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        assert int(want[s] / sizes[s]) <= r.copies <= int(want[s] / sizes[s]) + 1
        taken[s] = taken.get(s, 0) + r.taken
    assert len(plan) == len(rows)
    assert any(want[s] == 2 * sizes[s] for s in sizes)
    for s, size in sizes.items():
        assert abs(taken[s] - want[s]) <= 5 * (0.25 * 40 * size) ** 0.5 + 1e-6


def test_reruns_agree_and_the_mix_follows_the_plan(corpus):
    docs, _ = corpus
    first = sorted(map(tuple, mixing.mix_plan(docs).collect()))
    assert first == sorted(map(tuple, mixing.mix_plan(docs.repartition(7)).collect()))
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert counts == {r[0]: r[5] for r in first if r[5]}


def test_many_sources_in_ranges(spark):
    rows = [(k, "w " * (1 + k % 7), f"s{k:05d}", "x", "y", k) for k in range(3000)]
    sized = spark.createDataFrame([(r[2], len(r[1].split())) for r in rows], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    want = shares({r[2]: len(r[1].split()) for r in rows})
    assert got == {s: pytest.approx(t, rel=1e-12) for s, t in want.items()}


def test_infeasible_shares_stop_at_the_cap(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 0), (None, 5)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized, share=9.0).collect()}
    assert got == {"a": 20.0, "b": 0.0, None: 10.0}


def test_odd_rows(messy, nothing, spark):
    docs = messy.withColumn("source", F.when(F.col("doc_id") > 3, "s"))
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == messy.count()
    repeated = [tuple(r) for r in plan if r.doc_id == 2]
    assert len(repeated) == 2 and len(set(repeated)) == 1
    assert all(r.taken == 0 for r in plan if r.size == 0)
    assert mixing.mix_plan(nothing.withColumn("source", F.lit("s"))).collect() == []
    assert mixing.mixed(nothing.withColumn("source", F.lit("s"))).collect() == []
    blank = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.mix_plan(blank).collect()) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]
    assert mixing.mixed(blank).collect() == []
