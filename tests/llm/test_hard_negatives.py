from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegap.llm import hard_negatives as H


def brute(rows, every=100, most=5, low=80, high=100):
    """All answers by sorting all rows for each anchor."""
    usable = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.setdefault(i, (tuple(math.floor(256 * x) for x in v), label))
    out = set()
    for a, (va, la) in usable.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, lab) for i, (v, lab) in usable.items() if i != a and len(v) == len(va))
        for s, p, _ in [x for x in scored if x[2] == la][:most]:
            fits = [x for x in scored if x[2] != la and low * -s <= 100 * -x[0] <= high * -s][:most]
            out |= {(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fits)}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = []
    for k in range(900):
        v = centres[k % 6] + rng.normal(scale=0.6, size=8)
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(0, 4))))
    same = [0.5] * 8
    return rows + [(1000 + k, same, k % 3) for k in range(200)]  # ties, and a group of copies


def test_is_brute_force(spark, crowd):
    got = H.hard_negatives(frame(spark, crowd))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(crowd) and rows


def test_groups_of_any_size_give_the_same(spark, crowd, monkeypatch):
    monkeypatch.setattr(H, "ROW_BLOCK", 37)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(H, "AT_ONCE", 2)
    got = H.hard_negatives(frame(spark, crowd), anchor=F.col("vec_id") % 50 == 0, positives=3, negatives=3, low=70, high=95)
    assert {tuple(r) for r in got.collect()} == brute(crowd, 50, 3, 70, 95)


def test_key_order_is_answer_order():
    rng = np.random.default_rng(1)
    rows = [(int(a), int(s), k, int(i)) for a, s, k, i in zip(rng.integers(-3, 3, 300), rng.integers(-9, 9, 300), rng.integers(0, 2, 300), rng.integers(-99, 99, 300))]
    rows.append((-(2**62), 2**55, 0, 2**63 - 1))
    keys = [H.pack_keys(np.array([a]), np.array([s]), k, np.array([i]))[0] for a, s, k, i in rows]
    order = sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))
    assert list(H.unpack_keys(sorted(keys))) == order


def test_a_window_outlives_batches(spark):
    """One anchor's rows come in many Arrow batches; state is the open windows only."""
    rows = [(0, [1.0], 0), (100_001, [1.0], 0)] + [(k, [0.9], 1) for k in range(1, 5001)]
    got = H.hard_negatives(frame(spark, rows), anchor=F.col("vec_id") == 0, negatives=4000)
    assert sorted(r.negative_id for r in got.collect()) == list(range(1, 4001))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1),
        (1, [1.0, 0.0], 1),
        (2, [0.9, 0.1], 2),
        (2, [0.9, 0.1], 2),
        (3, None, 1),
        (4, [1.0, None], 1),
        (5, [nan, 1.0], 1),
        (6, [inf, 1.0], 2),
        (7, [1.0, 0.0], None),
        (None, [1.0, 0.0], 2),
        (8, [0.9], 2),
        (9, [], 2),
        (100, [], 2),
        (200, [1.0], 2),
        (300, [-1.0, 0.0], 1),
        (10, [1e30, 0.0], 2),
        (11, [1e5, 1e5], 2),
    ]
    data = frame(spark, rows)
    crowded = data.select("*", *[F.lit(1).alias(c) for c in ("key", "size", "vec", "row_group", "known", "score")])
    got = {tuple(r) for r in H.hard_negatives(crowded).collect()}
    assert got == brute([r for r in rows if r[0] != 10]) and (0, 1, 1, 2, 65536, 230 * 256) in got
    assert H.hard_negatives(data.limit(0)).collect() == []
    with pytest.raises(ValueError):
        H.hard_negatives(data, low=90, high=50)
