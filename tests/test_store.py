from __future__ import annotations

import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tonegap.sources import store as S


def frame(spark, rows):
    return spark.createDataFrame(rows, "post_id string, v int")


def content(store, version=None):
    return sorted(map(tuple, store.read(version).collect()), key=str)


def data_files(path):
    """Bucket folders with their files and times."""
    found = {}
    for folder, _, names in os.walk(f"{path}/data"):
        for n in names:
            if n.endswith(".parquet"):
                found[f"{folder}/{n}"] = os.stat(f"{folder}/{n}").st_mtime_ns
    return found


def test_a_small_batch_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    store = S.KeyedStore(spark, path, buckets=256)
    store.upsert(frame(spark, [(f"k{i}", 0) for i in range(5000)]))
    before, first = data_files(path), store.manifest()
    ids = [f"k{i}" for i in range(40, 60)]
    store.upsert(frame(spark, [(k, 1) for k in ids]))
    after, second = data_files(path), store.manifest()
    assert {f: t for f, t in after.items() if f in before} == before  # nothing rewritten
    touched = {b for b in second.deltas if second.deltas[b] != first.deltas.get(b)}
    assert 0 < len(touched) <= len(ids) and len(after) - len(before) == len(touched)
    assert content(store) == sorted([(f"k{i}", int(40 <= i < 60)) for i in range(5000)], key=str)
    assert content(store, 1) == sorted([(f"k{i}", 0) for i in range(5000)], key=str)


def test_untouched_buckets_are_read_without_a_shuffle(spark, tmp_path):
    store = S.KeyedStore(spark, str(tmp_path / "t"), buckets=16)
    store.upsert(frame(spark, [(f"k{i}", 0) for i in range(200)]))
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_many_batches_are_a_dictionary(spark, tmp_path, monkeypatch):
    """Random batches with repeated and null keys, compacted on the way."""
    monkeypatch.setattr(S, "MOST_DELTAS", 3)
    monkeypatch.setattr(S.KeyedStore.compact, "__defaults__", (3,))
    rng, want, nulls = random.Random(8), {}, []
    store = S.KeyedStore(spark, str(tmp_path / "t"), buckets=4)
    for n in range(7):
        rows = [(rng.choice([None, *"abcdefghij"]), 10 * n + k) for k in range(rng.choice([1, 4, 9]))]
        store.upsert(frame(spark, rows))
        new: dict = {}
        for k, v in rows:
            if k is None:
                nulls.append((None, v))
            else:
                new.setdefault(k, []).append((k, v))
        want |= new
        assert content(store) == sorted([r for rows in want.values() for r in rows] + nulls, key=str)
    assert max(map(len, store.manifest().deltas.values())) <= 3


def test_two_writers_never_take_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    S.KeyedStore(spark, path, buckets=4).upsert(frame(spark, [("a", 0)]))
    late = S.KeyedStore(spark, path)
    real, raced = late.files.create, []

    def slow(name, text):
        if not raced:  # another writer is first
            raced.append(S.KeyedStore(spark, path).upsert(frame(spark, [("a", 1), ("b", 1)])))
        return real(name, text)

    late.files.create = slow
    assert late.upsert(frame(spark, [("b", 2)])) == 3 and raced == [2]
    assert content(late) == [("a", 1), ("b", 2)]
    assert not late.files.create(f"{path}/manifests/v-00000002.json", "{}") and content(late, 2) == [("a", 1), ("b", 1)]
    assert not [n for n in late.files.names(f"{path}/manifests") if n.startswith(".") and not n.endswith(".crc")]


def test_writers_side_by_side(spark, tmp_path):
    path = str(tmp_path / "t")
    S.KeyedStore(spark, path, buckets=4).upsert(frame(spark, [("z", -1)]))
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: S.KeyedStore(spark, path).upsert(frame(spark, [(f"k{n}", n)])), range(4)))
    assert sorted(got) == [2, 3, 4, 5]
    assert content(S.KeyedStore(spark, path)) == sorted([("z", -1), *[(f"k{n}", n) for n in range(4)]])


def test_a_batch_sent_again_changes_nothing(spark, tmp_path):
    store = S.KeyedStore(spark, str(tmp_path / "t"))
    store.upsert(frame(spark, [("a", 0)]), "stream", 0)
    store.upsert(frame(spark, [("a", 1)]), "stream", 1)
    assert store.upsert(frame(spark, [("a", 0)]), "stream", 0) == 2
    assert store.upsert(frame(spark, [("a", 7)]), "stream", 1) == 2
    assert content(store) == [("a", 1)]
    assert store.upsert(frame(spark, [("a", 2)]), "other", 0) == 3


def test_a_compaction_keeps_what_came_meanwhile(spark, tmp_path):
    path = str(tmp_path / "t")
    store = S.KeyedStore(spark, path, buckets=1)
    for n in range(4):
        store.upsert(frame(spark, [("a", n), (f"k{n}", n)]))
    late = S.KeyedStore(spark, path)
    real = late._write
    late._write = lambda *a: [real(*a), store.upsert(frame(spark, [("a", 9)]))][0]
    assert late.compact(2) == 6
    assert content(store) == [("a", 9), ("k0", 0), ("k1", 1), ("k2", 2), ("k3", 3)]
    assert len(store.manifest().deltas["0"]) == 2 and store.compact(2) is None


def test_vacuum_deletes_what_no_kept_version_lists(spark, tmp_path):
    path = str(tmp_path / "t")
    store = S.KeyedStore(spark, path, buckets=1)
    for n in range(4):
        store.upsert(frame(spark, [("a", n)]))
    store.compact(2)
    assert store.vacuum(2) == 0  # version 4 still lists all deltas
    assert store.vacuum(1) == 4 and store.versions() == [5] and content(store) == [("a", 3)]
    assert len(data_files(path)) == 1


def test_empty_batches_and_wrong_columns(spark, tmp_path):
    store = S.KeyedStore(spark, str(tmp_path / "t"))
    assert store.read() is None and store.manifest() is None and store.compact() is None
    store.upsert(frame(spark, []))
    assert store.read().columns == ["post_id", "v"] and content(store) == []
    store.upsert(frame(spark, [("a", 1)]).select("v", "post_id"))
    assert content(store) == [("a", 1)]
    with pytest.raises(ValueError, match="columns"):
        store.upsert(frame(spark, [("a", 1)]).withColumn("w", F.lit(1)))
