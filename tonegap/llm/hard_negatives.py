"""Hard negatives by a secondary sort.

Rows are scored against anchors in blocks: both are dealt out to groups of bounded size, and a task multiplies
one group of anchors with one group of rows. A group gives away only what can still be an answer: of each anchor its first
positives, and, once the positives of all groups are known, the first negatives of each positive's window. So
no exchange ever holds all pairs.

What is given away is packed into a binary key (anchor, descending score, kind, id) whose byte order is the order of the
answer. Keys are dealt out by anchor and sorted within partitions, and an iterator walks over them: a positive opens
its window, a negative is emitted for every open window it lies in, and a window closes when it is full or passed. It
holds the open windows of one anchor, at most as many as there are positives, however many rows the anchor has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegap.llm.common import arrow_map, stored

#: Rows and anchors of a group, and anchors multiplied at once.
ROW_BLOCK, ANCHOR_BLOCK, AT_ONCE = 8192, 2048, 256
#: Scores stay below this size, so that percentages of them fit 64 bits; below the second, doubles hold them exactly.
LARGEST, EXACT = 2.0**56, 2.0**53

_SIGN = np.uint64(1 << 63)
_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
POSITIVE, NEGATIVE = 0, 1


def pack_keys(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> list[bytes]:
    """Keys whose byte order is (anchor, score from the largest, kind, id)."""
    out = np.empty(len(ids), _KEY)
    out["anchor"] = anchor.astype(np.int64).view(np.uint64) ^ _SIGN
    out["score"] = ~(score.astype(np.int64).view(np.uint64) ^ _SIGN)
    out["kind"] = kind
    out["id"] = ids.astype(np.int64).view(np.uint64) ^ _SIGN
    raw, width = out.tobytes(), _KEY.itemsize
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def unpack_keys(keys: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, score, kind, id) of packed keys."""
    rows = np.frombuffer(b"".join(keys), _KEY)
    whole = [(rows["anchor"].astype(np.uint64) ^ _SIGN), (~rows["score"].astype(np.uint64)) ^ _SIGN, (rows["id"].astype(np.uint64) ^ _SIGN)]
    anchor, score, ids = (v.view(np.int64).tolist() for v in whole)
    return zip(anchor, score, rows["kind"].tolist(), ids)


def scaled_rows(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, size, vec) of the rows that take part; vec packs floor(scale * x) as 64-bit integers."""

    def make():
        def work(batch):
            at, sizes, vecs = [], [], []
            for i, v in enumerate(batch.column("embedding").to_pylist()):
                if None in v:
                    continue
                x = np.array(v, np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(x * scale)
                if len(x) * np.square(x).max(initial=0.0) < LARGEST:
                    at.append(i)
                    sizes.append(len(x))
                    vecs.append(x.astype("<i8").tobytes())
            return {c: batch.column(c).take(pa.array(at, pa.int64())) for c in ("vec_id", "label")} | {"size": sizes, "vec": pa.array(vecs, pa.binary())}

        return work

    source = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    rows = arrow_map(source, ["vec_id", "label", "embedding"], "vec_id long, label string, size int, vec binary", make)
    one = rows.groupBy("vec_id").agg(F.min(F.struct("size", "vec", "label")).alias("row"))
    return one.select("vec_id", "row.label", "row.size", "row.vec")


def _dealt(rows: DataFrame, groups: int, name: str, other: int, others: str) -> DataFrame:
    """Rows in one of ``groups`` groups by hash of their id, once for each of the ``other`` groups of the other side."""
    own = F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(groups)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(others)
    return rows.select(*[F.col(c).alias(c) for c in rows.columns], own.alias(name), every)  # aliased: both sides may be one table


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group, by score from the largest, then id."""
    order = np.lexsort((ids, -score, group))
    start = np.flatnonzero(np.diff(group[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < most]


def _leading(scores: np.ndarray, wanted: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``most`` wanted cells of each row."""
    lowest = np.iinfo(np.int64).min
    masked = np.where(wanted, scores, lowest)
    k = min(most, masked.shape[1])
    least = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
    i, j = np.nonzero(wanted & (masked >= least[:, None]))
    keep = _first(i, scores[i, j], ids[j], most)
    return i[keep], j[keep]


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all rows of b."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _matrix(table: pa.Table, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("vec").to_pylist()), "<i8").reshape(table.num_rows, size)


def _candidates(rows: DataFrame, anchors: DataFrame, row_groups: int, anchor_groups: int, first: int, low: int, high: int) -> DataFrame:
    """Packed keys of what every pair of groups can add to the answer.

    Positives, if the anchors have no column ``known``; else the negatives in the windows of the scores in it.
    """
    mining = "known" in anchors.columns

    def work(anchor_part: pa.Table, row_part: pa.Table) -> pa.Table:
        keys: list[bytes] = []
        if anchor_part.num_rows and row_part.num_rows:
            size = anchor_part.column("size")[0].as_py()
            ids, anchor_ids = (t.column("vec_id").to_numpy() for t in (row_part, anchor_part))
            named = np.unique(np.array(row_part.column("label").to_pylist() + anchor_part.column("label").to_pylist()), return_inverse=True)[1]
            labels, anchor_labels = named[: len(ids)], named[len(ids) :]
            values, anchor_values = _matrix(row_part, size), _matrix(anchor_part, size)
            known = anchor_part.column("known").to_pylist() if mining else []
            for at in range(0, len(anchor_ids), AT_ONCE):
                own = slice(at, at + AT_ONCE)
                scores = _scores(anchor_values[own], values)
                same = anchor_labels[own, None] == labels[None]
                if not mining:
                    i, j = _leading(scores, same & (anchor_ids[own, None] != ids[None]), ids, first)
                    keys += pack_keys(anchor_ids[own][i], scores[i, j], POSITIVE, ids[j])
                    continue
                opened = known[own]
                met = []
                for n in range(max(map(len, opened))):
                    level = np.array([p[n] if n < len(p) else -1 for p in opened], np.int64)[:, None]
                    inside = ~same & (level >= 0) & (low * level <= 100 * scores) & (100 * scores <= high * level)
                    i, j = _leading(scores, inside, ids, first)
                    met.append(i * len(ids) + j)
                i, j = np.divmod(np.unique(np.concatenate(met)), len(ids))
                keys += pack_keys(anchor_ids[own][i], scores[i, j], NEGATIVE, ids[j])
        return pa.table({"key": pa.array(keys, pa.binary())})

    asked = _dealt(anchors, anchor_groups, "anchor_group", row_groups, "row_group")
    held = _dealt(rows, row_groups, "row_group", anchor_groups, "anchor_group")
    group = ["size", "row_group", "anchor_group"]
    return asked.groupBy(*group).cogroup(held.groupBy(*group)).applyInArrow(work, "key binary")


def _by_anchor(keys: DataFrame) -> DataFrame:
    """The secondary sort: dealt out by anchor, in key order within a partition."""
    return keys.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")


def first_positives(keys: DataFrame, most: int) -> DataFrame:
    """(anchor_id, positive_id, score, key) of the first ``most`` keys of each anchor."""

    def make():
        anchor, n = None, 0

        def work(batch):
            nonlocal anchor, n
            out, raw = [], batch.column("key").to_pylist()
            for key, (a, score, _, i) in zip(raw, unpack_keys(raw)):
                if a != anchor:
                    anchor, n = a, 0
                n += 1
                if n <= most:
                    out.append((a, i, score, key))
            return dict(zip(("anchor_id", "positive_id", "score", "key"), zip(*out))) if out else None

        return work

    return arrow_map(_by_anchor(keys), ["key"], "anchor_id long, positive_id long, score long, key binary", make)


def windowed_negatives(keys: DataFrame, most: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of sorted positives and negatives."""

    def make():
        anchor, windows = None, []

        def work(batch):
            nonlocal anchor, windows
            out = []
            for a, score, kind, i in unpack_keys(batch.column("key").to_pylist()):
                if a != anchor:
                    anchor, windows = a, []
                windows = [w for w in windows if w[2] < most and low * w[1] <= 100 * score]
                if kind == POSITIVE:
                    windows.append([i, score, 0])
                    continue
                for w in windows:
                    if 100 * score <= high * w[1]:
                        w[2] += 1
                        out.append((a, w[0], w[2], i, w[1], score))
            names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
            return dict(zip(names, zip(*out))) if out else None

        return work

    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return arrow_map(_by_anchor(keys), ["key"], schema, make)


def hard_negatives(
    embeddings: DataFrame,
    anchor: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows of ``embeddings`` (vec_id, embedding, label, ...) that ``anchor`` says, by default those whose id is
    divisible by 100. Scores are inner products of floor(``scale`` * x). An anchor's positives are its first rows of its
    label; the negatives of a positive are the first rows of other labels whose score lies between ``low`` and ``high``
    (at most 100) percent of the positive's. Ties go to the smaller id.

    Rows with a null id, label or vector take no part, nor do vectors with null or non-finite components, or with
    components so large that scores leave 56 bits. Vectors meet vectors of their own length only; empty ones score 0. A
    repeated id stands for its smallest vector (then label). An empty table gives no rows; further columns are ignored.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("low and high must be percentages, low first")
    spark = embeddings.sparkSession
    rows = stored(scaled_rows(embeddings, scale), "scaled")
    chosen = rows.filter(F.col("vec_id") % 100 == 0 if anchor is None else anchor)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_groups = max(spread, -(-rows.count() // ROW_BLOCK))
    anchor_groups = max(1, -(-chosen.count() // ANCHOR_BLOCK))
    near = _candidates(rows, chosen, row_groups, anchor_groups, positives, low, high)
    found = stored(first_positives(near, positives), "positives")
    known = found.filter("score >= 0").groupBy("anchor_id").agg(F.collect_list("score").alias("known"))  # at most ``positives`` each
    opened = chosen.join(known.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    between = _candidates(rows, opened, row_groups, anchor_groups, negatives, low, high)
    return windowed_negatives(between.unionByName(found.select("key")), negatives, low, high)
