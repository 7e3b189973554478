"""Approximate nearest neighbours by inner product: balanced posting lists under a graph of centroids.

Vectors get one more coordinate that brings them to the same length, so the largest inner product is
the smallest distance. Centroids come from splitting a bounded sample in two until the lists are even.
A graph that joins each centroid with its nearest ones is searched with a beam for the vectors to be
filed; queries are compared with all centroids. A vector near a boundary is filed in several lists: those whose centroid
is hardly farther than the nearest one's and not next to a list it is already in. A query reads all
lists whose centroid is within a ratio of the distance to its eighth nearest one, however many these are. The
ratio is fitted on sampled queries, whose answers are known by brute force, so that they find their share. Its eight nearest lists are read
first; what they give bounds the score an answer must have, and the other lists give away only what reaches it.

Equal vectors are one entry with as many of its smallest ids as an answer can show, and equal
queries are searched once, so copies make no list longer. Lists and their queries are cut into
blocks, and a task multiplies block by block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegap.llm.common import arrow_map, stored

#: Entries the centroids are fitted on, entries a list should hold, lists at most.
FIT_ENTRIES, LIST_SIZE, MOST_LISTS = 20_000, 64, 8192
#: Edges of a centroid to its nearest ones, and to random ones.
NEAR_EDGES, FAR_EDGES = 24, 4
#: Beam width and lists of an entry, its distance ratio, and the share of an entry's squared distance to a list
#: that this list must at least lie away from those it is in.
FILE_BEAM, FILE_LISTS, FILE_RATIO, FILE_APART = 24, 3, 1.2, 0.1
#: The nearest centroid whose distance a query's ratio refers to, queries the ratio is fitted on, and the share of
#: their neighbours that must be found.
QUERY_RANK, FIT_QUERIES, FIT_RECALL = 8, 400, 0.98
#: Entries or queries in a block.
BLOCK = 512


def split_evenly(points: np.ndarray, lists: int, seed: int = 4) -> np.ndarray:
    """Centroids of ``lists`` groups of nearly equal size, by halving along the line of two means."""
    rng = np.random.default_rng(seed)
    groups, out = [(points, lists)], []
    while groups:
        own, k = groups.pop()
        if k <= 1 or len(own) < 2:
            out.append(own.mean(0))
            continue
        a, b = own[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            side = ((own - a) ** 2).sum(1) - ((own - b) ** 2).sum(1)
            order = np.argsort(side, kind="stable")
            half = len(own) * (k // 2) // k or 1
            a, b = own[order[:half]].mean(0), own[order[half:]].mean(0)
        groups += [(own[order[:half]], k // 2), (own[order[half:]], k - k // 2)]
    return np.array(out)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


@dataclass
class Index:
    """Centroids, their graph, the common squared length and the number of coordinates."""

    centres: np.ndarray
    edges: np.ndarray
    length2: float
    size: int

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Entries with the coordinate that brings them to the common length."""
        rest = np.sqrt(np.maximum(self.length2 - (x**2).sum(1), 0))
        return np.c_[x, rest] / np.sqrt(self.length2)

    def levelled(self, q: np.ndarray) -> np.ndarray:
        """Queries scaled to unit length, with nothing in the added coordinate; their order of answers stays."""
        q = q / np.abs(q).max(1, keepdims=True)
        return np.c_[q / np.sqrt((q**2).sum(1, keepdims=True)), np.zeros(len(q))]

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) by distance: a beam over the graph, for many vectors at once."""
        n, k = len(x), len(self.centres)
        beam = min(beam, k)
        own = (self.centres**2).sum(1)
        base = (x**2).sum(1)
        met = np.zeros((n, k), bool)
        start = np.unique(np.linspace(0, k - 1, min(k, beam)).astype(int))
        ids = np.tile(start, (n, 1))
        dist = np.maximum(base[:, None] + own[ids] - 2 * x @ self.centres[start].T, 0)
        met[:, start] = True
        done = np.zeros(ids.shape, bool)
        rows = np.arange(n)[:, None]
        while True:
            wait = np.where(done, np.inf, dist)
            step = np.argpartition(wait, min(3, wait.shape[1] - 1), axis=1)[:, :4]
            if not np.isfinite(np.take_along_axis(wait, step, 1)).any():
                break
            open_ = np.isfinite(np.take_along_axis(wait, step, 1))
            np.put_along_axis(done, step, True, 1)
            near = self.edges[np.take_along_axis(ids, step, 1)].reshape(n, -1)
            new = ~met[rows, near] & np.repeat(open_, self.edges.shape[1], 1)
            order = np.sort(np.where(new, near, k), 1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = k
            width = int((order < k).sum(1).max(initial=0))
            if not width:
                continue
            near = np.sort(order, 1)[:, :width]
            real = near < k
            near = np.where(real, near, 0)
            r, c = np.nonzero(real)
            met[r, near[r, c]] = True
            d = np.full(near.shape, np.inf)
            d[r, c] = np.maximum(base[r] + own[near[r, c]] - 2 * np.einsum("ij,ij->i", x[r], self.centres[near[r, c]]), 0)
            ids, dist, done = np.c_[ids, near], np.c_[dist, d], np.c_[done, ~real]
            if ids.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, done = (np.take_along_axis(v, keep, 1) for v in (ids, dist, done))
        order = np.argsort(dist, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def filed(self, x: np.ndarray) -> list[list[int]]:
        """The lists of each entry: the nearest, and others over the boundary."""
        ids, dist = self.search(self.lifted(x), FILE_BEAM)
        out = []
        for row, d in zip(ids, np.sqrt(dist)):
            chosen: list[int] = []
            for c, far in zip(row, d):
                if not np.isfinite(far) or far > FILE_RATIO * d[0] + 1e-12 or len(chosen) == FILE_LISTS:
                    break
                if all(((self.centres[c] - self.centres[o]) ** 2).sum() >= FILE_APART * far * far for o in chosen):
                    chosen.append(int(c))
            out.append(chosen)
        return out

    def ratios(self, q: np.ndarray) -> np.ndarray:
        """Distance of each query to each centroid, over that to its ``QUERY_RANK``-th nearest."""
        d = np.sqrt(squared(self.levelled(q), self.centres))
        rank = min(QUERY_RANK, d.shape[1]) - 1
        return d / np.maximum(np.partition(d, rank, axis=1)[:, rank, None], 1e-12)

    def probed(self, q: np.ndarray, ratio: float) -> list[np.ndarray]:
        """The lists each query reads: all within the ratio."""
        return [np.flatnonzero(near) for near in self.ratios(q) <= ratio + 1e-9]

    def probed_apart(self, q: np.ndarray, ratio: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same lists in two parts: the nearest ones, up to the rank that the ratio refers to, and the others."""
        rows = self.ratios(q)
        return [(np.flatnonzero(r <= 1 + 1e-9), np.flatnonzero((r > 1 + 1e-9) & (r <= ratio + 1e-9))) for r in rows]

    def ratio_for(self, q: np.ndarray, held: list[tuple[int, list[int]]], recall: float = FIT_RECALL) -> float:
        """The least ratio, from 1, that reads a list of ``recall`` of the neighbours, given as (query, its lists)."""
        ratios = self.ratios(q)
        wanted = [ratios[i, lists].min() for i, lists in held]
        return max(1.0, float(np.quantile(wanted, recall, method="higher"))) if wanted else 1.0


def build_index(sample: np.ndarray, entries: int, length2: float, seed: int = 6) -> Index:
    """Fit centroids on a sample of the entries and join them to a graph."""
    index = Index(np.zeros((0, 0)), np.zeros((0, 0), int), length2, sample.shape[1])
    lists = int(min(MOST_LISTS, max(1, entries // LIST_SIZE), len(sample)))
    centres = split_evenly(index.lifted(sample), lists)
    near = min(NEAR_EDGES + 1, len(centres))
    edges = np.concatenate(
        [np.argpartition(squared(centres[i : i + 1024], centres), near - 1, axis=1)[:, :near] for i in range(0, len(centres), 1024)]
    )
    far = np.random.default_rng(seed).integers(0, len(centres), (len(centres), FAR_EDGES))
    return Index(centres, np.c_[edges, far], length2, sample.shape[1])


def entries_of(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec) of the vectors that take part, as packed doubles; one row per id."""

    def make():
        def work(batch):
            ids, vecs = [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                if v and None not in v:
                    x = np.array(v, np.float64) + 0.0
                    if np.isfinite(x).all() and x.any():
                        ids.append(i)
                        vecs.append(x.tobytes())
            return {"vec_id": ids, "vec": pa.array(vecs, pa.binary())}

        return work

    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id IS NOT NULL")
    rows = arrow_map(source, ["vec_id", "embedding"], "vec_id long, vec binary", make)
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """Rows (list, key, vec, ...) as blocks (list, rows)."""
    sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    members = F.struct(*[c for c in rows.columns if c != "list"])
    packed = rows.join(sizes, "list").groupBy("list", block.alias("block")).agg(F.collect_list(members).alias("rows"))
    return packed.select("list", F.col("rows").alias(name))


def inner_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All inner products, each summed from the first coordinate to the last in double precision."""
    out = np.zeros((len(q), len(v)))
    for j in range(q.shape[1]):
        out += q[:, j, None] * v[None, :, j]
    return out


def _fitted_ratio(index: Index, tried: list, entries: DataFrame, filed: DataFrame, top: int) -> float:
    """The ratio by which the queries (key, vec) of ``tried`` find their share of what brute force finds."""
    if not tried:
        return 1.0
    keys, size = [r.key for r in tried], index.size
    q = np.stack([np.frombuffer(r.vec, np.float64) for r in tried])

    def make():
        best = np.full((len(q), top + 1), -np.inf)  # of this task so far

        def work(batch):
            nonlocal best
            scores = q @ np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float64).reshape(-1, size).T
            best = np.sort(np.c_[best, scores], axis=1)[:, -top - 1 :]
            i, j = np.nonzero(scores >= best[:, :1])
            return {"i": pa.array(i), "key": batch.column("key").take(pa.array(j)), "score": pa.array(scores[i, j])}

        return work

    by_score = Window.partitionBy("i").orderBy(F.desc("score"), "key")
    found = arrow_map(entries, ["key", "vec"], "i int, key long, score double", make)
    found = found.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= top + 1).select("i", "key")
    held: dict[tuple[int, int], list[int]] = {}
    for r in found.join(filed.select("key", "list"), "key").collect():
        if r.key != keys[r.i]:
            held.setdefault((r.i, r.key), []).append(r.list)
    return index.ratio_for(q, [(i, lists) for (i, _), lists in held.items()])


def nearest(embeddings: DataFrame, every: int = 20, top: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest found for each id divisible by ``every``.

    Null, empty and zero vectors and those with null or non-finite components take no part, nor do rows without id. An id that
    is given several times stands for its smallest vector. Vectors of another length
    than the most frequent one take no part. Ties go to the smaller vec_id. With fewer than ``top``
    candidates all that were found are returned; an empty table gives no rows; further columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = stored(entries_of(embeddings), "vectors")
    common = rows.groupBy(F.octet_length("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not common:
        return empty
    size = common[0].n // 8
    rows = rows.filter(F.octet_length("vec") == size * 8)
    place = Window.partitionBy("vec").orderBy("vec_id")
    entries = stored(
        rows.withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= top + 1)
        .groupBy("vec")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("key", F.col("ids")[0]),
        "entries",
    )

    def lengths():
        def work(batch):
            x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float64).reshape(-1, size)
            return {"length2": [(x**2).sum(1).max()], "n": [len(x)]}

        return work

    whole = arrow_map(entries, ["vec"], "length2 double, n long", lengths).agg(F.max("length2"), F.sum("n")).first()
    sample = entries.orderBy(F.xxhash64("vec"), "key").limit(FIT_ENTRIES).select("vec").collect()
    fitted = build_index(np.stack([np.frombuffer(r.vec, np.float64) for r in sample]), whole[1], whole[0])
    shipped = spark.sparkContext.broadcast(fitted)  # at most MOST_LISTS centroids and their edges

    def placed(df: DataFrame, name: str, place, *columns: str) -> DataFrame:
        """(key, vec) and the lists that ``place`` names for them, in one column or several."""

        def make():
            index = shipped.value

            def work(batch):
                x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float64).reshape(-1, size)
                lists = [c for i in range(0, len(x), 256) for c in place(index, x[i : i + 256])]
                return {c: batch.column(c) for c in ("key", "vec")} | dict(zip(columns, zip(*lists)))

            return work

        schema = ", ".join(f"{c} array<int>" for c in columns) + ", key long, vec binary"
        return stored(arrow_map(df, ["key", "vec"], schema, make), name)

    asked = rows.filter(F.col("vec_id") % every == 0)
    queries = stored(asked.groupBy("vec").agg(F.min("vec_id").alias("key")), "queries")
    filed = placed(entries, "lists", lambda index, x: [(c,) for c in index.filed(x)], "lists").select(F.explode("lists").alias("list"), "key", "vec")
    tried = queries.orderBy(F.xxhash64("key", F.lit("tried")), "key").limit(FIT_QUERIES).collect()
    ratio = _fitted_ratio(fitted, tried, entries, filed, top)
    probed = placed(queries, "probes", lambda index, x: index.probed_apart(x, ratio), "near", "far")
    held = stored(_blocks(filed, "held"), "held")

    def scan():
        def unpack(block):
            return np.array([r["key"] for r in block]), np.frombuffer(b"".join(r["vec"] for r in block), np.float64).reshape(-1, size)

        def work(batch):
            q_out, k_out, s_out = [], [], []
            for asking, held in zip(batch.column("asking").to_pylist(), batch.column("held").to_pylist()):
                (qk, q), (vk, v) = unpack(asking), unpack(held)
                least = np.array([r["bound"] for r in asking])
                order = np.argsort(vk)
                vk, scores = vk[order], inner_products(q, v[order])
                best = np.argsort(-scores, axis=1, kind="stable")[:, : top + 1]
                found = np.take_along_axis(scores, best, 1)
                i, j = np.nonzero(found >= least[:, None])
                q_out.append(qk[i])
                k_out.append(vk[best[i, j]])
                s_out.append(found[i, j])
            return {"q": pa.array(np.concatenate(q_out)), "key": pa.array(np.concatenate(k_out)), "score": pa.array(np.concatenate(s_out))}

        return work

    def search(asking: DataFrame) -> DataFrame:
        pairs = _blocks(asking, "asking").join(held, "list")
        return arrow_map(pairs, ["asking", "held"], "q long, key long, score double", scan)

    no_bound = F.lit(float("-inf"))
    by_rank = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    nearby = search(probed.select(F.explode("near").alias("list"), "key", "vec", no_bound.alias("bound")))
    first = nearby.distinct().withColumn("place", F.row_number().over(by_rank)).filter(F.col("place") <= top + 1)
    first = stored(first.select("q", "key", "score", "place"), "nearby")
    bounds = first.filter(F.col("place") == top + 1).select(F.col("q").alias("key"), F.col("score").alias("bound"))
    farther = probed.join(bounds, "key", "left").select(F.explode("far").alias("list"), "key", "vec", F.coalesce("bound", no_bound).alias("bound"))
    found = first.select("q", "key", "score").unionByName(search(farther))
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    best = (
        found.distinct()  # an entry in several lists
        .withColumn("place", F.row_number().over(by_score))
        .filter(F.col("place") <= top + 1)
        .join(entries.select("key", "ids"), "key")
        .select("q", "score", F.explode("ids").alias("vec_id"))
    )
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    answers = (
        best.withColumn("place", F.row_number().over(by_score))
        .filter(F.col("place") <= top + 1)
        .groupBy("q")
        .agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
        .join(queries.withColumnRenamed("key", "q"), "q")
        .select("vec", "found")
    )
    mine = asked.select(F.col("vec_id").alias("query_id"), "vec").join(answers, "vec")
    others = F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, top)
    return mine.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
