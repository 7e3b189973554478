"""Near duplicates by HyperMinHash signatures, banding, estimation and exact verification.

A document's set holds the hashes of its word shingles. Each hash falls into one of ``REGISTERS``
buckets; a bucket keeps of its smallest value the number of leading zeros and ten mantissa bits, a
16-bit register. Empty buckets of small sets borrow from another bucket in an order fixed per
bucket, which keeps the chance of agreement at the Jaccard similarity. Runs of ``ROWS`` registers
form ``BANDS`` bands; sets that agree on a band are candidates. With 5 rows and 32 bands a pair of
similarity 0.8 is missed with probability 3e-6. A candidate stays if its similarity, estimated from
the registers and corrected for chance collisions, is within ``SLACK`` standard errors of the
threshold, and counts as a link only when the full sets confirm it. The estimate counts a set's own
registers only, not borrowed ones.

Hot groups: equal sets are one node. Inside a bucket first only its smallest node is compared with
the others, then a node that differs by band, each time leaving out what components already
join; last, buckets that still hold several components are compared block by block across
components, and what an estimate can't rule out there is verified where it is found. No step lists all
pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegap.llm.common import U64, arrow_map, mix, shingle_set, stored, word_hashes
from tonegap.llm.components import connected_components

ROWS, BANDS = 5, 32
#: Registers of a signature; the bands use the first of them, the estimate uses all.
REGISTERS = 2 * ROWS * BANDS
MANTISSA_BITS = 10
VALUE_BITS = 56
#: Standard errors below the threshold at which an estimate still leads to verification.
SLACK = 4.5
#: Members of a bucket that are compared at once with as many others.
BLOCK = 256
#: Fixed value of the published estimate of chance collisions of these registers.
COLLISION_FACTOR = 0.169919487159739

_BORROW = np.stack([np.random.default_rng(7000 + b).permutation(REGISTERS) for b in range(REGISTERS)])


def registers(values: np.ndarray) -> np.ndarray:
    """The 16-bit registers of a set of hashes, before borrowing; 0 marks an empty bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(values):
        return out
    bucket = ((values >> U64(32)) * U64(REGISTERS)) >> U64(32)
    keyed = np.sort((bucket << U64(VALUE_BITS)) | (mix(values ^ U64(0x5851F42D4C957F2D)) >> U64(64 - VALUE_BITS)))
    bucket = (keyed >> U64(VALUE_BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    share, exponent = np.frexp((keyed[first] & U64((1 << VALUE_BITS) - 1)).astype(np.float64))
    zeros = np.clip(VALUE_BITS - exponent, 0, 62)
    mantissa = np.clip((share * 2 - 1) * (1 << MANTISSA_BITS), 0, (1 << MANTISSA_BITS) - 1).astype(np.int64)
    out[bucket[first]] = ((zeros + 1) << MANTISSA_BITS) | mantissa
    return out


def borrowed(regs: np.ndarray) -> np.ndarray:
    """Registers with empty buckets filled from the first full bucket of their own order."""
    empty = np.flatnonzero(regs == 0)
    if len(empty) in (0, REGISTERS):
        return regs
    out = regs.copy()
    order = _BORROW[empty]
    out[empty] = regs[order[np.arange(len(empty)), (regs != 0)[order].argmax(1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """The BANDS keys of the rows of (borrowed) registers of a set."""
    parts = regs[: BANDS * ROWS].astype(U64).reshape(BANDS, ROWS)
    out = np.zeros(BANDS, U64)
    for j in range(ROWS):
        out = mix(out * U64(0x9E3779B97F4A7C15) + parts[:, j] + U64(1))
    return out


def unpacked(column: pa.Array, kind=np.uint16) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def passes(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs with such registers and set sizes may reach the threshold.

    Similarity is the share of equal registers among those that either set fills, less the expected
    chance collisions. Its standard error is that of as many draws from the union without return.
    """
    agree = ((ra == rb) & (ra != 0)).sum(1)
    filled = np.maximum(((ra != 0) | (rb != 0)).sum(1), 1)
    low, high = np.minimum(na, nb).astype(float), np.maximum(na, nb).astype(float)
    ratio = high / np.maximum(low, 1)
    chance = np.minimum(COLLISION_FACTOR * filled / (1 << MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2, filled - 0.5)
    estimate = (agree - chance) / (filled - chance)
    goal = percent / 100
    union = np.maximum((low + high) / (1 + goal), filled)
    error = np.sqrt(goal * (1 - goal) * np.maximum(1 / filled - 1 / union, 0.02 / filled))
    return (estimate >= goal - SLACK * error - 1 / filled) & (100 * low >= percent * high)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, node, regs, keys) per row; node is a 128-bit digest of the set, null if it is empty."""

    def make():
        memo = word_hashes()

        def work(batch: pa.RecordBatch):
            sizes, nodes, regs, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                values = shingle_set(text, words, memo)
                sizes.append(len(values))
                nodes.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                own = registers(values)
                regs.append(own.tobytes() if len(values) else None)
                keys.append(band_keys(borrowed(own)).tobytes() if len(values) else None)
            return {"doc_id": batch.column("doc_id"), "n_shingles": sizes, "node": nodes, "regs": regs, "keys": keys}

        return work

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(source, ["doc_id", "text"], "doc_id long, n_shingles long, node binary, regs binary, keys binary", make)


def _bands(nodes: DataFrame) -> DataFrame:
    """A row (band, key, node, n) for each node and band."""

    def make():
        def work(batch: pa.RecordBatch):
            keys = unpacked(batch.column("keys"), np.int64)
            take = pa.array(np.repeat(np.arange(len(keys)), BANDS))
            return {c: batch.column(c).take(take) for c in ("node", "n")} | {
                "band": pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))),
                "key": pa.array(keys.ravel()),
            }

        return work

    return arrow_map(nodes, ["node", "n", "keys"], "band int, key long, node binary, n long", make)


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose corrected estimate does not rule them out."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}"))

    def make():
        def work(batch: pa.RecordBatch):
            ra, rb = unpacked(batch.column("ra")), unpacked(batch.column("rb"))
            keep = passes(ra, rb, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent)
            return {c: batch.column(c).filter(pa.array(keep)) for c in ("a", "b")}

        return work

    return arrow_map(
        pairs.join(side("a"), "a").join(side("b"), "b"), ["a", "b", "na", "nb", "ra", "rb"], "a binary, b binary", make
    )


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, from the row whose id the node bears."""
    ids = nodes.select("node", "doc_id").join(wanted, "node", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(ids, "doc_id").select("node", "text")


def _same(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold, with the sets computed from the whole texts."""
    texts = _texts(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())

    def make():
        memo, sets = word_hashes(), {}

        def known(node, text):
            if node not in sets:
                if len(sets) >= 64:
                    sets.clear()
                values = shingle_set(text, words, memo)
                right = xxhash.xxh3_128_digest(values.tobytes()) == node
                sets[node] = values if right else None
            return sets[node]

        def work(batch: pa.RecordBatch):
            keep = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
                sa, sb = known(a, ta), known(b, tb)
                if sa is None or sb is None:  # another row of the same id
                    keep.append(False)
                    sets.pop(a, None), sets.pop(b, None)
                    continue
                keep.append(_same(sa, sb, percent))
            return {c: batch.column(c).filter(pa.array(keep)) for c in ("a", "b")}

        return work

    joined = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    )
    return arrow_map(joined, ["a", "b", "ta", "tb"], "a binary, b binary", make)


def _crowded(nodes: DataFrame) -> DataFrame:
    """(band, key, node, n, members) of the buckets with several nodes."""
    bands = _bands(nodes)
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("members")).filter(F.col("members") > 1)
    return bands.join(shared, ["band", "key"])


def _led_pairs(crowd: DataFrame, percent: int, by_band: bool) -> DataFrame:
    """Pairs of a bucket's leader with the members of other components that the sizes allow."""
    order = F.xxhash64("node", "band") if by_band else F.lit(0).cast("long")
    buckets = (
        crowd.groupBy("band", "key")
        .agg(
            F.min(F.struct(order.alias("o"), F.col("node").alias("node"), F.col("n").alias("n"), F.col("comp").alias("comp"))).alias("lead"),
            F.min("comp").alias("c0"),
            F.max("comp").alias("c1"),
        )
        .filter(F.col("c0") != F.col("c1"))
        .select("band", "key", "lead")
    )
    least, most = F.least("n", "lead.n"), F.greatest("n", "lead.n")
    return (
        crowd.join(buckets, ["band", "key"])
        .filter((F.col("comp") != F.col("lead.comp")) & (100 * least >= percent * most))
        .select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
        .distinct()
    )


def _crossing_links(crowd: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links (a, b) between components that share a bucket, compared block by block.

    A pair of several common bands is looked at in the first of them only. Within a pair of blocks,
    links that join nothing new are left out.
    """
    by_comp = crowd.groupBy("band", "key", "members", "comp").count()
    buckets = (
        by_comp.groupBy("band", "key", "members")
        .agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("count", "comp")).alias("main"))
        .filter(F.col("comps") > 1)
        .select("band", "key", "main")
    )
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK))
    blocks = stored(
        crowd.join(buckets, ["band", "key"])
        .join(nodes.select("node", "regs", "keys"), "node")
        .groupBy("band", "key", (F.col("comp") == F.col("main")).alias("in_main"), block.alias("block"))
        .agg(F.collect_list(F.struct("node", "comp", "n", "regs", "keys")).alias("rows")),
        "blocks",
    )
    left = blocks.filter(~F.col("in_main")).select("band", "key", F.col("block").alias("lb"), F.col("rows").alias("left"))
    right = blocks.select("band", "key", "in_main", F.col("block").alias("rb"), F.col("rows").alias("right"))
    paired = left.join(right, ["band", "key"]).filter(F.col("in_main") | (F.col("lb") <= F.col("rb")))

    def compare():
        def unpack(rows):
            regs, keys = (np.frombuffer(b"".join(r[c] for r in rows), k).reshape(len(rows), -1) for c, k in (("regs", np.uint16), ("keys", np.int64)))
            return [r["node"] for r in rows], np.array([r["comp"] for r in rows], object), np.array([r["n"] for r in rows]), regs, keys

        def work(batch: pa.RecordBatch):
            out = {c: [] for c in ("band", "key", "lb", "rb", "node", "comp", "partners")}
            for band, key, lb, rb, lrows, rrows in zip(*(batch.column(c).to_pylist() for c in ("band", "key", "lb", "rb", "left", "right"))):
                nodes_l, comps_l, nl, rl, kl = unpack(lrows)
                nodes_r, comps_r, nr, rr, kr = unpack(rrows)
                met: dict[bytes, tuple] = {}
                for i in range(len(nodes_l)):
                    ok = np.flatnonzero(comps_r != comps_l[i])
                    ok = ok[passes(rl[i][None], rr[ok], np.full(len(ok), nl[i]), nr[ok], percent)]
                    ok = ok[(kl[i] == kr[ok]).argmax(1) == band]
                    if len(ok):
                        met[nodes_l[i]] = comps_l[i], [nodes_r[j] for j in ok]
                        for j in ok:
                            met.setdefault(nodes_r[j], (comps_r[j], []))
                for node, (comp, partners) in met.items():
                    for c, v in (("band", band), ("key", key), ("lb", lb), ("rb", rb), ("node", node), ("comp", comp), ("partners", partners)):
                        out[c].append(v)
            return out

        return work

    schema = "band int, key long, lb long, rb long, node binary, comp binary, partners array<binary>"
    found = stored(arrow_map(paired, ["band", "key", "lb", "rb", "left", "right"], schema, compare), "open")
    texts = _texts(docs, nodes, found.select("node").distinct())
    groups = (
        found.join(texts, "node")
        .groupBy("band", "key", "lb", "rb")
        .agg(F.collect_list(F.struct("node", "comp", "partners", "text")).alias("rows"))
    )

    def verify():
        memo = word_hashes()

        def work(batch: pa.RecordBatch):
            a, b = [], []
            for rows in batch.column("rows").to_pylist():
                sets, root = {}, {}
                for r in rows:
                    values = shingle_set(r["text"], words, memo)
                    if xxhash.xxh3_128_digest(values.tobytes()) == r["node"]:  # not another row of the same id
                        sets[r["node"]] = values
                        root[r["node"]] = r["comp"]

                def joins(x, y):
                    gone, kept = root[x], root[y]
                    root.update({k: kept for k, v in root.items() if v == gone})

                for r in rows:
                    for other in r["partners"]:
                        x, y = r["node"], other
                        if x in sets and y in sets and root[x] != root[y] and _same(sets[x], sets[y], percent):
                            joins(x, y)
                            a.append(min(x, y))
                            b.append(max(x, y))
            return {"a": a, "b": b}

        return work

    return arrow_map(groups, ["rows"], "a binary, b binary", verify)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...).

    Rows are linked when 100 * common shingles >= percent * all shingles; component_id is the
    smallest doc_id reachable, kept marks the row that bears it. Texts without words (null, empty)
    have no shingles and stand alone. Texts with fewer words than ``words`` have their whole
    sequence as the one shingle. A row without doc_id is linked with nothing: component_id is null
    and it is kept. Rows that repeat an id and text get the same answer each. An empty table gives
    no rows; further columns of ``docs`` are ignored.
    """
    sig = stored(signatures(docs, words), "signatures")
    nodes = stored(
        sig.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("n_shingles", "regs", "keys")).alias("x"))
        .select("node", "doc_id", F.col("x.n_shingles").alias("n"), "x.regs", "x.keys"),
        "nodes",
    )
    crowd = stored(_crowded(nodes), "crowd")
    tried = stored(_estimated(_led_pairs(crowd.withColumn("comp", F.col("node")), percent, False), nodes, percent), "pairs")
    links = stored(_verified(tried, docs, nodes, words, percent), "confirmed")
    crowd = crowd.filter(F.col("members") > 2)  # pairs of two are tried by now

    def placed_by(comps: DataFrame) -> DataFrame:
        return stored(crowd.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")

    led = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("comp"))  # leaders have the smaller name
    led = led.unionByName(links.join(led.select(F.col("node").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())
    found = _estimated(_led_pairs(placed_by(led), percent, True), nodes, percent)
    new = stored(found.join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.union(stored(_verified(new, docs, nodes, words, percent), "confirmed"))
    comps = connected_components(links)
    crossing = stored(_crossing_links(placed_by(comps), nodes, docs, words, percent), "confirmed")
    of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    between = (
        crossing.join(of("a"), "a", "left")
        .join(of("b"), "b", "left")
        .select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
        .filter("a <> b")
    )
    above = connected_components(between).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    placed = (
        nodes.join(comps, "node", "left")
        .select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
        .join(above, "comp", "left")
        .select("node", "doc_id", F.coalesce("top", "comp").alias("comp"))
    )
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    answer = stored(placed.join(least, "comp").select("node", "component_id"), "answer")
    out = sig.join(answer, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
