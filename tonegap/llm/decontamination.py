"""Benchmark decontamination: shared shingles find the stretches, weighted Jaccard of the shingles decides.

A stretch of a document that is as long as an item reaches a similarity only if it shares at least that part of the
item's shingles. All shingles of the items are indexed, so the places of a document where an item's shingles lie
this close together are all that can reach the threshold: nothing is missed, whatever was changed, put in or left
out. At each of them the Jaccard similarity of shingles weighted by their counts is computed, exactly, by sliding.

``ItemIndex`` compares windows by SimHash within a radius, which misses stretches; ``contaminated`` doesn't use it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegap.llm.common import U64, Memo, arrow_map, kept, mix, sequence_hashes

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Bits of a block and blocks; distance within which fingerprints are all found.
BLOCK_BITS, BLOCKS, RADIUS = 16, 4, 7
#: Items in one index; a larger benchmark is read in as many passes over the documents.
INDEX_ITEMS = 5_000
#: Largest part of an item that a step may be, and growth of item sizes within a class.
STEP_SHARE, CLASS_GROWTH = 5, 1.4


def token_hashes() -> Memo:
    """For a token between white space: the packed hashes of its words."""
    hashed = xxhash.xxh3_64_intdigest

    def words(token: str) -> bytes:
        own = token.rstrip(".,")
        found = [own] if own.isalnum() else WORD.findall(token)
        return b"".join([hashed(w.encode("utf-8", "replace")).to_bytes(8, "little") for w in found])

    return kept("tokens", words)


def hashed_words(text: str | None, memo: Memo) -> np.ndarray:
    """Hashes of the words of a whole text: letters and digits, in lower case."""
    return np.frombuffer(b"".join(map(memo.__getitem__, (text or "").lower().split())), "<u8")


def pair_sums(words: np.ndarray) -> np.ndarray:
    """Running sums, from zero, of the 64 bits of each pair of neighbours.

    Small integers may overflow in long texts; differences within a window stay right.
    """
    pairs = mix(words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:])
    out = np.zeros((max(1, len(words)), 64), np.int16)
    np.cumsum(np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.int16, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, words: int, size: int, step: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words that start at 0, step, 2 * step, ..."""
    if words < size:
        return np.zeros(0, U64)
    ones = sums[size - 1 :: step] - sums[: words - size + 1 : step]
    return np.packbits(ones > (size - 1) // 2, axis=1).view(U64).ravel()


def similarity(a: np.ndarray, b: np.ndarray, words: int) -> float:
    """Jaccard of the shingles of two word sequences, each weighted by its count."""
    x, y = Counter(sequence_hashes(a, words).tolist()), Counter(sequence_hashes(b, words).tolist())
    least = sum((x & y).values())
    return least / max(1, sum(x.values()) + sum(y.values()) - least)


def blocks_of(prints: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The blocks of each print, numbered through by class, block and value."""
    base = (sizes[:, None] * BLOCKS + np.arange(BLOCKS)) << BLOCK_BITS
    return prints.view(np.uint16).reshape(-1, BLOCKS) + base


class ItemIndex:
    """Items (id, words) in classes of size, and the fingerprints of all their windows by block.

    ``shapes`` has window and step of each class; ``begin`` tells for each numbered block where in ``entries``
    the prints with its value, or one a bit away, begin.
    """

    def __init__(self, items: list[tuple[int, str]]) -> None:
        memo = token_hashes()
        self.items = [(i, w) for i, t in items if len(w := hashed_words(t, memo))]
        self.shapes: list[tuple[int, int]] = []
        prints, owner, sizes = [np.zeros(0, U64)], [np.zeros(0, int)], [np.zeros(0, int)]
        offsets = [np.zeros(0, int)]
        order = sorted(range(len(self.items)), key=lambda k: len(self.items[k][1]))
        while order:
            shortest = len(self.items[order[0]][1])
            own = [k for k in order if len(self.items[k][1]) <= shortest * CLASS_GROWTH]
            order = order[len(own) :]
            step = max(1, shortest // STEP_SHARE)
            for k in own:
                words = self.items[k][1]
                prints.append(fingerprints(pair_sums(words), len(words), shortest - step + 1, 1))
                offsets.append(np.arange(len(prints[-1])))
                owner.append(np.full(len(prints[-1]), k))
                sizes.append(np.full(len(prints[-1]), len(self.shapes)))
            self.shapes.append((shortest - step + 1, step))
        self.prints, self.offsets, self.owner = np.concatenate(prints), np.concatenate(offsets), np.concatenate(owner)
        values = blocks_of(self.prints, np.concatenate(sizes))[:, :, None] ^ np.r_[0, 1 << np.arange(BLOCK_BITS)]
        entries = np.repeat(np.arange(len(self.prints)), BLOCKS * values.shape[2])
        order = np.argsort(values.ravel(), kind="stable")
        top = (len(self.shapes) * BLOCKS << BLOCK_BITS) + 1
        self.begin = np.searchsorted(values.ravel()[order], np.arange(top)).astype(np.int32)
        self.entries = entries[order].astype(np.int32)

    def near(self, prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, print) of all that are within the radius; some of them several times."""
        values = blocks_of(prints, sizes).ravel()
        first = self.begin[values]
        many = self.begin[values + 1] - first
        hit = np.flatnonzero(many)
        first, many = first[hit], many[hit]
        w = np.repeat(hit // BLOCKS, many)
        k = self.entries[np.arange(len(w)) + np.repeat(first - np.cumsum(many) + many, many)]
        close = np.flatnonzero(np.bitwise_count(prints[w] ^ self.prints[k]) <= RADIUS)
        return w[close], k[close]


class ShingleIndex:
    """Items (id, words) and their distinct shingles, sorted by hash, with their items.

    An item with fewer than ``words`` words is one shingle, so there is a table for each width that occurs.
    """

    def __init__(self, items: list[tuple[int, str]], words: int, percent: int) -> None:
        memo = token_hashes()
        self.percent = percent
        self.items: list[tuple[int, int, Counter]] = []
        by_width: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, text in items:
            own = hashed_words(text, memo)
            if len(own):
                shingles = sequence_hashes(own, words)
                by_width.setdefault(min(words, len(own)), []).append((np.unique(shingles), len(self.items)))
                self.items.append((name, len(shingles), Counter(shingles.tolist())))
        self.tables = []
        for width, rows in sorted(by_width.items()):
            values, owner = np.concatenate([v for v, _ in rows]), np.repeat([k for _, k in rows], [len(v) for v, _ in rows])
            order = np.argsort(values, kind="stable")
            self.tables.append((width, values[order], owner[order]))

    def starts(self, at: np.ndarray, size: int) -> np.ndarray:
        """Starts of stretches of ``size`` shingles that hold enough of the positions ``at``, in order."""
        need = max(1, -(-self.percent * size // 100))
        if len(at) < need:
            return at[:0]
        # a stretch with enough positions has its first at[k] and at least at[k + need - 1]
        first, last = at[: len(at) - need + 1], at[need - 1 :]
        fit = last - first < size
        low, high = last[fit] - size + 1, first[fit]
        if not len(low):
            return at[:0]
        low[1:] = np.maximum(low[1:], high[:-1] + 1)
        many = np.maximum(high - low + 1, 0)
        return np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())

    def find(self, text: str | None) -> list[tuple[int, int, float]]:
        """(item, first word, similarity) of each item found, best place each."""
        own = hashed_words(text, token_hashes())
        best: dict[int, tuple[float, int]] = {}
        for width, values, owner in self.tables:
            if len(own) < width:
                continue
            shingles = sequence_hashes(own, width)
            begin = np.searchsorted(values, shingles)
            hit = np.flatnonzero(values[np.minimum(begin, len(values) - 1)] == shingles)
            if not len(hit):
                continue
            begin = begin[hit]
            many = np.searchsorted(values, shingles[hit], "right") - begin
            at = np.repeat(hit, many)
            item = owner[np.arange(len(at)) + np.repeat(begin - np.cumsum(many) + many, many)]
            order = np.argsort(item, kind="stable")
            item, at = item[order], at[order]
            for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(item)) + 1):
                name, size, wanted = self.items[item[group[0]]]
                for first, score in slid(shingles, size, wanted, self.starts(at[group], size)):
                    place = score, -max(0, first)
                    if 100 * score >= self.percent and (name not in best or place > best[name]):
                        best[name] = place
        return [(name, -first, score) for name, (score, first) in sorted(best.items())]


def slid(shingles: np.ndarray, size: int, wanted: Counter, starts: np.ndarray):
    """(start, similarity) of the stretches of ``size`` shingles, which end at the text's ends, that begin at ``starts``."""
    have: Counter = Counter()
    least, low, high = 0, 0, 0
    for start in starts.tolist():
        begin, end = max(0, start), min(len(shingles), start + size)
        if begin >= high:
            have.clear()
            least, low, high = 0, begin, begin
        for v in shingles[high:end].tolist():
            if v in wanted:
                have[v] += 1
                least += have[v] <= wanted[v]
        for v in shingles[low:begin].tolist():
            if v in wanted:
                least -= have[v] <= wanted[v]
                have[v] -= 1
        low, high = begin, end
        yield start, least / (size + end - begin - least)


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, first_word, similarity) for each document and benchmark item it holds.

    ``docs`` has doc_id, text; ``benchmark`` item_id, text. Words are letters and digits in lower case. A text with
    fewer than ``words`` words is one shingle. Null and empty texts hold nothing and items without
    words or id are none; items of the same id count as one. Rows that repeat an id and text give their rows each; a null doc_id
    stays null. Empty tables give no rows; further columns are ignored. Of the places of an
    item in a document the most similar, then the first, is returned.

    The items are indexed ``INDEX_ITEMS`` at a time, one pass over the documents each, so the
    broadcast is bounded whatever the benchmark's size.
    """
    spark = docs.sparkSession
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    known = known.filter("item_id IS NOT NULL AND text IS NOT NULL")
    parts = max(1, -(-known.count() // INDEX_ITEMS))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word long, similarity double"

    def one_pass(part: int) -> DataFrame:
        rows = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        shipped = spark.sparkContext.broadcast(sorted((r.item_id, r.text) for r in rows))

        def make():
            find = ShingleIndex(shipped.value, words, percent).find

            def work(batch):
                out: dict[str, list] = {"doc_id": [], "item_id": [], "first_word": [], "similarity": []}
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    for row in find(text):
                        for c, v in zip(out, (doc_id, *row)):
                            out[c].append(v)
                return out

            return work

        return arrow_map(source, ["doc_id", "text"], schema, make)

    out = one_pass(0)
    for part in range(1, parts):
        out = out.union(one_pass(part))
    return out
