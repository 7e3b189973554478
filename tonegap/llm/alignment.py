"""Alignment of the tokens of two tokenizers.

A text is encoded whole by both. Where a token of either ends at the same byte and both next tokens begin with a space,
the two lists are cut (after the bytes of all tokens were compared with the text, so these ends are verified). What lies
between two cuts is a window of ids, mostly one word; its alignment depends on the ids alone and is
remembered by them. Inside a window, tokens are walked in step: each pair that shares bytes is a link, and
every byte where both end closes a group.

How often two ids are linked is counted over all documents. A document holds each of its pairs once, with a number.
The most frequent pairs, a fixed number of them, are looked up in a broadcast table, so that
no pair that many documents share is ever a join key; all other pairs are joined, exactly.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegap.llm.common import arrow_map, stored

#: Characters encoded and aligned in one call, bytes of remembered windows, and tokens of the longest window that is remembered.
CALL_CHARS, MEMO_BYTES, MEMO_TOKENS = 500_000, 32 << 20, 64
#: Pairs in the broadcast table (17 bytes each).
HOT_PAIRS = 1 << 18
#: The mark that stands for a space in pieces.
MARK = "▁"
#: What byte-level tokenizer files split texts by (a fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts in which both libraries split alike: every one of these characters was compared (see the tests).
_PLAIN, PLAIN_CHARS = re.compile("[\x00-\u024f]*"), 1_000_000
#: Between the ids of both sides in a window's key; no id.
_BAR = 0xFFFFFFFF


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


@dataclass
class Side:
    """One tokenizer: how it encodes texts with a space before them, and the bytes of its ids."""

    encode: Callable[[list[str]], list[list[int]]]
    pieces: list[bytes]


def load_side(path: str) -> Side:
    """A byte-level tokenizer file (``.json``) or a piece model (``.model``, which adds the space itself)."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        pieces = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        return Side(lambda texts: [model.EncodeAsIds(t) for t in texts], pieces)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    known.encode_special_tokens = True
    known.no_truncation()
    known.no_padding()
    letters = byte_alphabet()
    pieces = [b""] * known.get_vocab_size()
    for name, i in known.get_vocab().items():
        pieces[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()

    def whole(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in known.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    quick = _ranked(path, pieces)
    if quick is None:
        return Side(whole, pieces)

    def mixed(texts: list[str]) -> list[list[int]]:
        easy = [len(t) <= PLAIN_CHARS and _PLAIN.fullmatch(t) is not None for t in texts]
        rest = iter(whole([t for t, e in zip(texts, easy) if not e]))
        return [quick(" " + t) if e else next(rest) for t, e in zip(texts, easy)]

    return Side(mixed, pieces)


def _ranked(path: str, pieces: list[bytes]) -> Callable[[str], list[int]] | None:
    """The same merges by rank, four times as fast, for a file that is nothing but byte-level pairs in the order of their ids; else None.

    A stretch of bytes that has become two neighbours is merged by the rank of both together; the list of merges names the same two, as
    what happens inside a stretch doesn't depend on what stands beside it.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"]
    plain = spec["normalizer"] is None and split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or model.get("dropout") or model.get("ignore_merges") or model.get("unk_token"):
        return None
    special = {t["id"] for t in spec["added_tokens"]}
    merges = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merges]
    if ids != list(range(ids[0], ids[0] + len(ids))) or len(ids) + 256 + len(special) != len(pieces):
        return None
    ranks = {piece: i for i, piece in enumerate(pieces) if i not in special}
    return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


#: A window's groups as text, their number, and its links: a * 2**32 + b each, as packed 64-bit integers.
Aligned = tuple[bytes, int, bytes]


class Aligner:
    """The cutting of documents into windows, and their alignments, remembered by packed ids in at most ``MEMO_BYTES``."""

    def __init__(self, a: Side, b: Side) -> None:
        self.a, self.b, self.memo, self.bytes = a, b, {}, 0
        self.sizes = [np.array([len(p) for p in s.pieces]) for s in (a, b)]
        self.spaced = [np.array([p[:1] == b" " for p in s.pieces]) for s in (a, b)]
        self.letters = [np.frombuffer(b"".join(s.pieces), np.uint8) for s in (a, b)]
        self.starts = [np.cumsum(size) - size for size in self.sizes]
        #: How an id is written before the next one of its group, and as the last of its side; first those of a, then of b.
        self.written = [b"%d%s" % (i, end) for s, last in ((a, b"|"), (b, b";")) for i in range(len(s.pieces)) for end in (b",", last)]

    def windows(self, text: str, a: list[int], b: list[int]) -> tuple[int, int, list[bytes]]:
        """(tokens of a, tokens of b, keys of the windows); no tokens if their bytes are not those of the text.

        A key is the window's ids of a, a bar, and its ids of b.
        """
        raw = np.frombuffer(b" " + text.encode(), np.uint8)
        a, b = np.asarray(a, "<u4"), np.asarray(b, "<u4")
        end_a, end_b = (self.ends(side, ids, raw) for side, ids in enumerate((a, b)))
        if end_a is None or end_b is None:
            return 0, 0, []
        start_a, start_b = (end[:-1][spaced[ids[1:]]] for end, ids, spaced in zip((end_a, end_b), (a, b), self.spaced))
        begins = np.zeros(len(raw) + 1, bool)
        begins[start_a] = True
        cuts = start_b[begins[start_b]]  # both sides end here, and go on with a space
        at_a, at_b = (np.concatenate([[0], np.searchsorted(end, cuts) + 1, [len(end)]]) for end in (end_a, end_b))
        n = np.arange(len(at_a))
        of_a, of_b = np.repeat(n[:-1], np.diff(at_a)), np.repeat(n[:-1], np.diff(at_b))
        packed = np.full(len(a) + len(b) + len(n) - 1, _BAR, "<u4")
        packed[np.arange(len(a)) + of_a + at_b[of_a]] = a
        packed[np.arange(len(b)) + of_b + 1 + at_a[of_b + 1]] = b
        keys, edges = packed.tobytes(), ((at_a + at_b + n) * 4).tolist()
        return len(a), len(b), [keys[i:j] for i, j in zip(edges, edges[1:])]

    def ends(self, side: int, ids: np.ndarray, raw: np.ndarray) -> np.ndarray | None:
        """Where the tokens of one side end; None if their bytes are not ``raw``."""
        size = self.sizes[side][ids]
        end = np.cumsum(size)
        if not len(ids) or end[-1] != len(raw):
            return None
        place = np.arange(len(raw)) + np.repeat(self.starts[side][ids] - end + size, size)
        return end if (self.letters[side][place] == raw).all() else None

    def align(self, windows: list[bytes]) -> list[Aligned]:
        """The alignments of windows, all at once: written one after the other they are one text, in which all windows end together.

        Every byte where a token of either side ends closes a link, every byte where tokens of both end a group.
        """
        if not windows:
            return []
        ids, sizes = np.frombuffer(b"".join(windows), "<u4"), np.array(list(map(len, windows))) // 4
        window, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(ids))
        bar = np.flatnonzero(ids == _BAR)
        first, second = place < bar[window], place > bar[window]
        a, b, of_a = ids[first].astype(np.int64), ids[second].astype(np.int64), window[first]
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        of_side = np.zeros((2, end_a[-1] + 1), bool)
        of_side[0, end_a] = of_side[1, end_b] = True
        ends, shared = np.flatnonzero(of_side[0] | of_side[1]), np.flatnonzero(of_side[0] & of_side[1])
        by_a = np.searchsorted(end_a, ends)
        links = (a[by_a] << 32 | b[np.searchsorted(end_b, ends)]).tobytes()
        link_edges = (np.searchsorted(of_a[by_a], np.arange(len(sizes) + 1)) * 8).tolist()
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        until_a, until_b = np.searchsorted(end_a, shared) + 1, np.searchsorted(end_b, shared) + 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.concatenate([[0], until_b[:-1]])[group_a]] = 2 * a + (end_a == shared[group_a])
        codes[np.arange(len(b)) + until_a[group_b]] = 2 * (len(self.a.pieces) + b) + (end_b == shared[group_b])
        parts = list(map(self.written.__getitem__, codes.tolist()))
        groups = np.bincount(of_a[until_a - 1], minlength=len(sizes)).tolist()
        edges = np.concatenate([[0], np.cumsum(sizes - 1)]).tolist()
        return [
            (b"".join(parts[i:j])[:-1], n, links[k:m])
            for i, j, n, k, m in zip(edges, edges[1:], groups, link_edges, link_edges[1:])
        ]

    def known(self, keys: list[bytes]) -> dict[bytes, Aligned]:
        """The alignments of all keys, remembered or new; new ones that came more than once are remembered, if short."""
        times, memo = Counter(keys), self.memo
        new = [k for k in times if k not in memo]
        found = {k: memo[k] for k in times if k in memo}
        fresh = self.align(new)
        for key, value in zip(new, fresh):
            if times[key] > 1 and len(key) <= 4 * MEMO_TOKENS:
                size = 300 + 2 * len(key) + len(value[0]) + len(value[2])
                if self.bytes + size > MEMO_BYTES:
                    memo.clear()
                    self.bytes = 0
                self.bytes += size
                memo[key] = value
        found.update(zip(new, fresh))
        return found

    def documents(self, texts: list[str | None]) -> Iterator[tuple[int, int, list[Aligned]]]:
        """Tokens and aligned windows of each text, in order; tokenizers and alignment get a bounded number of characters at once."""
        part: list[str] = []
        size = 0

        def done():
            some = [t for t in part if t]
            coded = iter(zip(self.a.encode(some), self.b.encode(some)))
            cut = [self.windows(t, *next(coded)) if t else (0, 0, []) for t in part]
            known = self.known([k for *_, keys in cut for k in keys])
            for n_a, n_b, keys in cut:
                yield n_a, n_b, list(map(known.__getitem__, keys))

        for text in texts:
            part.append(text or "")
            size += len(part[-1])
            if size > CALL_CHARS:
                yield from done()
                part.clear()
                size = 0
        yield from done()


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of two files, loaded once per worker process."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(load_side(path_a), load_side(path_b))
    return _LOADED[path_a, path_b]


def align_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, groups) of every row of ``docs`` (doc_id, text, ...): the alignment itself.

    A group is (start, end, a, b): bytes of the text with a space before it, and the ids of both sides that cover
    exactly these. A null or empty text has no groups, nor has one that a tokenizer doesn't give back byte by byte. Repeated rows are
    aligned alike; an empty table gives no rows; further columns are ignored.
    """

    def make():
        own = aligner(path_a, path_b)

        def work(batch):
            out = []
            for _, _, windows in own.documents(batch.column("text").to_pylist()):
                groups, at = [], 0
                for group in b";".join([text for text, _, _ in windows]).split(b";") if windows else []:
                    a, b = ([int(i) for i in side.split(b",")] for side in group.split(b"|"))
                    end = at + sum(len(own.a.pieces[i]) for i in a)
                    groups.append({"start": at, "end": end, "a": a, "b": b})
                    at = end
                out.append(groups)
            return {"doc_id": batch.column("doc_id"), "groups": out}

        return work

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(source, ["doc_id", "text"], "doc_id long, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>", make)


def aligned_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts) of every row of ``docs``.

    ``pairs`` holds the document's distinct links (a * 2**32 + b) and ``counts`` how often each occurs.
    """

    def make():
        own = aligner(path_a, path_b)

        def work(batch):
            numbers, digests, sizes, pairs, counts = [], [], [0], [], []
            for n_a, n_b, found in own.documents(batch.column("text").to_pylist()):
                links = np.frombuffer(b"".join([own_links for _, _, own_links in found]), np.int64)
                met, times = np.unique(links, return_counts=True)
                numbers.append((n_a, n_b, sum([n for _, n, _ in found]), len(links)))
                digests.append(hashlib.sha256(b";".join([text for text, _, _ in found])).hexdigest() if found else "")
                pairs.append(met)
                counts.append(times)
                sizes.append(sizes[-1] + len(met))
            n = np.array(numbers, np.int64)
            listed = lambda parts: pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(parts)))
            out = {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "groups_sha256": digests}
            out |= {name: pa.array(n[:, k]) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
            return out | {"pairs": listed(pairs), "counts": listed(counts)}

        return work

    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    schema = (
        "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<long>"
    )
    return arrow_map(source, ["row", "doc_id", "text"], schema, make)


def pair_totals(aligned: DataFrame) -> DataFrame:
    """(pair, total, best): links that hold a pair over all documents, and whether no pair of its b has more."""
    each = aligned.select(F.inline(F.arrays_zip("pairs", "counts")))
    totals = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("total"))
    most = F.max("total").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(2**32 - 1))))  # at most the ids of a
    return totals.withColumn("most", most).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def _looked_up(aligned: DataFrame, hot: pa.Table) -> DataFrame:
    """(row, n_best, count_sum, pairs, counts): sums over the pairs of the table ``hot``, and the pairs that are not in it."""
    known = hot.sort_by("pair")
    columns = [known.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "total", "best")]
    shipped = aligned.sparkSession.sparkContext.broadcast(columns)

    def make():
        pair, total, best = shipped.value

        def work(batch):
            lists = batch.column("pairs")
            sizes = np.asarray(lists.value_lengths())
            own = np.repeat(np.arange(len(sizes)), sizes)
            wanted, counts = (np.asarray(batch.column(c).flatten()) for c in ("pairs", "counts"))
            at = np.minimum(np.searchsorted(pair, wanted), max(len(pair) - 1, 0))
            met = pair[at] == wanted if len(pair) else np.zeros(len(wanted), bool)
            sums = []
            for value in (best, total):
                added = np.zeros(len(sizes), np.int64)
                np.add.at(added, own[met], counts[met] * value[at[met]])
                sums.append(added)
            rest = np.bincount(own[~met], minlength=len(sizes))
            offsets = pa.array(np.concatenate([[0], np.cumsum(rest)]), pa.int32())
            left = {n: pa.ListArray.from_arrays(offsets, pa.array(v[~met])) for n, v in (("pairs", wanted), ("counts", counts))}
            return {"row": batch.column("row"), "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])} | left

        return work

    return arrow_map(aligned, ["row", "pairs", "counts"], "row long, n_best long, count_sum long, pairs array<long>, counts array<long>", make)


def alignment_counts(docs: DataFrame, path_a: str, path_b: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs`` (doc_id, text, ...).

    ``n_best`` counts the links whose pair is, over all documents, the most frequent one of its b (ties included), ``count_sum``
    adds up how often the pairs of all links occur. Without tokens (text null, empty or not given back byte by byte by either
    tokenizer) all numbers are 0 and the digest is empty. Repeated rows and null ids are rows like any other. An
    empty table gives no rows; further columns are ignored. ``hot_pairs`` bounds the broadcast and changes no result.
    """
    aligned = stored(aligned_documents(docs, path_a, path_b), "aligned")
    totals = stored(pair_totals(aligned), "pair-totals")
    hot = totals.orderBy(F.desc("total"), "pair").limit(hot_pairs).toArrow()
    looked = stored(_looked_up(aligned, hot), "looked-up")
    rest = looked.select("row", F.inline(F.arrays_zip("pairs", "counts"))).join(totals.withColumnRenamed("pair", "pairs"), "pairs")
    late = rest.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("counts")).otherwise(0)).alias("late_best"), F.sum(F.col("counts") * F.col("total")).alias("late_sum")
    )
    whole = looked.select("row", "n_best", "count_sum").join(late, "row", "left")
    both = whole.select(
        "row",
        (F.col("n_best") + F.coalesce("late_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("late_sum", F.lit(0))).alias("count_sum"),
    )
    counted = aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(both, "row")
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
