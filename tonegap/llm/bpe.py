"""Byte-pair encoding as a streaming transducer, and decoding as a byte-to-text machine.

A sequence of tokens is the encoding of its text exactly if every token is the encoding of its own
symbols and no two neighbours would merge otherwise when encoded together. So every prefix of a
word has one last token: the one that ends there and goes with the last token of the
prefix before it. The transducer notes that token for each position from left to right. A later
token can start at most ``lookahead`` symbols back, the length of the longest product of the merge
list, so only those positions are kept as heads; what the chains of all heads have in common is
stable and is emitted, whatever follows. Memory is bounded by the lookahead and the
short stretch that is still open, not by the length of the word. The notes of a prefix depend on
nothing else, so short pieces that begin alike share those of their first symbols.
"""

from __future__ import annotations

import codecs
import json
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegap.llm.common import ENTRY_BYTES, MEMO_KEY, Memo, arrow_map, held

WORD_END = "</w>"
#: Python splits on these, Unicode's White_Space does not hold them.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")
#: Symbols of a piece whose notes are all kept; a longer one is streamed.
HELD_SYMBOLS = 64
#: Pieces that begin with the same symbols share the notes of so many of them.
HEAD_SYMBOLS = 5
#: Bytes of remembered words and pieces, of remembered pairs of tokens and of remembered heads of pieces.
WORD_BYTES, PAIR_BYTES, HEAD_BYTES = 48 << 20, 32 << 20, 8 << 20
#: Ids decoded at once.
DECODE_BLOCK = 65_536


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the others follow from U+0100 on in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class HalvedMemo(Memo):
    """A memo that, when it gets large, forgets only what was not asked for since it last did.

    It has two halves. A full one becomes the older one; what is asked for again moves from there to the newer one.
    """

    def __init__(self, compute: Callable, most: int) -> None:
        super().__init__(compute, most // 2)
        self.older: dict = {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= MEMO_KEY:
            self.bytes += ENTRY_BYTES + len(key) + (len(value) if isinstance(value, bytes) else 0)
            if self.bytes > self.most:
                self.older, self.bytes = self.copy(), 0
                self.clear()
            self[key] = value
        return value


class _Names(dict):
    """Bytes of ids; those outside the vocabulary give nothing."""

    def __missing__(self, key: int) -> bytes:
        return b""


class MergeList:
    """Merges by rank and what follows from them: valid tokens, fitting neighbours, the lookahead."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.vocab = vocab
        self.rank = {tuple(m): k for k, m in enumerate(merges)}
        self.lookahead = max((len(self.symbols(a + b)) for a, b in self.rank), default=1)
        self.valid = Memo(lambda t: t in vocab and self.encode_whole(self.symbols(t)) == [t])
        self.cut = HalvedMemo(self._cut, PAIR_BYTES)
        self.heads = Memo(lambda head: bytes(self._noted(head, len(head), [0])), HEAD_BYTES)

    @staticmethod
    def symbols(token: str) -> list[str]:
        """Characters of a token; the mark of a word's end belongs to the last one."""
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            body = token[: -len(WORD_END)]
            return [*body[:-1], body[-1] + WORD_END]
        return [*token]

    def encode_whole(self, parts: list[str]) -> list[str]:
        """Merge pairs in the order of rank until none is left; for strings of bounded length."""
        parts, rank, none = list(parts), self.rank.get, len(self.rank)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def _cut(self, text: str) -> int:
        """Where the encoding of a bounded text is cut if it has two tokens: symbols of the first. One token: 0, more than two: -1."""
        parts = self.encode_whole(self.symbols(text))
        return 0 if len(parts) == 1 else len(parts[0]) if len(parts) == 2 else -1

    def fits(self, before: str, token: str) -> bool:
        """Whether two tokens stay apart, each as it is, when encoded together."""
        return self.cut[before + token] == len(before)

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of a stream of symbols, each as soon as nothing that follows can change it."""
        last: dict[int, tuple[str, int]] = {}  # position -> (token that ends there, where it starts)
        recent: list[str] = []
        tail: str | None = None  # the last token before the open stretch
        done = at = 0
        for symbol in symbols:
            at += 1
            recent = [*recent[1 - self.lookahead :], symbol] if self.lookahead > 1 else [symbol]
            token = ""
            for back in range(1, min(len(recent), at - done) + 1):
                token = recent[-back] + token
                start = at - back
                if token not in self.vocab or not self.valid[token]:
                    continue
                if start == done or start in last and self.fits(last[start][0], token):
                    if start == done and tail is not None and not self.fits(tail, token):
                        continue
                    last[at] = token, start
                    break
            if at - done > 4 * self.lookahead:
                for token in self._stable(last, done, at):
                    yield token
                    done += len(self.symbols(token))
                    tail = token
                last = {p: x for p, x in last.items() if p > done and x[1] >= done}
        rest = []
        while at > done:
            token, at = last[at]
            rest.append(token)
        yield from reversed(rest)

    def closed(self, symbols: list[str]) -> list[str]:
        """Tokens of a piece that is at hand whole: the transducer's notes from left to right, read back from the end. Nothing is held back.

        A symbol is one character, the last one with the mark of the word's end.
        """
        text, at = "".join(symbols), len(symbols)
        starts = self._noted(text, at, [*self.heads[text[:HEAD_SYMBOLS]]] if at > HEAD_SYMBOLS else [0])
        tokens, end = [], None
        while at:
            at = starts[at]
            tokens.append(text[at:end])
            end = at
        tokens.reverse()
        return tokens

    def _noted(self, text: str, symbols: int, starts: list[int]) -> list[int]:
        """The notes of a text, continued from those at hand: where the token that ends at each position starts.

        A token that ends at a position fits if, encoded together with the one noted for its start, it is cut off there. There is one
        such token, mostly the one noted before with a symbol more.
        """
        vocab, cut, known = self.vocab, self.cut, self.cut.get
        for at in range(len(starts), symbols + 1):
            end = at if at < symbols else None
            begin = starts[-1]
            before = starts[begin]
            if known(text[before:end]) != begin - before:
                for begin in range(at - 1, max(-1, at - 1 - self.lookahead), -1):
                    before = starts[begin]
                    if text[begin:end] in vocab and cut[text[before:end]] == begin - before:
                        break
                else:
                    raise KeyError(text[at - 1 : end])
            starts.append(begin)
        return starts

    def _stable(self, last: dict, done: int, at: int) -> list[str]:
        """Tokens from ``done`` on that the chains of all heads share."""
        common = None
        for head in range(at - self.lookahead + 1, at + 1):
            if head in last:
                chain, p = [], head
                while p > done:
                    token, p = last[p]
                    chain.append(token)
                chain.reverse()
                if common is None:
                    common = chain
                else:
                    same = 0
                    while same < min(len(chain), len(common)) and chain[same] == common[same]:
                        same += 1
                    common = common[:same]
        return common or []


class Encoder:
    """A tokenizer file's text pipeline: special tokens, NFC, lower case, pieces, bytes, merges."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = MergeList(self.vocab, merges)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        self.letter_runs = r"|[\p{L}]+|" in pattern  # only contractions and marks stand before, no word of letters alone
        self.packed = {t: struct.pack("<I", i) for t, i in self.vocab.items()}
        self.bytes = byte_symbols()
        self.memo = HalvedMemo(self.word, WORD_BYTES)

    def word(self, word: str) -> bytes:
        """Ids of a normalised word without white space, as little-endian unsigned 32-bit integers; those of its pieces, one after another.

        A piece is kept like a word: the pattern looks at nothing outside of a piece.
        """
        if self.letter_runs and word.isascii() and word.isalpha():
            return self.piece(word)
        pieces = self.pieces.findall(word)
        return self.piece(word) if pieces == [word] else b"".join(map(self.memo.__getitem__, pieces))

    def piece(self, piece: str) -> bytes:
        symbols = [*map(self.bytes.__getitem__, piece.encode("utf-8", "surrogatepass"))]
        symbols[-1] += WORD_END
        long = len(symbols) > HELD_SYMBOLS  # else all notes fit into memory and none is emitted before the end
        return b"".join(map(self.packed.__getitem__, self.merges.stream(symbols) if long else self.merges.closed(symbols)))

    def plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words = text.split() if not _NOT_SPACE.search(text) else [w for w in _SPACE.split(text) if w]
        return b"".join(map(self.memo.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; special tokens written in it are found before all else."""
        text = text or ""
        if self.marks is None or "<" not in text:
            return self.plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self.plain(text[at : m.start()]), struct.pack("<I", self.special[m[0]])]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


class Decoder:
    """Feeds the bytes of ids to an incremental UTF-8 machine.

    Mode "tokens" is what a tokenizer file without a decoder asks for: the vocabulary's own strings
    with a space between. Mode "text" gives the bytes they stand for, with a space at each word end.
    Bytes that are not UTF-8 become U+FFFD. Ids outside the vocabulary give nothing.
    """

    def __init__(self, spec: dict, mode: str = "tokens") -> None:
        names = {i: t for t, i in spec["model"]["vocab"].items()}
        special = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        names |= special
        if mode == "tokens":
            self.pieces = _Names({i: b" " + t.encode() for i, t in names.items()})
        else:
            of = {s: b for b, s in enumerate(byte_symbols())}
            self.pieces = _Names()
            for i, t in names.items():
                ends = t.endswith(WORD_END) and i not in special
                body = t.removesuffix(WORD_END) if ends else t
                self.pieces[i] = (t.encode() if i in special else bytes(of[c] for c in body)) + b" " * ends
        self.skip = int(mode == "tokens")

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes certain; bytes of an unfinished character wait for the next id."""
        machine, first = codecs.getincrementaldecoder("utf-8")("replace"), True
        ids = iter(ids)
        while block := [*islice(ids, DECODE_BLOCK)]:
            raw = b"".join(map(self.pieces.__getitem__, block))
            if first and raw:
                raw, first = raw[self.skip :], False
            yield machine.decode(raw)
        yield machine.decode(b"", True)

    def decode(self, packed: bytes | None) -> str:
        return "".join(self.feed(memoryview(packed or b"").cast("I")))


def _once(kind, raw: bytes, *args):
    """One encoder or decoder per worker process, whatever the number of tasks; dropped when another operator runs there."""
    loaded = held(f"bpe {hash(raw)}", dict)
    key = (kind, *args)
    if key not in loaded:
        loaded[key] = kind(json.loads(raw), *args)
    return loaded[key]


def _shipped(df: DataFrame, path: str):
    """The tokenizer file's bytes for all executors: a vocabulary, bounded whatever the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text, ...).

    ids is binary: unsigned 32-bit integers, little-endian. Null and empty texts, and texts of white space
    only, have no ids (empty binary). Rows with null or repeated ids are encoded like all others;
    an empty table gives no rows; further columns are ignored. ``path`` names the tokenizer file.
    """
    shipped = _shipped(docs, path)

    def make():
        encoder = _once(Encoder, shipped.value)
        return lambda batch: {
            "doc_id": batch.column("doc_id"),
            "ids": pa.array([encoder.encode(t) for t in batch.column("text").to_pylist()], pa.binary()),
        }

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(source, ["doc_id", "text"], "doc_id long, ids binary", make)


def decode_ids(tokens: DataFrame, path: str, mode: str = "tokens") -> DataFrame:
    """(doc_id, ids, decoded) for every row of ``tokens`` (doc_id, ids); null ids give an empty text."""
    shipped = _shipped(tokens, path)

    def make():
        decoder = _once(Decoder, shipped.value, mode)
        return lambda batch: {
            "doc_id": batch.column("doc_id"),
            "ids": batch.column("ids"),
            "decoded": [decoder.decode(x) for x in batch.column("ids").to_pylist()],
        }

    return arrow_map(tokens, ["doc_id", "ids"], "doc_id long, ids binary, decoded string", make)


def round_trip(docs: DataFrame, path: str, mode: str = "tokens") -> DataFrame:
    """(doc_id, ids, decoded) for every row of ``docs``: ``decode_ids`` of ``encode_texts``, in one worker and one exchange with it."""
    shipped = _shipped(docs, path)

    def make():
        encoder, decoder = _once(Encoder, shipped.value), _once(Decoder, shipped.value, mode)

        def work(batch):
            ids, decoded = [], []
            for text in batch.column("text"):
                ids.append(encoder.encode(text.as_py()))
                decoded.append(decoder.decode(ids[-1]))
            return {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary()), "decoded": decoded}

        return work

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(source, ["doc_id", "text"], "doc_id long, ids binary, decoded string", make)


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the ids and the text decoded from them."""
    ids = F.coalesce("ids", F.lit(b""))
    return decoded.select(
        "doc_id",
        *more,
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
