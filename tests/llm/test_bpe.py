from __future__ import annotations

import hashlib
import json
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import LONG
from tonegap.llm import bpe
from tonegap.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def own():
    spec = json.load(open(tokenizer_path()))
    return bpe.Encoder(spec), bpe.Decoder(spec), bpe.Decoder(spec, "text"), Tokenizer.from_file(tokenizer_path())


def check(own, text):
    encoder, decoder, _, library = own
    ids = library.encode(text, add_special_tokens=False).ids
    packed = encoder.encode(text)
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids, text[:60]
    assert decoder.decode(packed) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", "It's  WE'LL", "<|endoftext|>x<|startoftext|>", "<|endoftext", "ΟΔΟΣ Σ", "İ ǅ ß", "é Å", "\x1c\x1d a\x85b", "日本語 123", "\U0001f600\U0001f601!!?"],
)
def test_cases(own, text):
    check(own, text)


def test_random_strings_and_long_words(own):
    rng = random.Random(2)
    for k in range(1500):
        letters = "etaoinsrhldcum" if k % 2 else "abcXYZ'é<|>.,12 \n\t"
        check(own, "".join(rng.choice(letters) for _ in range(rng.choice([2, 8, 40, 200]))))
    for text in (LONG, "x" * 100_000, "the" * 3000, "".join(rng.choice("etaoins") for _ in range(20_000))):
        check(own, text)


def test_a_word_is_emitted_before_its_end(own):
    merges = own[0].merges
    read = 0

    def symbols():
        nonlocal read
        for c in "the" * 5000:
            read += 1
            yield c

    stream = merges.stream(symbols())
    next(stream)
    assert read < 20 * merges.lookahead


def test_text_machine(own):
    encoder, _, text, _ = own
    assert text.decode(encoder.encode("Hello wörld 日本")) == "hello wörld 日本 "
    assert text.decode(struct.pack("<I", encoder.vocab["Ã"])) == "�" and text.decode(None) == ""


def test_rows(spark, messy, nothing):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    done = bpe.digests(bpe.decode_ids(bpe.encode_texts(messy, tokenizer_path()), tokenizer_path())).collect()
    want = []
    for r in messy.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, done), key=str) == sorted(want, key=str)
    assert bpe.encode_texts(nothing, tokenizer_path()).count() == 0


def test_every_piece_takes_the_transducer_and_streams_are_apart(own, monkeypatch):
    """A stream left half-read changes no other."""
    encoder, _, _, library = own
    half = encoder.merges.stream(iter("the" * 2000))
    next(half)
    rng = random.Random(4)
    for _ in range(50):
        check(own, "".join(rng.choice("etaoinsrhl") for _ in range(400)))
    for _ in range(300):
        symbols = [*"".join(rng.choice("etaoinsrhl") for _ in range(rng.randrange(1, 90)))]
        symbols[-1] += bpe.WORD_END
        tokens = encoder.merges.encode_whole(symbols)
        assert encoder.merges.closed(symbols) == tokens == list(encoder.merges.stream(symbols))
    fresh, calls = bpe.Encoder(json.load(open(tokenizer_path()))), []
    for name in ("stream", "closed"):
        real = getattr(bpe.MergeList, name)
        monkeypatch.setattr(bpe.MergeList, name, lambda self, symbols, name=name, real=real: calls.append(name) or real(self, symbols))
    fresh.encode("one two, three " + "the" * 40)
    assert sorted(calls) == ["closed"] * 4 + ["stream"]


def test_one_pass_is_both(spark, messy, nothing):
    both = bpe.decode_ids(bpe.encode_texts(messy, tokenizer_path()), tokenizer_path())
    once = bpe.round_trip(messy, tokenizer_path())
    assert sorted(map(str, once.collect())) == sorted(map(str, both.collect()))
    assert bpe.round_trip(nothing, tokenizer_path()).collect() == []


def test_a_piece_is_encoded_once_and_heads_are_shared(monkeypatch):
    encoder, calls, noted = bpe.Encoder(json.load(open(tokenizer_path()))), [], []
    closed, notes = bpe.MergeList.closed, bpe.MergeList._noted
    monkeypatch.setattr(bpe.MergeList, "closed", lambda self, symbols: calls.append("".join(symbols)) or closed(self, symbols))
    monkeypatch.setattr(bpe.MergeList, "_noted", lambda self, text, n, starts: noted.append(n + 1 - len(starts)) or notes(self, text, n, starts))
    encoder.encode("thinking thinking. (thinking) thinking,, THINKING")
    assert calls.count("thinking</w>") == 1 and len(calls) == len(set(calls))
    noted.clear()
    encoder.encode("thinkable thinkers")
    assert sum(noted) == len("able") + len("ers")


def test_small_memos_change_nothing(own):
    """Halves that turn over all the time, strings that begin alike, and each position's token against whole encoding."""
    encoder, rng = bpe.Encoder(json.load(open(tokenizer_path()))), random.Random(7)
    for memo in (encoder.memo, encoder.merges.cut, encoder.merges.heads):
        memo.most = 3000
    for _ in range(40):
        words = [rng.choice(["thing", "therein", "naïve", "'s"]) + "".join(rng.choices("thingsaé.'1", k=rng.randrange(9))) for _ in range(60)]
        text = " ".join(words)
        packed = encoder.encode(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == own[3].encode(text, add_special_tokens=False).ids
        assert packed == own[0].encode(text)
    assert all(len(memo) < 20 for memo in (encoder.memo, encoder.merges.cut)) and encoder.memo.older


def test_a_halved_memo_keeps_what_is_asked_for():
    calls = []
    memo = bpe.HalvedMemo(lambda key: calls.append(key) or len(key), 4000)
    for k in range(200):
        assert memo["often"] == 5 and memo[f"once {k}"] == len(f"once {k}")
    assert calls.count("often") == 1 and len(memo) + len(memo.older) < 30
    assert memo["x" * 300] == 300 and "x" * 300 not in memo


def test_unknown_ids_give_nothing(own):
    _, tokens, text, _ = own
    far = struct.pack("<3I", 4_000_000_000, 5, 60_000)
    assert tokens.decode(far) == tokens.decode(struct.pack("<I", 5)) and text.decode(far) == text.decode(struct.pack("<I", 5))
    assert len(tokens.pieces) == len(text.pieces)
