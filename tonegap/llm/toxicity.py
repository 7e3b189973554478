"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

Both dictionaries end in the same body, trained on windows of ordinary text. The toxic one has in
front of it the words that toxic documents use in clearly more different contexts than ordinary
ones do; contexts, not occurrences, so that copies of a document count once. What a window saves with
the toxic dictionary is its margin. A document's margins are summed up in a few numbers, and a
logistic curve fitted on the same bounded sample turns them into a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegap.llm.common import fit_labels, labelled_sample, predictions, with_scores

#: Documents per label, characters per document and windows of ordinary text that the fit may use.
FIT_PER_LABEL, FIT_MAX_CHARS, FIT_WINDOWS = 1500, 20_000, 40_000
#: Bytes of a window, at word boundaries.
WINDOW = 96
LEVEL = 11
#: Bytes of the trained body, and of the characteristic words before it (the strongest, if there are more).
BODY_BYTES, WORDS_BYTES = 32_768, 16_384
#: A word's contexts, likelihood ratio and odds from which it counts as characteristic.
LEAST_CONTEXTS, LEAST_RATIO, LEAST_ODDS = 4, 12.0, 6.0
_WORD = regex.compile(r"[\p{L}\p{N}]{3,}")


#: Two bytes for each pair of neighbouring bytes, a fixed scrambling of all 65,536.
_PAIRS = np.random.default_rng(3).permutation(65_536).astype(np.uint16)


def widened(raw: bytes) -> bytes:
    """A text as codes of its byte pairs: twice as long and hard to shorten without a match.

    A word that a dictionary knows costs one match either way; one that it doesn't know costs four times the
    bytes that plain letters would, so a window's length tells them apart.
    """
    x = np.frombuffer(raw, np.uint8).astype(np.int64)
    return _PAIRS[x[:-1] * 256 + x[1:]].tobytes()


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Consecutive windows of a whole text, cut at spaces; a longer word is cut by bytes."""
    raw = b" " + b" ".join((text or "").lower().encode("utf-8", "replace").split()) + b" "
    out, at = [], 0
    while at < len(raw) - 1:
        end = raw.rfind(b" ", at + 1, at + size + 1)
        end = end if end > at else min(at + size, len(raw) - 1)
        out.append(widened(raw[at : end + 1]))
        at = end
    return out


def contexts(texts: list[str]) -> dict[str, int]:
    """In how many different neighbourhoods (previous word) each word stands."""
    seen: dict[str, set] = {}
    for text in texts:
        before = ""
        for word in _WORD.findall(text.lower()):
            seen.setdefault(word, set()).add(before)
            before = word
    return {w: len(x) for w, x in seen.items()}


def characteristic_words(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Words of toxic texts by growing weight, as far as they are significant."""
    a, b = contexts(toxic), contexts(ordinary)
    na, nb = max(1, sum(a.values())), max(1, sum(b.values()))
    found = []
    for word, n in a.items():
        m = b.get(word, 0)
        share = (n + m) / (na + nb)
        ratio = 2 * (n * math.log(n / (share * na)) + (m * math.log(m / (share * nb)) if m else 0))
        if n >= LEAST_CONTEXTS and ratio >= LEAST_RATIO and n / na >= LEAST_ODDS * m / nb:
            found.append((ratio, word))
    return [w for _, w in sorted(found)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=2 * WINDOW, dict_size=len(content), min_match=3, write_content_size=False
    )
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=params)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (the last is the constant) by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    """Two dictionaries and the curve. Without both labels in the sample there is no curve: score 0."""

    toxic: bytes
    ordinary: bytes
    curve: np.ndarray | None

    def scorer(self):
        if self.curve is None:
            return lambda text: 0.0
        a, b = _compressor(self.toxic), _compressor(self.ordinary)

        def margins(text: str | None) -> np.ndarray:
            return np.array([len(b.compress(w)) - len(a.compress(w)) for w in windows(text)] or [0.0], float)

        def score(text: str | None) -> float:
            z = np.r_[summary(margins(text)), 1.0] @ self.curve
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        score.margins = margins
        return score


def summary(margins: np.ndarray) -> np.ndarray:
    """Largest margin, mean of the three largest, and what margins from two bytes on add up to."""
    top = np.sort(margins)[-3:]
    total = margins[margins >= 2].sum()
    return np.array([max(top[-1], 0), max(top.mean(), 0), math.log1p(total), math.log1p(total / len(margins))])


def train(texts: list[tuple[int, str, str]], counts: dict[str, int]) -> Model:
    """Fit on (doc_id, text, label), weighted to the labels' shares in ``counts``."""
    toxic = [t for _, t, y in texts if y == "1"]
    ordinary = [t for _, t, y in texts if y != "1"]
    if not toxic or not ordinary:
        return Model(b"", b"", None)
    pieces = [w for t in ordinary for w in windows(t, 64)]
    order = np.random.default_rng(11).permutation(len(pieces))[:FIT_WINDOWS]
    try:
        body = zstandard.train_dictionary(BODY_BYTES, [pieces[i] for i in order]).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        body = b"".join(pieces[i] for i in order)
    body = body[-BODY_BYTES + 1024 :]
    front = b"".join(widened(f" {w} ".encode()) for w in characteristic_words(toxic, ordinary))[-WORDS_BYTES:]
    model = Model(front + body, body, np.zeros(5))
    margins = model.scorer().margins
    x = np.array([summary(margins(t)) for _, t, _ in texts])
    y = np.array([float(label == "1") for _, _, label in texts])
    share = counts.get("1", 0) / max(1, sum(counts.values()))
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    return Model(model.toxic, model.ordinary, logistic(x, y, weight))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = fit_labels(labels, "toxic")
    return train(*labelled_sample(docs, known, FIT_PER_LABEL, FIT_MAX_CHARS))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, ...).

    Whole texts are scored. Null and empty texts, and texts of white space only, have one margin of 0 and so the score of a text
    that shows nothing toxic. Repeated rows are scored alike; a null doc_id stays null
    (held_out false); an empty table gives no rows; further columns are ignored.
    """

    return predictions(with_scores(docs.select("doc_id", "text"), model.scorer), threshold)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns."""
    return with_scores(docs, model.scorer).filter(F.col("score") < threshold).select("row.*")
