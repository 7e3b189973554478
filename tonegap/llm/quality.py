"""Quality by supervised subword embeddings: averaged hashed word and n-gram vectors under a softmax.

Every word has a vector of its own and one for each of its character n-grams (over bytes, with word
boundaries marked), all in hashed tables; a word that repeats the one before it adds the vector of a
word of its own, ``AGAIN``, so often that it weighs as much as the n-grams. A document is the mean over all its words' vectors; a
linear layer and a softmax give the classes. Vectors and layer are learned together by stochastic
gradient descent in numpy on a bounded sample of labelled documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegap.llm.common import fit_labels, labelled_sample, predictions, with_scores

#: Documents per label and characters per document that the fit may use.
FIT_PER_LABEL, FIT_MAX_CHARS = 1500, 20_000
#: Rows of the table of words, rows of the table of n-grams, n-gram lengths, size of a vector.
WORD_ROWS, GRAM_ROWS, GRAMS, SIZE = 1 << 15, 1 << 15, (3, 4), 12
EPOCHS, RATE = 6, 2.0
#: Word that stands for a repetition (no word holds white space), and how often it then counts.
AGAIN, AGAIN_TIMES = zlib.crc32(b" again") % WORD_ROWS, 8
#: Words whose vectors a task remembers from one document to the next.
KEPT_WORDS = 200_000


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def word_rows(word: bytes) -> list[int]:
    """Rows of a word and its n-grams in the joint table."""
    marked = b"<" + word + b">"
    rows = [zlib.crc32(word) % WORD_ROWS]
    for n in GRAMS:
        rows += [WORD_ROWS + zlib.crc32(marked[i : i + n]) % GRAM_ROWS for i in range(len(marked) - n + 1)]
    return rows


def document_rows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a whole text and their shares of all its features."""
    counts: Counter = Counter()
    words = split_words(text)
    if again := sum(a == b for a, b in zip(words, words[1:])):
        counts[AGAIN] = AGAIN_TIMES * again
    for word, n in Counter(words).items():
        for row in word_rows(word):
            counts[row] += n
    rows = np.fromiter(counts.keys(), np.int64, len(counts))
    shares = np.fromiter(counts.values(), np.float32, len(counts))
    return rows, shares / max(1.0, shares.sum())


@dataclass
class Model:
    """Vectors, layer and class names. Without a labelled row there is no class: score 0."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    classes: list[str]

    def scorer(self):
        """Function of a text: the probabilities of the classes, in their order."""
        place: dict[bytes, int] = {}
        table = np.zeros((1024, SIZE + 1), np.float32)

        def learn(new: list[bytes]) -> None:
            """Add the sums of the vectors of words to the table."""
            nonlocal table
            rows = list(map(word_rows, new))
            sizes = np.array(list(map(len, rows)))
            at = len(place)
            while at + len(new) > len(table):
                table = np.concatenate([table, np.zeros_like(table)])
            flat = np.fromiter(chain.from_iterable(rows), np.int64, sizes.sum())
            table[at : at + len(new), :SIZE] = np.add.reduceat(self.vectors[flat], np.cumsum(sizes) - sizes, axis=0)
            table[at : at + len(new), SIZE] = sizes
            place.update(zip(new, range(at, at + len(new))))

        def probabilities(text: str | None) -> np.ndarray:
            nonlocal table
            words = split_words(text)
            if len(place) > KEPT_WORDS:
                place.clear()
                table = np.zeros((1024, SIZE + 1), np.float32)
            if new := [w for w in dict.fromkeys(words) if w not in place]:
                learn(new)
            at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            total = table[at].sum(0, dtype=np.float64)
            again = AGAIN_TIMES * int((at[1:] == at[:-1]).sum())
            total[:SIZE] += again * self.vectors[AGAIN]
            total[SIZE] += again
            z = (total[:SIZE] / max(1.0, total[SIZE])) @ self.layer + self.bias
            e = np.exp(z - z.max())
            return e / e.sum()

        return probabilities


def train(texts: list[tuple[int, str, str]], counts: dict[str, int], seed: int = 5) -> Model:
    """Fit on (doc_id, text, label); each label weighs as much as its share in ``counts``."""
    classes = sorted(counts)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (WORD_ROWS + GRAM_ROWS, SIZE)).astype(np.float32)
    layer, bias = np.zeros((SIZE, len(classes)), np.float32), np.zeros(len(classes), np.float32)
    drawn = Counter(label for *_, label in texts)
    weight = {c: counts[c] / sum(counts.values()) * len(texts) / max(1, drawn[c]) for c in classes}
    examples = [(*document_rows(t), classes.index(y), weight[y]) for _, t, y in texts]
    steps, step = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            rows, shares, y, w = examples[k]
            rate = RATE * (1 - step / steps) * min(w, 4.0)
            step += 1
            hidden = shares @ vectors[rows]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            vectors[rows] -= rate * shares[:, None] * back
    return Model(vectors, layer, bias, classes)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*labelled_sample(docs, fit_labels(labels, "quality"), FIT_PER_LABEL, FIT_MAX_CHARS))


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, ...).

    score is the probability of class "1" (0 if no such label was seen). Null and empty texts have no words: their
    mean is the zero vector and the constant of the layer decides. Repeated rows are scored alike; a null
    doc_id stays null (held_out false); an empty table gives no rows; further columns are ignored.
    """
    return predictions(_scored(docs.select("doc_id", "text"), model), threshold)


def good_only(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    return _scored(docs, model).filter(F.col("score") >= threshold).select("row.*")


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: the two hashed tables

    def make():
        model = shipped.value
        at = model.classes.index("1") if "1" in model.classes else None
        score = model.scorer()
        return lambda text: 0.0 if at is None else float(score(text)[at])

    return with_scores(docs, make)
