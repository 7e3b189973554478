"""Language by nearest centroid: TF-IDF vectors of byte n-grams against several centroids per language.

Vectors count hashed pairs and triples of bytes of the lower-cased text with ASCII non-letters as spaces;
counts enter by their logarithm, weighted by inverse document frequency over all documents that may
be learned from. Each language's sample is clustered on the unit sphere; a text takes the language of
the centroid with the largest cosine, and is marked as rejected when that cosine is smaller than nearly
all of the cluster's own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegap.llm.common import arrow_map, held_out, labelled_sample

#: Documents per language and characters per document used for centroids; frequencies use all.
FIT_PER_LABEL, FIT_MAX_CHARS = 600, 20_000
BINS, CENTROIDS, ROUNDS = 4096, 4, 12
#: Share of a cluster's own texts that lie beyond its rejection distance.
REJECT_SHARE = 0.01
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of the byte pairs and triples of a whole text."""
    raw = (b" " + text.lower().encode("utf-8", "replace") + b" ").translate(_FOLD)
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    pairs = x[:-1] << np.uint32(8) | x[1:]
    triples = (pairs[:-1] << np.uint32(8) | x[2:]) + np.uint32(1 << 24)
    codes = np.concatenate([pairs, triples]) * np.uint32(2654435761) >> np.uint32(20)
    return np.bincount(codes, minlength=BINS)


def unit_vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / max(np.sqrt(v @ v), 1e-12)


def clustered(vectors: np.ndarray, k: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of spherical k-means and the rejection cosine of each."""
    rng = np.random.default_rng(seed)
    centres = vectors[[int(rng.integers(len(vectors)))]]
    while len(centres) < min(k, len(vectors)):  # the farthest vector comes next
        centres = np.r_[centres, vectors[[int((vectors @ centres.T).max(1).argmin())]]]
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(1)
        sums = np.stack([vectors[own == c].sum(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.sqrt((sums**2).sum(1, keepdims=True)), 1e-12)
    near = vectors @ centres.T
    own = near.argmax(1)
    return centres, np.array([np.quantile(near[own == c, c], REJECT_SHARE) if (own == c).any() else 1.0 for c in range(len(centres))])


@dataclass
class Model:
    """Inverse frequencies, centroids, the language and rejection cosine of each centroid."""

    idf: np.ndarray
    centres: np.ndarray
    languages: list[str]
    floors: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected); unknown if there is no letter or nothing was learned."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        near = self.centres @ unit_vector(gram_counts(text), self.idf)
        best = int(near.argmax())
        return self.languages[best], float(min(1.0, max(0.0, near[best]))), bool(near[best] < self.floors[best])


def document_frequencies(known: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all given texts each bin occurs, and the number of texts."""

    def make():
        def work(batch):
            seen = np.zeros(BINS, np.int64)
            for text in batch.column("text").to_pylist():
                seen += gram_counts(text) > 0
            return {"seen": [seen], "texts": [batch.num_rows]}

        return work

    parts = arrow_map(known.filter(F.col("text").isNotNull()), ["text"], "seen array<long>, texts long", make)
    rows = (
        parts.select(F.posexplode(F.concat("seen", F.array("texts"))).alias("bin", "n"))
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    out = np.zeros(BINS + 1, np.int64)
    for r in rows:
        out[r.bin] = r.n
    return out[:BINS], int(out[BINS])


def train(texts: list[tuple[int, str, str]], seen: np.ndarray, n: int) -> Model:
    idf = np.log((1 + n) / (1 + seen)) + 0.05
    centres, languages, floors = [], [], []
    for language in sorted({y for *_, y in texts}):
        vectors = np.stack([unit_vector(gram_counts(t), idf) for _, t, y in texts if y == language])
        c, f = clustered(vectors, CENTROIDS)
        centres, languages, floors = [*centres, c], [*languages, *[language] * len(c)], [*floors, f]
    if not languages:
        return Model(idf, np.zeros((0, BINS)), [], np.zeros(0))
    return Model(idf, np.concatenate(centres), languages, np.concatenate(floors))


def fit(docs: DataFrame) -> Model:
    """Learn from the rows with text and language whose id is not held out."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("label")).filter(
        F.col("text").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id")
    )
    texts, _ = labelled_sample(docs, known.select("doc_id", "label").filter(F.col("doc_id").isNotNull()), FIT_PER_LABEL, FIT_MAX_CHARS)
    return train(texts, *document_frequencies(known))


def identify_language(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs`` (doc_id, text, ...).

    Null and empty texts and texts without a letter are ``und`` with score 0 and rejected; so is everything if nothing
    could be learned. Repeated rows are judged alike; a null doc_id stays null (held_out
    false); an empty table gives no rows; further columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bins times centroids, whatever the data

    def make():
        predict = shipped.value.predict

        def work(batch):
            found = [predict(t) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id")} | dict(zip(("lang_pred", "score", "rejected"), map(list, zip(*found))))

        return work

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, lang_pred string, score double, rejected boolean"
    return arrow_map(source, ["doc_id", "text"], schema, make).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected"
    )
