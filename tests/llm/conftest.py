from __future__ import annotations

import pytest

#: A table of documents with everything that may go wrong in it, and columns whose names operators use themselves.
LONG = "word " * 40_000 + "end"
DOCS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank"),
    (2, "THE quick brown fox jumps over the lazy dog near the river bank"),
    (2, "THE quick brown fox jumps over the lazy dog near the river bank"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, LONG),
    (7, "x" * 100_000),
    (None, "the quick brown fox jumps over the lazy dog near the river bank"),
    (None, None),
    (8, "12345 +-*/ ??"),
    (9, "Ünïcödé ́ ΑΣ \U0001f600 <|endoftext|> it's"),
]
COLUMNS = "doc_id long, text string, lang string, score double, node string, comp long, label string, row string, keys string, path string"


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame([(*r, "en" if r[0] == 1 else None, 0.5, "n", 1, "l", "r", "k", "p") for r in DOCS], COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
