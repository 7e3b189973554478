from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

from tonegap.llm import language, quality, toxicity
from tonegap.llm.common import read_table
from tonegap.llm.queries import QUERIES

SF = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.1")


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity", "toxic", 0.95), ("op6_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    rows = QUERIES[name].build(spark, SF).join(read_table(spark, SF, "labels"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) for r in rows)
    y = np.array([r[label] for r in rows if r.held_out])
    p = np.array([r.score for r in rows if r.held_out])
    above = (p[y == 1][:, None] > p[y == 0]).mean() + 0.5 * (p[y == 1][:, None] == p[y == 0]).mean()
    assert above > least
    limit = {"toxic": 0.3, "quality": 0.7}[label]
    assert all(r.predicted == (r.score >= limit) and 0 <= r.score <= 1 for r in rows)


def test_languages(spark):
    rows = QUERIES["op9_language"].build(spark, SF).join(read_table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in own]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_messy_rows(spark, messy, nothing, no_labels):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (6, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for known in (labels, no_labels):
        for score in (
            lambda d: toxicity.score_toxicity(d, toxicity.fit(messy, known)),
            lambda d: quality.score_quality(d, quality.fit(messy, known)),
        ):
            rows = score(messy).collect()
            assert len(rows) == messy.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
            same = [r.score for r in rows if r.doc_id == 2]
            assert same[0] == same[1]
            assert score(nothing).count() == 0
    model = toxicity.fit(messy, labels)
    assert toxicity.without_toxic(messy, model).columns == messy.columns
    assert quality.good_only(messy, quality.fit(messy, labels)).columns == messy.columns


def test_messy_languages(spark, messy, nothing):
    rows = language.identify_language(messy, language.fit(messy)).collect()
    by_id = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == messy.count() and by_id[1] == "en"
    assert all(by_id[i] == "und" for i in (3, 4, 5, 8))
    assert language.identify_language(nothing, language.fit(nothing)).count() == 0
    assert {r.lang_pred for r in language.identify_language(messy, language.fit(nothing)).collect()} == {"und"}


def test_windows_cover_the_text():
    text = "alpha beta " * 500 + "y" * 1000
    raw = b" " + " ".join(text.split()).encode() + b" "
    pieces = toxicity.windows(text)
    assert sum(len(p) // 2 for p in pieces) == len(raw) - 1
    assert toxicity.windows("") == toxicity.windows(None)


def test_a_language_of_long_texts_only_is_learned(spark):
    """Long texts are used in pieces, and texts that can't be used take nobody's place."""
    english, german = "the cat sat on the mat and looked at the dog ", "der hund lief durch den wald und sah die katze nicht "
    rows = [(k, english * 3, "en") for k in range(0, 120, 3)] + [(k, german * 500, "de") for k in range(1, 120, 3)]
    rows += [(k, None, "fr") for k in range(2, 120, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert set(model.languages) == {"de", "en"}
    found = {r.doc_id: r.lang_pred for r in language.identify_language(docs, model).collect()}
    assert all(found[k] == {"en": "en", "de": "de", "fr": "und"}[lang] for k, _, lang in rows)
