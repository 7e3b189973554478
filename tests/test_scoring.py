from __future__ import annotations

import pandas as pd
import pytest

from tonegap import constants as K
from tonegap.operators import scoring as SC


def _describe(batches):
    for b in batches:
        yield pd.DataFrame({"post_id": b["post_id"], "generated": ["Assistant: love " + bytes(c).decode() for c in b["content"]]})


def _text(batches):
    for b in batches:
        yield pd.DataFrame({"post_id": b["post_id"], "vector": [[float(len(t)), 1.0] for t in b["text"]]})


def _media(batches):
    for b in batches:
        yield pd.DataFrame({"post_id": b["post_id"], "vector": [[float(len(c)), 2.0] for c in b["content"]]})


SCORERS = (
    SC.Scorer("t_describe", ("content",), "generated string", _describe),
    SC.Scorer("t_text", ("text",), "vector array<double>", _text),
    SC.Scorer("t_media", ("content",), "vector array<double>", _media),
)


@pytest.fixture(scope="module")
def inputs(spark):
    records = spark.createDataFrame(
        [(f"p{k}", "neutral", "x" * k, f"/m/{k % 40}") for k in range(60)] + [("lost", "positive", "y", "/m/none"), ("bare", "positive", "z", None)],
        "post_id string, label string, caption string, image_path string",
    )
    media = spark.createDataFrame([(f"/m/{k}", f"file {k}".encode()) for k in range(400)], "path string, content binary")
    return records, media


def test_one_pass_counts_what_it_skips(spark, inputs, tmp_path):
    records, media = inputs
    path = str(tmp_path / "features")
    assert SC.build_features(records, media, path, *SCORERS) == 2
    rows = spark.read.parquet(path)
    assert rows.columns == ["post_id", "label", *K.FEATURE_NAMES]
    assert {r.post_id for r in rows.collect()} == {f"p{k}" for k in range(60)}


def test_no_usable_media_is_an_error(inputs, tmp_path):
    records, media = inputs
    with pytest.raises(FileNotFoundError, match="no usable media"):
        SC.build_features(records.filter("post_id IN ('lost', 'bare')"), media, str(tmp_path / "none"), *SCORERS)


def test_only_named_files_are_scored_and_none_is_exchanged(spark, inputs):
    records, media = inputs
    calls = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in _describe(batches):
            calls.add(len(b))
            yield b

    scan = SC.scan_media(media, SC.Scorer("counting", ("content",), "generated string", counting), SCORERS[2], SC.wanted_paths(records))
    assert {r.path for r in scan.collect()} == {f"/m/{k}" for k in range(40)} and calls.value == 40
    plan = SC.features_one_pass(records, media, *SCORERS)._jdf.queryExecution().executedPlan().toString()
    held = [line for line in plan.splitlines() if "content" in line]
    assert held and not any("Exchange" in line for line in held)
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") <= 6


@pytest.mark.parametrize("scan", ["text", "media"])
def test_a_frame_is_bounded_by_its_bytes(spark, scan):
    rows = spark.range(0, 400, 1, 1).selectExpr("CAST(id AS STRING) AS post_id", "repeat('x', 40000) AS text")
    calls = spark.sparkContext.accumulator(0)
    sizes = []

    def sized(batches):
        for b in batches:
            calls.add(1)
            texts = b["text"] if "text" in b else b["content"]
            yield pd.DataFrame({"post_id": b["post_id"], "vector": [[float(len(b) * len(t)), 1.0] for t in texts]})

    if scan == "text":
        scored = SC.score_text_vector(rows, SC.Scorer("sized", ("text",), "vector array<double>", sized))
        sizes = [r.vector[0] for r in scored.collect()]
    else:
        media = rows.selectExpr("post_id AS path", "CAST(text AS BINARY) AS content")
        records = media.selectExpr("path AS image_path")
        scored = SC.scan_media(media, SCORERS[0], SC.Scorer("sized", ("content",), "vector array<double>", sized), SC.wanted_paths(records))
        assert scored.count() == 400
    assert len(sizes) in (0, 400) and max(sizes, default=0) <= 1.1 * SC.FRAME_BYTES
    assert calls.value >= 400 * 40000 / SC.FRAME_BYTES
