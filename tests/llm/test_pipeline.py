from __future__ import annotations

import corpus_pipeline as pipeline
from tonegap.llm import decontamination, minhash

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "bpe_codec":
            assert out.columns == columns
        kept[name], before, docs = set(ids), docs, out
        if name == "near_dedup":
            assert set(ids) == {r.doc_id for r in minhash.near_duplicates(before).filter("kept").collect()}
        if name == "decontamination":
            leaks = decontamination.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert {r.doc_id for r in before.select("doc_id").collect()} - set(ids) == {r.doc_id for r in leaks.collect()}
    clean = [i for i, r in labels.items() if not r.toxic and r.quality]
    assert len(kept["quality"] & set(clean)) > 0.95 * len(clean)
    bad = [i for i, r in labels.items() if not r.quality]
    assert len(kept["quality"] & set(bad)) < 0.1 * len(bad)
    assert kept["bpe_codec"] == kept["decontamination"]


def test_messy_rows(spark, messy, nothing):
    for name, stage in pipeline.STAGES:
        for docs in (messy, nothing):
            out = stage(spark, docs, SF)
            rows = out.collect()
            if name != "bpe_codec":
                assert out.columns == docs.columns
            if docs is nothing:
                assert rows == []
    deduped = [r.doc_id for r in pipeline.near_dedup_stage(spark, messy, SF).collect()]
    assert sorted(map(str, deduped)) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, 9, None, None]))
