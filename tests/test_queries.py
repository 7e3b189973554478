"""Every registered query beside its SQL twin on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tests.compare import compare, connect
from tonegap.plans import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problems, _ = compare(spark, con, QUERIES[name], SF)
    assert not problems


def test_plans_do_not_depend_on_the_number_of_partitions(spark, con):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for name in ("gate_feed", "majority_label", "stratified_folds", "merge_tokens", "dsem_rule", "stage_timing_summary"):
            assert not compare(spark, con, QUERIES[name], SF)[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "review_table" in entry.queries()


def test_annotator_pairs_gives_a_row_per_shared_post(spark, tmp_path):
    rows = [(k, k, "2024-01-01 00:00:00", "view", 1.0) for k in (1, 2, 3)] + [(40 + k, k, "2024-01-01 00:00:00", "view", 1.0) for k in (1, 2)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double")
    events.withColumn("ts", events.ts.cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    got = [(r.post_id, r.annotator_a, r.annotator_b) for r in QUERIES["annotator_pairs"].build(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("0", "u1", "u2"), ("0", "u1", "u3"), ("0", "u2", "u3"), ("5", "u1", "u2")]
