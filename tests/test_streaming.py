from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from tonegap.operators import gates as G
from tonegap.streaming import admission, jobs

SCHEMA = "ord long, post_id string, caption string, media_ok boolean, face_ok boolean"
GOOD, SPAM = "سلام دنیای زیبا", "پرامپت بفرستید دایرکت"


class Arriving:
    """A folder into which files come one by one, and the posts that were accepted of them."""

    def __init__(self, spark, folder, rules=G.FEED, lateness="10 seconds", timed=True, **more):
        self.spark, self.folder, self.n = spark, str(folder), 0
        os.makedirs(f"{self.folder}/in")
        schema = f"{SCHEMA}, posted timestamp"
        posts = jobs.file_stream(spark, f"{self.folder}/in", schema, maxFilesPerTrigger=1)
        seen = spark.createDataFrame([("known",)], "post_id string")
        more |= {"event_time": "posted", "lateness": lateness} if timed else {}
        self.stream = admission.stream_ingest(posts, rules, seen, media_ok=F.col("media_ok"), face_ok=F.col("face_ok"), **more)

    def add(self, *rows):
        """A file of (ord, id, caption, media, face); a post's time is its order in seconds."""
        frame = self.spark.createDataFrame(list(rows), SCHEMA).withColumn("posted", F.timestamp_seconds("ord"))
        frame.coalesce(1).write.parquet(f"{self.folder}/tmp{self.n}")
        name = next(n for n in os.listdir(f"{self.folder}/tmp{self.n}") if n.endswith(".parquet"))
        at = time.time() + self.n
        os.utime(f"{self.folder}/tmp{self.n}/{name}", (at, at))
        os.link(f"{self.folder}/tmp{self.n}/{name}", f"{self.folder}/in/{self.n}.parquet")
        self.n += 1
        return self

    def beat(self, at):
        return self.add((at, None, "", True, True))

    def run(self):
        query = jobs.append_to_parquet(self.stream, f"{self.folder}/out", f"{self.folder}/checkpoint")
        query.awaitTermination()
        self.progress = query.lastProgress
        out = self.spark.read.schema("post_id string, ord long, at long, caption string").parquet(f"{self.folder}/out")
        return sorted((r.post_id, r.ord) for r in out.collect())


def test_the_earliest_row_decides_in_one_batch_and_over_files(spark, tmp_path):
    files = Arriving(spark, tmp_path)
    files.add((5, "a", GOOD, True, True), (3, "a", GOOD, True, True), (4, "b", GOOD, True, True), (2, "b", GOOD, True, False))
    files.add((9, "c", GOOD, True, True), (1, "known", GOOD, True, True)).add((6, "c", GOOD, True, True), (7, "d", "", True, True))
    assert files.beat(1000).run() == [("a", 3), ("c", 6)]  # b: no face comes first; d: no words


def test_what_is_decided_stays_decided(spark, tmp_path):
    files = Arriving(spark, tmp_path).add((5, "a", GOOD, True, False)).beat(100)
    assert files.run() == []
    files.add((200, "a", GOOD, True, True), (201, "b", GOOD, True, True)).beat(1000)
    assert files.run() == [("b", 201)]  # a was settled by the row without a face, in a run before


def test_nothing_leaves_before_the_watermark(spark, tmp_path):
    files = Arriving(spark, tmp_path).add((50, "a", GOOD, True, True)).add((55, "b", GOOD, True, True))
    assert files.run() == []
    files.add((46, "a", GOOD, True, False)).beat(70)  # late, but not too late: the watermark is 45
    assert files.run() == [("b", 55)]
    files.add((60, "c", GOOD, True, True), (59, "late", GOOD, True, True), (500, "d", GOOD, True, True)).beat(900)
    assert files.run() == [("b", 55), ("d", 500)]  # behind the watermark of 60: dropped


@pytest.mark.parametrize(("remember", "want"), [(None, [("a", 1)]), (50_000, [("a", 1), ("a", 300)])])
def test_marks_go_at_their_age(spark, tmp_path, remember, want):
    files = Arriving(spark, tmp_path, remember_ms=remember).add((1, "a", GOOD, True, True)).beat(20).beat(200)
    files.add((300, "a", GOOD, True, True)).beat(330)
    assert files.run() == want
    files.beat(2000).beat(3000)
    files.run()
    left = files.progress.stateOperators[0].numRowsTotal
    assert left == (1 if remember is None else 0)


def test_without_times_arrival_decides(spark, tmp_path):
    files = Arriving(spark, tmp_path, timed=False)
    files.add((5, "a", GOOD, True, True), (4, "a", GOOD, True, True), (9, "b", GOOD, True, False)).add((1, "a", GOOD, True, True), (2, "b", GOOD, True, True))
    assert files.run() == [("a", 4)]


@pytest.mark.parametrize("rules", [G.FEED, G.LOCAL, G.EMBED])
def test_is_the_batch_gate(spark, tmp_path, rules):
    captions = [GOOD, SPAM, "", "hello world only latin", GOOD + " !"]
    rows = [(i, f"p{i * 7 % 11}", captions[i * 5 % 7 % 5], i % 4 != 1, i % 5 != 2) for i in range(1, 41)]
    files = Arriving(spark, tmp_path, rules)
    for part in range(4):
        files.add(*rows[part * 10 : part * 10 + 10][::-1])
    got = files.beat(500).run()
    seen = spark.createDataFrame([("known",)], "post_id string")
    batch = G.gate(spark.createDataFrame(rows, SCHEMA), rules, seen=seen, media_ok=F.col("media_ok"), face_ok=F.col("face_ok"))
    assert got == sorted((r.post_id, r.ord) for r in batch.collect())


def test_a_stretch_of_posts_is_many_files(spark, tmp_path):
    from tonegap.plans import QUERIES, scoring_queries

    captions = [GOOD, SPAM, GOOD + " خوبی"]
    docs = [(k, captions[k % 3], "fa" if k % 4 else "xx", "web", 20 + k * 7 % 50) for k in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "x" * 30)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder, _, lateness, files = scoring_queries._arriving_posts(spark, str(tmp_path))
    assert lateness == 100 and files > 1
    assert sum(1 for f in spark.read.parquet(folder).inputFiles()) > 4 * (files - 1)
    got = QUERIES["stream_ingest"].build(spark, str(tmp_path)).select("gate", "ord", "post_id").collect()
    posts, seen = scoring_queries.I.grouped_posts(spark, str(tmp_path)), scoring_queries.I.seen_posts(spark, str(tmp_path))
    want = {
        (name, r.ord, r.post_id)
        for name, rules in scoring_queries.GATES.items()
        for r in G.gate(posts, rules, seen=seen, media_ok=F.col("media_ok"), face_ok=F.col("face_ok")).collect()
    }
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_a_table_may_be_a_folder_of_files(spark, tmp_path):
    from tonegap.plans import QUERIES

    vectors = spark.createDataFrame([(k, k % 3, [float(k)] * 4) for k in range(30)], "vec_id long, label int, embedding array<float>")
    vectors.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r.label: r.n for r in QUERIES["stream_upsert"].build(spark, str(tmp_path)).collect()} == {"0": 10, "1": 10, "2": 10}
    events = spark.createDataFrame([(k, 1 + k % 2, "view", 1.0) for k in range(10)], "event_id long, user_id long, event_type string, value double")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert {r.annotator_id: r.n for r in QUERIES["stream_agreement"].build(spark, str(tmp_path)).collect()} == {"u1": 5, "u2": 5}
