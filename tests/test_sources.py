from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.sources import lines, media, tables
from tonegap.streaming import jobs


def write(path, *rows):
    path.write_text("\n".join(rows) + "\n", encoding="utf-8")
    return str(path)


def record(**changes):
    base = {"post_id": "a", "caption": "سلام", "image_path": "x.jpg", "label": "neutral", "annotators": ["me"]}
    return json.dumps({**base, **changes}, ensure_ascii=False)


def without(field):
    return json.dumps({k: v for k, v in json.loads(record()).items() if k != field})


def test_labelled_round_trip(spark, tmp_path):
    path = write(tmp_path / "d.jsonl", record(kappa=0.5), "", "  " + record(post_id="b", annotators=None) + " ")
    rows = {r["post_id"]: r for r in lines.read_labelled(spark, path).collect()}
    assert rows["a"]["kappa"] == 0.5 and rows["a"]["annotators"] == ["me"] and rows["a"]["caption"] == "سلام"
    assert rows["b"]["ord"] == 3 and rows["b"]["annotators"] == [] and rows["b"]["kappa"] is None
    out = str(tmp_path / "out")
    assert tables.write_jsonl(lines.read_labelled(spark, path).drop("ord"), out) == 2
    again = {r["post_id"]: r for r in lines.read_labelled(spark, out).collect()}
    assert again["b"]["annotators"] == [] and again["a"]["kappa"] == 0.5


@pytest.mark.parametrize(
    "bad, message",
    [
        (without("label"), r"\[line 2, field label\] missing required field"),
        (without("annotators"), r"\[line 2, field annotators\] missing required field"),
        (record(label="other"), r"\[line 2, field label\] unknown label other"),
        (record(label=None), r"unknown label null"),
        ("{oops", r"\[line 2\] invalid JSON"),
        (record() + "}", r"\[line 2\] invalid JSON"),
        ("[1]", r"\[line 2\] record must be a JSON object"),
    ],
)
def test_strict_reader_names_line_and_field(spark, tmp_path, bad, message):
    path = write(tmp_path / "d.jsonl", record(), bad)
    with pytest.raises(Exception, match=message):
        lines.read_labelled(spark, path).collect()
    valid, errors = lines.validate_records(lines.numbered_lines(spark, path))
    assert valid.count() == 1 and errors.first()["line_no"] == 2


def test_line_numbers_over_splits(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name, n in (("a", 5000), ("b", 3)):
        write(folder / name, *[f"{name} {i} " + "x" * 50 for i in range(1, n + 1)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        out = lines.numbered_lines(spark, str(folder))
        assert out.rdd.getNumPartitions() >= 1
        wrong = out.filter(F.col("line_no") != F.split("value", " ")[1].cast("long"))
        assert wrong.count() == 0 and out.count() == 5003
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_order_over_many_files(spark, tmp_path):
    """Numbers in file names count as numbers, and the last line of the last file wins."""
    from tonegap.operators.annotation import latest_annotation

    folder = tmp_path / "log"
    folder.mkdir()
    event = lambda label: json.dumps({"post_id": "p", "label": label, "annotator_id": "a", "timestamp": "t"})
    write(folder / "part-99999", event("neutral"), "", event("positive"))
    write(folder / "part-100000", event("negative"))
    log = lines.read_audit_log(spark, str(folder))
    assert sorted((r["ord"], r["label"]) for r in log.collect()) == [(1, "neutral"), (3, "positive"), (4, "negative")]
    assert latest_annotation(log).first()["label"] == "negative"
    schema = lines.ST.StructType([lines.ST.StructField("post_id", lines.ST.StringType()), lines.ST.StructField("label", lines.ST.StringType())])
    assert lines.read_checkpoint(spark, str(folder), schema).first()["label"] == "negative"


def test_strict_and_tolerant_readers(spark, tmp_path):
    path = write(tmp_path / "pool.jsonl", '{"post_id": "a"}', '{"post_id": "b"} trailing')
    for read in (lines.read_pool, lines.read_manifest):
        with pytest.raises(Exception, match="invalid JSON"):
            read(spark, path).collect()
    none = spark.createDataFrame([], "post_id string")
    assert [r[0] for r in lines.seen_ids(spark.read.text(path), none).collect()] == ["a"]


def test_lists(spark, tmp_path):
    terms = write(tmp_path / "t", "# comment", "exact", "?part", " * #star ", "~", "")
    got = [(r["term"], r["search"]) for r in lines.read_term_specs(spark, terms).orderBy("ord").collect()]
    assert got == [("exact", False), ("part", True), ("star", True)]
    assert all(r["search"] for r in lines.read_term_specs(spark, terms, search_all=True).collect())
    accounts = write(tmp_path / "a", "@@one", "# no", "two")
    assert [r["account"] for r in lines.read_account_list(spark, accounts).orderBy("ord").collect()] == ["one", "two"]
    links = write(tmp_path / "l", "https://www.instagram.com/reel/ABCDE1/", "ABCDE1", "# x", "FGHIJ", "no!")
    got = [(r["shortcode"], r["kind"]) for r in lines.read_link_list(spark, links).orderBy("ord").collect()]
    assert got == [("ABCDE1", "reel"), ("FGHIJ", "p")]
    ignored = write(tmp_path / "i", "# c", " a ", "b", "a", "")
    assert sorted(r[0] for r in lines.read_ignore_list(spark, ignored).collect()) == ["a", "b"]


def test_media_folder(spark, tmp_path):
    for name, text in {
        "p1.JPG": "x", "p1.caption": "second", "p1.txt": " first ", "p2.webp": "x", "p2.caption": "only", "p3.png": "x", "n.gif": "x",
    }.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = {r["post_id"]: (r["caption"], os.path.basename(r["image_path"])) for r in media.read_media_folder(spark, str(tmp_path)).collect()}
    assert got == {"p1": ("first", "p1.JPG"), "p2": ("only", "p2.webp"), "p3": ("", "p3.png")}


def test_empty_audit_log(spark, tmp_path):
    assert lines.read_audit_log(spark, str(tmp_path / "none")).count() == 0


def test_vector_table_versions(spark, tmp_path):
    path = str(tmp_path / "vectors")

    def batch(*ids):
        cols = [f"array(1.0f) AS {c}" for c in K.VECTOR_ROW_FIELDS[2:]]
        return spark.createDataFrame([(i, "neutral") for i in ids], "post_id string, label string").selectExpr("*", *cols)

    assert tables.fetch_vectors(spark, path) is None
    tables.upsert_vectors(batch("a", "b"), path)
    before = tables.fetch_vectors(spark, path)
    tables.upsert_vectors(batch("b", "c", "c"), path)
    assert before.count() == 2
    assert sorted(r["post_id"] for r in tables.fetch_vectors(spark, path).collect()) == ["a", "b", "c", "c"]
    with pytest.raises(KeyError, match="label"):
        tables.upsert_vectors(batch("a").drop("label"), path)


def test_stream_replay_is_idempotent(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "vectors")
    cols = [f"array(1.0f) AS {c}" for c in K.VECTOR_ROW_FIELDS[2:]]
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "post_id string, label string").selectExpr("*", *cols)
    rows.write.parquet(source)
    stream = jobs.file_stream(spark, source, rows.schema)
    for run in ("one", "two"):
        jobs.stream_upsert(stream, path, str(tmp_path / run)).awaitTermination()
    assert tables.fetch_vectors(spark, path).count() == 2


def test_lines_are_stored_in_as_many_parts_as_they_are_read_in(spark, tmp_path):
    from tonegap.plans.io_queries import _store_in_parts

    rows = spark.range(0, 900, 1, 9).selectExpr("id AS ord", "CAST(id AS STRING) AS value")
    path = _store_in_parts(rows, "ord", str(tmp_path / "many"))
    assert len(spark.read.text(path).inputFiles()) == 9
    assert [r.value for r in lines.numbered_lines(spark, path).orderBy("ord").collect()] == [str(k) for k in range(900)]
    assert len(spark.read.text(_store_in_parts(rows.coalesce(1), "ord", str(tmp_path / "few"))).inputFiles()) == 3
