"""A corpus pipeline in five stages, each on what its predecessor kept.

Toxic documents go, then those of low quality, then all but one document of each group of near duplicates (runs of
five words, similarity 0.8), then those that hold a benchmark item; the rest is encoded and decoded again. Each stage
takes (spark, docs, folder of the tables) and returns a frame; all but the last return the columns of documents.

A row whose doc_id is null can't be named by a decision: it is judged by score where a stage scores rows, and stays
where a stage names ids. Rows that repeat a doc_id are one document to the stage of near duplicates, which keeps one
of them (the smallest in its other columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonegap.llm import bpe, decontamination, minhash, quality, toxicity
from tonegap.llm.common import read_table, stored
from tonegap.llm.queries import tokenizer_path
from tonegap.plans.registry import Query


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose toxicity score stays below the threshold."""
    model = toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose quality score reaches the threshold."""
    model = quality.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality.good_only(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    kept = minhash.near_duplicates(docs, words=5, percent=80).filter("kept AND doc_id IS NOT NULL")
    ids = kept.select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy(*[c for c in docs.columns if c != "doc_id"])
    named = docs.filter(F.col("doc_id").isNotNull()).join(ids, "doc_id", "left_semi")
    single = named.withColumn("_place", F.row_number().over(one)).filter("_place = 1").drop("_place")
    return single.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark item."""
    found = stored(decontamination.contaminated(docs, read_table(spark, sf_dir, "benchmark")), "leaks")
    leaks = found.filter("doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def codec_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded text."""
    return bpe.digests(bpe.round_trip(docs, tokenizer_path()), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe_codec", codec_stage),
]

#: No stage but the last could be put in SQL: classifiers, sketches and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": Query("pipeline", run, ORACLE_SQL)}
