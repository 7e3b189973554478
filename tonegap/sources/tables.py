"""Feature tables, the vector table, and the file sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.operators.keyed import anti_seen
from tonegap.operators.scoring import read_stage
from tonegap.sources.store import BUCKETS, KeyedStore


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """JSON lines with explicit nulls; the row count is observed by the writing job itself."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def append_rows(df: DataFrame, path: str) -> int:
    return write_jsonl(df, path, mode="append")


def new_ids(candidates: DataFrame, known: DataFrame, key: str = "post_id") -> DataFrame:
    return anti_seen(candidates.select(key).distinct(), known, key)


def append_new_ids(candidates: DataFrame, known: DataFrame, path: str, key: str = "post_id") -> None:
    """Unknown ids, sorted, appended to a text list."""
    new_ids(candidates, known, key).orderBy(key).write.mode("append").text(path)


def write_features(features: DataFrame, path: str) -> None:
    features.select("post_id", "label", *K.FEATURE_NAMES).write.mode("overwrite").parquet(path)


def load_or_build_features(
    spark: SparkSession, path: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """The stored feature table, computed and stored first when it does not exist."""
    stored = read_stage(spark, path)
    if stored is None:
        write_features(build(), path)
        stored = spark.read.parquet(path)
    return stored


def vector_row(available: list[str]) -> list[Column]:
    missing = [c for c in K.VECTOR_ROW_FIELDS if c not in available]
    if missing:
        raise KeyError(f"vector row is missing required field {missing[0]!r}")
    return [F.col(c) for c in K.VECTOR_ROW_FIELDS]


def fetch_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the newest version, None before the first upsert."""
    return KeyedStore(spark, path).read()


def upsert_vectors(
    batch: DataFrame, path: str, *, writer: str | None = None, number: int = 0, buckets: int = BUCKETS
) -> DataFrame:
    """Replace or add rows by id; only the files of the batch's own buckets are added to.

    Readers keep the version they started with; a failed write shows nowhere. A ``writer`` that numbers its
    batches may send one again without effect.
    """
    spark = batch.sparkSession
    store = KeyedStore(spark, path, "post_id", buckets)
    return store.read(store.upsert(batch.select(*vector_row(batch.columns)), writer, number))


def write_metric_table(table: DataFrame, footer: DataFrame, path: str) -> None:
    """One CSV report: fold rows, the mean row, then a ``# key`` row per footer with its value beside it.

    This is the form that the report reader understands.
    """
    first, value, *others = table.columns
    notes = footer.select(
        F.concat(F.lit("# "), "key").alias(first),
        F.col("value").cast("string").alias(value),
        *[F.lit(None).cast("string").alias(c) for c in others],
    )
    rows = table.select(*[F.col(c).cast("string").alias(c) for c in table.columns])
    rows.unionByName(notes).write.mode("overwrite").option("header", True).csv(path)
