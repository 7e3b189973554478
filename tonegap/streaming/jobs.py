"""Arriving files as micro-batches: upserts, predictions, running counts (admission has a module of its own)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.streaming import StreamingQuery

from tonegap import constants as K
from tonegap.operators.predict import predict_table
from tonegap.sources.tables import upsert_vectors


def file_stream(
    spark: SparkSession, folder: str, schema: ST.StructType | str, fmt: str = "parquet", **options
) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).format(fmt).load(folder)


def stream_upsert(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is upserted into the vector table, once: the table remembers the number of the stream's last one."""

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            upsert_vectors(batch, path, writer=checkpoint, number=number)

    return _start(rows, checkpoint, lambda writer: writer.foreachBatch(apply))


def stream_predict(features: DataFrame, proba: str = "proba") -> DataFrame:
    """Predictions of a feature stream; stateless."""
    return predict_table(features, proba)


def stream_agreement(log: DataFrame) -> DataFrame:
    """Running number of valid annotations per annotator."""
    name = F.coalesce(F.nullif(F.col("annotator_id"), F.lit("")), F.lit(K.UNKNOWN_ANNOTATOR))
    valid = log.filter(F.col("label").isin(*K.LABELS))
    return valid.groupBy(name.alias("annotator_id")).agg(F.count("*").alias("n"))


def _start(df: DataFrame, checkpoint: str, sink: Callable) -> StreamingQuery:
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return sink(writer).start()


def append_to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return _start(df, checkpoint, lambda w: w.outputMode("append").format("parquet").option("path", path))


def update_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Changed groups of an aggregation, tagged with the micro-batch that changed them."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return _start(df, checkpoint, lambda w: w.outputMode("update").foreachBatch(apply))


def latest_counts(changes: DataFrame) -> DataFrame:
    """Current state of an update log: the value of the newest micro-batch per annotator."""
    return changes.groupBy("annotator_id").agg(F.max_by("n", "batch").alias("n"))
