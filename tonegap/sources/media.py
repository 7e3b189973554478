"""Media folders: listings, caption sidecars, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegap.functions.text import strip_ws
from tonegap.operators.gates import media_type_ok


def list_media(spark: SparkSession, folder: str, *, content: bool = False) -> DataFrame:
    """Files of a folder; contents are only read when asked for."""
    files = spark.read.format("binaryFile").load(folder)
    listed = files.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    columns = ["path", "length"] + (["content"] if content else [])
    return listed.filter(media_type_ok(F.col("path"))).select(*columns)


def list_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Caption files next to the media, one row per file."""
    texts = spark.read.options(wholetext="true", pathGlobFilter="*.{txt,caption}").text(folder)
    return texts.select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"),
        F.col("value").alias("text"),
    )


def media_candidates(listing: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``(post_id, caption, image_path)``: the stem is the id, a .txt beats a .caption."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    suffix = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    captions = (
        sidecars.filter(suffix.isin(".txt", ".caption"))
        .select(stem("path").alias("_stem"), F.when(suffix == ".txt", 0).otherwise(1).alias("_rank"), "text")
        .groupBy("_stem")
        .agg(F.min_by("text", "_rank").alias("text"))
    )
    files = listing.filter(media_type_ok(F.col("path"))).select(
        F.col("path").alias("image_path"), stem("path").alias("_stem")
    )
    return files.join(captions, "_stem", "left").select(
        F.regexp_extract("_stem", "([^/]*)$", 1).alias("post_id"),
        strip_ws(F.coalesce("text", F.lit(""))).alias("caption"),
        "image_path",
    )


def read_media_folder(spark: SparkSession, folder: str) -> DataFrame:
    return media_candidates(list_media(spark, folder), list_sidecars(spark, folder))
