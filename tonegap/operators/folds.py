"""Stratified folds and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.operators.keyed import ranked_by_hash


def stratified_folds(
    df: DataFrame,
    *,
    label: str = "label",
    key: str = "post_id",
    k: int = K.N_FOLDS,
    seed: int = 0,
    hex_digits: int | None = None,
) -> DataFrame:
    """Append ``fold`` (1..k): every class is dealt out evenly in a seeded hash order."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))
    ranked = ranked_by_hash(df, label, digest, key, "_dealt", hex_digits)
    return ranked.withColumn("fold", (F.col("_dealt") % k + 1).cast("int")).drop("_dealt")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (classes * n_class) per class, from one aggregation."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"))).scalar()
    weight = totals.getField("rows") / (totals.getField("classes") * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))
