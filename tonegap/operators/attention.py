"""Attention rollout over the long table ``(post_id, layer, head, i, j, w)``.

Matrices are dense: every (i, j) of a post's sequence is present in every layer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegap.session import cut_lineage

FUSIONS = {"mean": F.avg, "max": F.max, "min": F.min}
CHECKPOINT_EVERY = 4


def fuse_heads(attention: DataFrame, fusion: str = "mean") -> DataFrame:
    if fusion not in FUSIONS:
        raise ValueError(f"unknown head fusion {fusion!r}; expected one of {sorted(FUSIONS)}")
    return attention.groupBy("post_id", "layer", "i", "j").agg(FUSIONS[fusion]("w").alias("w"))


def add_residual(fused: DataFrame) -> DataFrame:
    """Identity added, rows scaled to sum 1. A window spans one matrix row, never a post."""
    raised = F.col("w") + (F.col("i") == F.col("j")).cast("double")
    row_sum = F.sum("_w").over(Window.partitionBy("post_id", "layer", "i"))
    scaled = F.col("_w") / F.when(F.col("_sum") == 0, 1.0).otherwise(F.col("_sum"))
    return (
        fused.withColumn("_w", raised)
        .withColumn("_sum", row_sum)
        .withColumn("w", scaled)
        .drop("_w", "_sum")
    )


def _layers(layers: int) -> range:
    if layers < 1:
        raise ValueError("at least one attention layer is required")
    return range(layers)


def _multiply(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left @ right`` per post for ``(post_id, i, j, w)`` tables."""
    a = left.select("post_id", "i", F.col("j").alias("k"), F.col("w").alias("_a"))
    b = right.select("post_id", F.col("i").alias("k"), "j", F.col("w").alias("_b"))
    return (
        a.join(b, ["post_id", "k"])
        .groupBy("post_id", "i", "j")
        .agg(F.sum(F.col("_a") * F.col("_b")).alias("w"))
    )


def _layer(matrices: DataFrame, layer: int) -> DataFrame:
    return matrices.filter(F.col("layer") == layer).drop("layer")


def _prepared(attention: DataFrame, fusion: str, residual: bool) -> DataFrame:
    fused = fuse_heads(attention, fusion)
    return add_residual(fused) if residual else fused


def _product(layers: int):
    """The matrices of one post multiplied, last layer leftmost."""

    def work(table: pa.Table) -> pa.Table:
        layer, i, j, w = (table.column(c).to_numpy() for c in ("layer", "i", "j", "w"))
        size = int(max(i.max(), j.max())) + 1
        result = None
        for n in range(layers):
            own = layer == n
            matrix = np.zeros((size, size))
            matrix[i[own], j[own]] = w[own]
            result = matrix if result is None else matrix @ result
        ids = pa.repeat(table.column("post_id")[0].cast(pa.string()), size * size)
        places = np.divmod(np.arange(size * size, dtype=np.int32), np.int32(size))
        return pa.table([ids, *map(pa.array, places), pa.array(result.ravel())], ["post_id", "i", "j", "w"])

    return work


def rollout(
    attention: DataFrame, layers: int, *, fusion: str = "mean", residual: bool = True
) -> DataFrame:
    """Product of all layers, last layer leftmost: ``(post_id, i, j, w)``.

    The table is dealt out by post once, and heads, residuals and the product all work on that; no row stands for a product
    of two entries. A task holds the matrices of one post, as the model did that made them.
    """
    used = attention.filter(F.col("layer") < _layers(layers).stop).withColumn("post_id", F.col("post_id").cast("string"))
    matrices = _prepared(used.repartition("post_id"), fusion, residual)
    return matrices.select("post_id", "layer", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "w").groupBy("post_id").applyInArrow(
        _product(layers), "post_id string, i int, j int, w double"
    )


def cls_scores(matrix: DataFrame, cls_index: int = 0, seq_len: int | None = None) -> DataFrame:
    """Attribution row of the CLS position."""
    if cls_index < 0 or (seq_len is not None and cls_index >= seq_len):
        raise ValueError(f"cls_index {cls_index} out of bounds")
    return matrix.filter(F.col("i") == cls_index).select("post_id", "j", F.col("w").alias("score"))


def cls_rollout(
    attention: DataFrame,
    layers: int,
    *,
    cls_index: int = 0,
    fusion: str = "mean",
    residual: bool = True,
) -> DataFrame:
    """``cls_scores(rollout(...))`` without the matrix product.

    Only one row of the result is wanted, so the row is pushed through the layers from the
    last one down: sequence² products per layer and post instead of sequence³.
    """
    matrices = _prepared(attention, fusion, residual)
    row = _layer(matrices, _layers(layers)[-1]).filter(F.col("i") == cls_index)
    for step, layer in enumerate(range(layers - 2, -1, -1), start=1):
        row = _multiply(row, _layer(matrices, layer))
        if step % CHECKPOINT_EVERY == 0 and layer > 0:
            row = cut_lineage(row)
    return cls_scores(row, cls_index)


def patch_grid(scores: DataFrame) -> DataFrame:
    """CLS scores without column 0 on a square grid, zero-padded to the next square."""
    patches = scores.filter(F.col("j") >= 1).select(
        "post_id", (F.col("j") - 1).cast("int").alias("p"), "score"
    )
    sizes = patches.groupBy("post_id").agg(F.count("*").alias("n"))
    side = F.ceil(F.sqrt(F.col("n"))).cast("int")
    cells = sizes.withColumn("side", side).select(
        "post_id", "side", F.explode(F.sequence(F.lit(0), F.col("side") * F.col("side") - 1)).alias("p")
    )
    filled = cells.join(patches, ["post_id", "p"], "left")
    return filled.select(
        "post_id",
        F.floor(F.col("p") / F.col("side")).cast("int").alias("row"),
        (F.col("p") % F.col("side")).cast("int").alias("col"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
