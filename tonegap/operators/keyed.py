"""Key-based building blocks: dedup, anti-joins, overlays, ranks and running sums.

A key may hold a large share of all rows, so nothing here sends a whole key to one task
unless its rows were reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Append a costly column so that it is computed once per row.

    A filter on a projected column is pushed below the projection and evaluates the whole
    expression a second time. Nothing is pushed below a generator, so the value travels as
    the only element of an exploded array.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def _ranked(df: DataFrame, keys: list[str | Column], order: list[Column], n: int) -> DataFrame:
    """``row_number <= n``: Spark keeps at most n rows per key in each map task before the
    shuffle (window group limit), so a hot key costs n rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)


def first_wins(df: DataFrame, keys: list[str | Column], ord_col: str = "ord") -> DataFrame:
    return _ranked(df, keys, [F.col(ord_col).asc()], 1).drop("_rank")


def last_wins(df: DataFrame, keys: list[str | Column], ord_col: str = "ord") -> DataFrame:
    return _ranked(df, keys, [F.col(ord_col).desc()], 1).drop("_rank")


def top_n_per_group(
    df: DataFrame, keys: list[str | Column], order: list[Column], n: int
) -> DataFrame:
    return _ranked(df, keys, order, n).drop("_rank")


def anti_seen(df: DataFrame, seen: DataFrame, key: str = "post_id") -> DataFrame:
    """Rows whose id is not known yet. The join strategy is left to the runtime sizes."""
    return df.join(seen.select(key), key, "left_anti")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def overlay(base: DataFrame, top: DataFrame, key: str = "post_id") -> DataFrame:
    """``top`` replaces ``base`` per key, row by row."""
    top = top.select(*base.columns)
    return base.join(top.select(key), key, "left_anti").unionByName(top)


def upsert(target: DataFrame | None, batch: DataFrame, key: str = "post_id") -> DataFrame:
    """Rows of ``target`` whose key is in ``batch`` are replaced by all rows of ``batch``."""
    if target is None:
        return batch
    kept = target.join(batch.select(key), key, "left_anti")
    return kept.unionByName(batch.select(*target.columns))


def group_stats_join(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Attach per-group aggregates by pre-aggregation and an equi-join.

    Unlike a window over the group this never sorts a whole group in one task: the aggregate
    is combined map-side and a skewed join partition is split by adaptive execution.
    """
    stats = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggregates.items()])
    return df.join(stats, keys)


def running_sum(
    df: DataFrame, keys: list[str], pos: str, value: Column, name: str, block: int = 4096
) -> DataFrame:
    """Inclusive running sum of ``value`` by ``pos`` within ``keys``, for groups of any size.

    Positions are cut into blocks. The window runs inside one block, and each block receives
    the sum of the blocks before it from a table ``block`` times smaller than the input.
    """
    cut = df.withColumn("_block", F.floor(F.col(pos) / block)).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(pos)
    return (
        cut.join(offsets, [*keys, "_block"])
        .withColumn(name, F.sum("_value").over(inside) + F.col("_offset"))
        .drop("_block", "_value", "_offset")
    )


#: Rows that a range of hashes may have to be ranked in one task.
RANGE_ROWS = 65_536


def ranked_by_hash(
    df: DataFrame, group: str, digest: Column, tie: str, name: str, hex_digits: int | None = None
) -> DataFrame:
    """0-based rank by a hexadecimal digest within ``group``, exact for groups of any size.

    The leading digits cut every group into even ranges; ranks are counted inside a range and
    shifted by the number of rows in the ranges before it. Unless given, the number of digits follows from the largest group,
    counted first, so that a range has about ``RANGE_ROWS`` rows at most, whatever the size; small groups are ranked as they are.
    """
    digits = hex_digits or 0
    if hex_digits is None:
        largest = df.groupBy(group).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
        while largest > RANGE_ROWS * 16**digits:
            digits += 1
    cut = df.withColumn("_digest", digest)
    if not digits:
        whole = Window.partitionBy(group).orderBy("_digest", tie)
        return cut.withColumn(name, (F.row_number().over(whole) - 1).cast("long")).drop("_digest")
    cut = cut.withColumn("_range", F.substring("_digest", 1, digits))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(group, "_range")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(group, "_range").orderBy("_digest", tie)
    return (
        cut.join(offsets, [group, "_range"])
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("_offset"))
        .drop("_digest", "_range", "_offset")
    )
