"""Exact latency summaries per stage, without gathering a stage in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.session import cut_lineage


#: Parts into which an interval is split, and rows that an interval may have to be sorted out.
SPLITS, SMALL = 1024, 4096


def _first_bin(value: Column) -> Column:
    """A bin that never decreases with the value: sign, then an eighth of a doubling. Even parts of it get down to single doubles in a few rounds."""
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(1100.0)) * 8) + 10_000
    return F.when(value == 0, 0).otherwise((F.signum(value) * size).cast("long"))


def _holding(bins: DataFrame, wanted: DataFrame) -> DataFrame:
    """For every wanted rank the bin that holds it: (key, name, rank inside it, smallest and largest value, rows).

    Bins (key, part, bin, low, high, rows) are counted up within a part, of which there are at most as many as splits, or as distinct values of a small one.
    """
    before = Window.partitionBy("_k", "_part").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    inside = (F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_rows"))
    found = placed.join(wanted, ["_k", "_part"]).filter(inside)
    return found.select("_k", "_name", (F.col("_rank") - F.col("_before")).alias("_rank"), "_low", "_high", "_rows")


def _bins(rows: DataFrame, bin_: Column, *keys: str | Column) -> DataFrame:
    """Count, least and largest value per bin, combined before the shuffle."""
    return rows.groupBy(*keys, bin_.alias("_bin")).agg(
        F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_rows")
    )


def _within(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """The rows inside some intervals of their key."""
    some = intervals.select("_k", "_low", "_high").distinct()
    return rows.join(some, "_k").filter(F.col("_v").between(F.col("_low"), F.col("_high")))


def values_at_ranks(df: DataFrame, key: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics per key, nulls and NaN left out; ``ranks`` are 1-based and may use the group size ``n``.

    Selection by refinement: a histogram first, then only the bins that hold a wanted rank are split again, until they hold a few
    rows or one value. A round exchanges bins, never values, and a dense bin is split like any other; every split
    has its least value in the first part and its largest in the last, so each round gets somewhere. ``df`` is read once a round: give
    a stored frame.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    bins = cut_lineage(_bins(rows, _first_bin(F.col("_v")), "_k"))
    sizes = bins.groupBy("_k").agg(F.sum("_rows").alias("n"))
    asked = F.array(*[F.struct(F.lit(name).alias("_name"), rank.cast("long").alias("_rank")) for name, rank in ranks.items()])
    wanted = sizes.select("_k", F.inline(asked)).withColumn("_part", F.lit(0.0))
    found = cut_lineage(_holding(bins.withColumn("_part", F.lit(0.0)), wanted))
    while True:
        several = F.col("_low") < F.col("_high")
        large = several & (F.col("_rows") > SMALL)
        if not found.filter(large).head(1):
            break
        dense = found.filter(large)
        share = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        parts = _bins(_within(rows, dense), F.floor(share * SPLITS), "_k", F.col("_low").alias("_part"))
        again = _holding(parts, dense.select("_k", "_name", "_rank", F.col("_low").alias("_part")))
        found = cut_lineage(found.filter(~large).unionByName(again))
    open_ = found.filter(several)
    values = _bins(_within(rows, open_), F.col("_v"), "_k", F.col("_low").alias("_part"))
    sorted_out = _holding(values, open_.select("_k", "_name", "_rank", F.col("_low").alias("_part")))
    picked = found.filter(~several).unionByName(sorted_out)
    at = lambda name: F.max(F.when(F.col("_name") == name, F.col("_low"))).alias(name)
    wide = picked.groupBy("_k").agg(*[at(name) for name in ranks])
    return sizes.join(wide, "_k", "left").select(F.col("_k").alias(key), "n", *ranks)


def stage_timing_summary(
    df: DataFrame, stage: str = "stage", latency: str = "latency_s", peak: str = "peak_bytes"
) -> DataFrame:
    """n, median, p95 (exclusive quantile from 20 rows on, else the maximum), peak memory."""
    n = F.col("n")
    low = F.least(F.greatest(F.floor(19 * (n + 1) / 20), F.lit(1)), F.greatest(n - 1, F.lit(1)))
    picked = values_at_ranks(
        df,
        stage,
        latency,
        {
            "_m1": F.floor((n + 1) / 2),
            "_m2": F.floor(n / 2) + 1,
            "_q1": low,
            "_q2": low + 1,
        },
    )
    share = 19 * (n + 1) - 20 * low
    p95 = (F.col("_q1") * (20 - share) + F.col("_q2") * share) / 20
    tops = df.groupBy(stage).agg(F.max(latency).alias("_max"), F.max(peak).alias("peak_bytes"))
    return (
        picked.join(tops, stage)
        .select(
            stage,
            n.alias("n_samples"),
            ((F.col("_m1") + F.col("_m2")) / 2).alias("median_latency_s"),
            F.when(n >= 20, p95).otherwise(F.col("_max")).alias("p95_latency_s"),
            "peak_bytes",
            (F.col("peak_bytes") / K.ONE_GIB).alias("peak_gib"),
            (F.col("peak_bytes") <= K.ONE_GIB).alias("under_1gib_budget"),
        )
    )


def run_timing_summary(stages: DataFrame) -> DataFrame:
    """One row for the whole run: the highest peak and the sum of the stage medians."""
    return stages.agg(
        F.count("*").alias("n_stages"),
        F.max("peak_bytes").alias("peak_bytes"),
        (F.max("peak_bytes") / K.ONE_GIB).alias("peak_gib"),
        (F.max("peak_bytes") <= K.ONE_GIB).alias("under_1gib_budget"),
        F.sum("median_latency_s").alias("median_total_latency_s"),
    )
