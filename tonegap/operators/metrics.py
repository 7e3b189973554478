"""Quality measures from predictions, all derived from one confusion table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.session import cut_lineage


def confusion(predictions: DataFrame, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Rows by (keys, label, pred): the only pass over the predictions themselves."""
    return predictions.groupBy(*keys, "label", "pred").agg(F.count("*").alias("n"))


def _sum_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _f1(label) -> Column:
    hit = _sum_if((F.col("label") == label) & (F.col("pred") == label))
    true, pred = _sum_if(F.col("label") == label), _sum_if(F.col("pred") == label)
    return _share(2 * hit, true + pred)


def accuracy(conf: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return conf.groupBy(*keys).agg(
        _share(_sum_if(F.col("label") == F.col("pred")), F.sum("n")).alias("accuracy")
    )


def fold_metrics(conf: DataFrame, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Per fold: accuracy, F1 of all five labels, their plain mean, sarcasm accuracy.

    ``sarcasm_accuracy`` is null for a fold without a sarcasm row, so averages skip it.
    """
    right = F.col("label") == F.col("pred")
    ironic = F.col("label").isin(*K.SARCASM_LABELS)
    n_ironic = _sum_if(ironic)
    scores = conf.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        _share(_sum_if(right), F.sum("n")).alias("accuracy"),
        *[_f1(label).alias(f"f1_{label}") for label in K.LABELS],
        F.when(n_ironic > 0, _sum_if(ironic & right).cast("double") / n_ironic).alias(
            "sarcasm_accuracy"
        ),
    )
    mean = reduce(lambda a, b: a + b, [F.col(f"f1_{x}") for x in K.LABELS]) / len(K.LABELS)
    return scores.withColumn("macro_f1", mean)


def per_class_f1(conf: DataFrame, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Long form: one row per (keys, label)."""
    wide = fold_metrics(conf, keys)
    long = wide.unpivot(
        list(keys), [f"f1_{x}" for x in K.LABELS], "label", "f1"
    )
    return long.withColumn("label", F.expr("substring(label, 4)"))


def subset_accuracy(conf: DataFrame, labels: tuple[str, ...], keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Accuracy on rows whose true label is in ``labels``; folds without such rows are absent."""
    return accuracy(conf.filter(F.col("label").isin(*labels)), keys)


def binary_f1(conf: DataFrame, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """F1 of class 1 over 0/1 labels, 0.0 when undefined."""
    return conf.groupBy(*keys).agg(_f1(1).alias("f1"))


def mean_std(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation, long form ``(keys, metric, mean, std)``."""
    long = df.unpivot(list(keys), columns, "metric", "value")
    return long.groupBy(*keys, "metric").agg(
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std"),
    )


def metric_table(per_fold: DataFrame, columns: list[str]) -> DataFrame:
    """Fold rows and a final ``mean±std`` row, as text."""
    rows = per_fold.select(
        F.col("fold").cast("string").alias("fold"), *[F.col(c).cast("string").alias(c) for c in columns]
    )
    spread = lambda c: F.format_string("%.4f±%.4f", F.avg(c), F.stddev_pop(c))
    summary = per_fold.agg(*[spread(c).alias(c) for c in columns]).select(
        F.lit("mean±std").alias("fold"), *columns
    )
    return rows.unionByName(summary)


def metric_footer(per_fold: DataFrame, column: str = "sarcasm_accuracy") -> DataFrame:
    """Key/value footer: mean on the sarcasm subset and whether it meets the floor."""
    mean = F.coalesce(F.avg(column), F.lit(0.0))
    pairs = F.array(
        F.struct(F.lit("sarcasm_mean_accuracy").alias("key"), F.format_string("%.4f", "m").alias("value")),
        F.struct(
            F.lit("meets_hypothesis_70pct").alias("key"),
            (F.col("m") >= K.SARCASM_ACCURACY_FLOOR).cast("string").alias("value"),
        ),
    )
    return per_fold.agg(mean.alias("m")).select(F.inline(pairs))


def sarcasm_macro_f1(per_fold: DataFrame) -> DataFrame:
    """Mean over folds of the mean of the two sarcasm F1 scores; 0.0 without folds."""
    both = reduce(lambda a, b: a + b, [F.col(f"f1_{x}") for x in K.SARCASM_LABELS]) / 2
    return per_fold.agg(F.coalesce(F.avg(both), F.lit(0.0)).alias("sarcasm_macro_f1"))


def compare_runs(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Two metric tables side by side by fold."""
    pick = lambda df, tag: df.select(
        "fold", *[F.col(c).alias(f"{c}_{tag}") for c in columns]
    )
    return pick(left, "a").join(pick(right, "b"), "fold")


def claims_table(scored: DataFrame, peaks: DataFrame) -> DataFrame:
    """The three claims with value, floor or ceiling, and verdict.

    ``scored`` holds (fold, label, pred, other, Dsem): the predictions of two runs and the score of the threshold rule; ``peaks`` has
    ``peak_bytes``. One pass over the rows counts both confusion tables and the histogram of scores; all else is worked out from these.
    """
    y = is_sarcasm(F.col("label"))
    rows = scored.select("fold", "label", "pred", "other", *_histogram_columns(F.col("Dsem"), y))
    sets = [("fold", "label", "pred"), ("fold", "label", "other"), ("fold", "bin")]
    counted = rows.groupingSets(sets, "fold", "label", "pred", "other", "bin").agg(
        F.grouping_id().alias("_set"), F.count("*").alias("n"), F.sum("pos").alias("pos"), F.sum("default_hit").alias("default_hit")
    )
    counted = cut_lineage(counted)  # a few rows per fold
    of = lambda grouped, *names: counted.filter(F.col("_set") == grouped).select("fold", *names)
    runs = [fold_metrics(of(0b00011, "label", "pred", "n")), fold_metrics(of(0b00101, "label", F.col("other").alias("pred"), "n"))]
    rule = _rule(of(0b01110, "bin", "pos", "n", "default_hit")).agg(F.avg("accuracy"))
    values = scored.sparkSession.range(1).select(
        (sarcasm_macro_f1(runs[0]).scalar() - sarcasm_macro_f1(runs[1]).scalar()).alias("delta"),
        F.coalesce(rule.scalar(), F.lit(0.0)).alias("binary"),
        (peaks.agg(F.max("peak_bytes")).scalar().cast("double") / K.ONE_GIB).alias("gib"),
    )
    claim = lambda name, value, limit, holds: F.struct(
        F.lit(name).alias("claim"),
        F.col(value).alias("value"),
        F.lit(limit).cast("double").alias("bound"),
        holds.alias("holds"),
    )
    floor, target = K.SARCASM_F1_DELTA_FLOOR, K.SARCASM_ACCURACY_FLOOR
    rows = F.array(
        claim("sarcasm_f1_delta", "delta", floor, F.col("delta") >= floor),
        claim("binary_sarcasm_accuracy", "binary", target, F.col("binary") >= target),
        claim("peak_memory_gib", "gib", 1.0, F.col("gib") <= 1.0),
    )
    return values.select(F.inline(rows))


def degenerate_features(features: DataFrame, columns: tuple[str, ...] = K.FEATURE_NAMES) -> DataFrame:
    """Names of columns without any variance."""
    spread = features.agg(*[(F.min(c) == F.max(c)).cast("int").alias(c) for c in columns])
    return spread.unpivot([], list(columns), "feature", "constant").filter("constant = 1").select("feature")


def threshold_values() -> tuple[float, float]:
    step = (K.THRESHOLD_STOP - K.THRESHOLD_START) / (K.THRESHOLD_STEPS - 1)
    return K.THRESHOLD_START, step


def thresholds_passed(score: Column) -> Column:
    """How many of the grid's thresholds a score reaches: its histogram bin (0..steps).

    A division finds the neighbourhood and two comparisons with the exact grid values settle
    rounding, so ``score >= threshold`` holds for exactly that many thresholds.
    """
    start, step = threshold_values()
    near = F.floor((score - start) / step)
    value = lambda i: F.lit(start) + i.cast("double") * F.lit(step)
    settled = (
        F.when(value(near + 1) <= score, near + 2)
        .when(value(near) <= score, near + 1)
        .otherwise(near)
    )
    return F.greatest(F.lit(0), F.least(F.lit(K.THRESHOLD_STEPS), settled)).cast("int")


def _histogram_columns(score: Column, target: Column) -> list[Column]:
    """A row's bin, whether it is positive, and whether the default threshold gets it right."""
    by_default = (score >= K.DEFAULT_DSEM_THRESHOLD).cast("int") == target.cast("int")
    return [thresholds_passed(score).alias("bin"), target.cast("long").alias("pos"), by_default.cast("long").alias("default_hit")]


def _histogram(scored: DataFrame, score: str, target: str) -> DataFrame:
    rows = scored.select("fold", *_histogram_columns(F.col(score), F.col(target)))
    return rows.groupBy("fold", "bin").agg(
        F.sum("pos").alias("pos"), F.count("*").alias("n"), F.sum("default_hit").alias("default_hit")
    )


def _grid(histogram: DataFrame) -> DataFrame:
    """(fold, step, threshold, accuracy, own_accuracy, default_accuracy) of every threshold, from the histogram alone.

    ``accuracy`` is that on the other folds, ``own_accuracy`` that on the fold itself. A fold's bins are filled up with empty ones from a
    map of at most ``steps + 1`` entries, so the histogram is read once.
    """
    fold = Window.partitionBy("fold")
    above = fold.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    entry = F.struct("bin", F.struct("pos", "n", "default_hit").alias("v"))
    maps = histogram.groupBy("fold").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    bins = maps.select("fold", "m", F.explode(F.sequence(F.lit(0), F.lit(K.THRESHOLD_STEPS))).alias("bin")).select(
        "fold", "bin", *[F.coalesce(F.try_element_at("m", F.col("bin"))[c], F.lit(0)).alias(c) for c in ("pos", "n", "default_hit")]
    )
    same = Window.partitionBy("bin")
    both = bins.select("*", *[(F.sum(c).over(same) - F.col(c)).alias(f"train_{c}") for c in ("pos", "n")])

    def share(pos: str, n: str) -> Column:
        # bin b counts scores that reach exactly b thresholds, so bins >= i + 1 reach threshold i
        neg = F.col(n) - F.col(pos)
        return F.try_divide(F.sum(pos).over(above) + F.sum(neg).over(fold) - F.sum(neg).over(above), F.sum(n).over(fold))

    start, step = threshold_values()
    rows = both.select(
        "fold",
        "bin",
        share("train_pos", "train_n").alias("accuracy"),
        share("pos", "n").alias("own_accuracy"),
        F.try_divide(F.sum("default_hit").over(fold), F.sum("n").over(fold)).alias("default_accuracy"),
    )
    return rows.filter(F.col("bin") >= 1).select(
        "fold",
        (F.col("bin") - 1).alias("step"),
        (F.lit(start) + (F.col("bin") - 1) * F.lit(step)).alias("threshold"),
        "accuracy",
        "own_accuracy",
        "default_accuracy",
    )


def threshold_grid(scored: DataFrame, score: str = "Dsem", target: str = "y") -> DataFrame:
    """Training accuracy of every threshold for every held-out fold.

    One histogram over the rows, then running sums over at most ``steps + 1`` bins per fold;
    the rows themselves are never multiplied by the grid.
    """
    return _grid(_histogram(scored, score, target)).select("fold", "step", "threshold", "accuracy")


def best_threshold(grid: DataFrame) -> DataFrame:
    """Most accurate threshold per fold, the smallest on ties; the default if none scores."""
    best = grid.groupBy("fold").agg(
        F.max_by("threshold", F.struct("accuracy", -F.col("threshold"))).alias("threshold"),
        F.max("accuracy").alias("accuracy"),
    )
    chosen = F.when(F.col("accuracy") > 0.0, F.col("threshold")).otherwise(K.DEFAULT_DSEM_THRESHOLD)
    return best.select("fold", chosen.alias("threshold"), F.col("accuracy").alias("train_accuracy"))


def _rule(histogram: DataFrame) -> DataFrame:
    """Per fold: the best threshold on the other folds and the accuracy that it has on this one."""
    best = _grid(histogram).groupBy("fold").agg(
        F.max_by(
            F.struct("threshold", "accuracy", "own_accuracy", "default_accuracy"), F.struct("accuracy", -F.col("threshold"))
        ).alias("b")
    )
    scores = F.col("b.accuracy") > 0.0
    return best.select(
        "fold",
        F.when(scores, F.col("b.threshold")).otherwise(K.DEFAULT_DSEM_THRESHOLD).alias("threshold"),
        F.col("b.accuracy").alias("train_accuracy"),
        F.when(scores, F.col("b.own_accuracy")).otherwise(F.col("b.default_accuracy")).alias("accuracy"),
    )


def dsem_rule(scored: DataFrame, score: str = "Dsem", target: str = "y") -> DataFrame:
    """Per fold: threshold tuned on the other folds, accuracy on this one. One pass over the rows."""
    return _rule(_histogram(scored, score, target))


def is_sarcasm(label: Column) -> Column:
    return label.isin(*K.SARCASM_LABELS).cast("int")
