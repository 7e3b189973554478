"""Queries for metrics, threshold rules, timings and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.operators import folds, metrics, timings
from tonegap.operators.learning import argmax_label
from tonegap.operators.metrics import is_sarcasm
from tonegap.plans import inputs as I
from tonegap.plans.registry import query
from tonegap.session import scratch_path
from tonegap.sources import reports, tables

SCORE_COLUMNS = ["accuracy", "macro_f1", *[f"f1_{x}" for x in K.LABELS]]


def _confusion(spark, sf):
    return metrics.confusion(I.predictions(spark, sf))


def _fold_scores(spark, sf):
    return metrics.fold_metrics(_confusion(spark, sf))


def _rounded(df, *keys):
    return df.select(*keys, *[I.rounded(c) for c in df.columns if c not in keys])


@query(f"WITH {I.PREDICTIONS} SELECT fold, label, pred, count(*) AS n FROM predictions GROUP BY fold, label, pred")
def confusion(spark, sf):
    return _confusion(spark, sf)


@query(
    f"""WITH {I.PREDICTIONS} SELECT fold, {I.r6('avg(CAST(label = pred AS DOUBLE))')} AS accuracy
    FROM predictions GROUP BY fold
    UNION ALL SELECT 0, {I.r6('avg(CAST(label = pred AS DOUBLE))')} FROM predictions"""
)
def accuracy(spark, sf):
    """Per fold, and over all folds as fold 0."""
    conf = _confusion(spark, sf)
    overall = metrics.accuracy(conf).select(F.lit(0).alias("fold"), "accuracy")
    return _rounded(metrics.accuracy(conf, ("fold",)).unionByName(overall), "fold")


SQL_LONG_F1 = " UNION ALL ".join(
    f"SELECT fold, {I.sql_text(x)} AS label, {I.r6(f'f1_{x}')} AS f1 FROM fold_scores" for x in K.LABELS
)


@query(f"WITH {I.FOLD_SCORES} {SQL_LONG_F1}")
def per_class_f1(spark, sf):
    return metrics.per_class_f1(_confusion(spark, sf)).select("fold", "label", I.rounded("f1"))


@query(f"WITH {I.FOLD_SCORES} SELECT fold, {I.r6('macro_f1')} AS macro_f1 FROM fold_scores")
def macro_f1(spark, sf):
    return _fold_scores(spark, sf).select("fold", I.rounded("macro_f1"))


@query(
    f"WITH {I.FOLD_SCORES} SELECT fold, {I.r6('sarcasm_accuracy')} AS accuracy FROM fold_scores WHERE sarcasm_accuracy IS NOT NULL"
)
def subset_accuracy(spark, sf):
    return _rounded(metrics.subset_accuracy(_confusion(spark, sf), K.SARCASM_LABELS), "fold")


BINARY = f"""{I.PREDICTIONS},
flags AS (SELECT fold, CAST(label IN ('positive_sarcasm', 'negative_sarcasm') AS INTEGER) AS y,
                 CAST(pred IN ('positive_sarcasm', 'negative_sarcasm') AS INTEGER) AS p FROM predictions)"""


@query(
    f"""WITH {BINARY} SELECT fold, {I.r6('CASE WHEN sum(y) + sum(p) > 0 THEN 2.0 * sum(y * p) / (sum(y) + sum(p)) ELSE 0 END')} AS f1
    FROM flags GROUP BY fold"""
)
def binary_f1(spark, sf):
    rows = I.predictions(spark, sf).select(
        "fold", is_sarcasm(F.col("label")).alias("label"), is_sarcasm(F.col("pred")).alias("pred")
    )
    return _rounded(metrics.binary_f1(metrics.confusion(rows)), "fold")


SQL_MEANS = " UNION ALL ".join(
    f"SELECT {I.sql_text(c)} AS metric, {I.r6(f'avg({c})')} AS mean, {I.r6(f'stddev_pop({c})')} AS std FROM fold_scores"
    for c in SCORE_COLUMNS
)


@query(f"WITH {I.FOLD_SCORES} {SQL_MEANS}")
def mean_std(spark, sf):
    return _rounded(metrics.mean_std(_fold_scores(spark, sf), SCORE_COLUMNS), "metric")


@query(f"WITH {I.FOLD_SCORES} SELECT {I.r6('avg((f1_positive_sarcasm + f1_negative_sarcasm) / 2)')} AS sarcasm_macro_f1 FROM fold_scores")
def sarcasm_macro_f1(spark, sf):
    return _rounded(metrics.sarcasm_macro_f1(_fold_scores(spark, sf)))


def _other_run(spark, sf):
    """A second run on the same folds that always answers with the majority of the caption polarity."""
    side = F.when(F.col("polarity_T") > 0.05, "positive").when(F.col("polarity_T") < -0.05, "negative_sarcasm")
    rows = I.features(spark, sf).select("post_id", "label", side.otherwise("neutral").alias("pred"))
    return metrics.fold_metrics(metrics.confusion(folds.stratified_folds(rows)))


BOTH_RUNS = f"""{I.FOLD_SCORES}, {I.FEATURE_ROWS},
other_predictions AS (
  SELECT post_id, label, CASE WHEN polarity_T > 0.05 THEN 'positive' WHEN polarity_T < -0.05 THEN 'negative_sarcasm'
         ELSE 'neutral' END AS pred, {I.SQL_FOLD} AS fold FROM features),
{I.fold_scores_sql('other_predictions', 'other_scores')}"""


@query(
    f"""WITH {BOTH_RUNS} SELECT a.fold, {I.r6('a.accuracy')} AS accuracy_a, {I.r6('a.macro_f1')} AS macro_f1_a,
      {I.r6('b.accuracy')} AS accuracy_b, {I.r6('b.macro_f1')} AS macro_f1_b
    FROM fold_scores a JOIN other_scores b ON a.fold = b.fold"""
)
def compare_runs(spark, sf):
    both = metrics.compare_runs(_fold_scores(spark, sf), _other_run(spark, sf), ["accuracy", "macro_f1"])
    return _rounded(both, "fold")


# --- threshold rule ---------------------------------------------------------

_START, _STEP = metrics.threshold_values()
SQL_THRESHOLD = f"(CAST({_START!r} AS DOUBLE) + s.step * CAST({_STEP!r} AS DOUBLE))"
GRID_STEPS = f"""scored AS (SELECT post_id, Dsem, CAST({I.SQL_IRONIC} AS INTEGER) AS y, {I.SQL_FOLD} AS fold FROM features),
steps AS (SELECT CAST(unnest(range({K.THRESHOLD_STEPS})) AS INTEGER) AS step),
grid AS (
  SELECT f.fold, s.step, {SQL_THRESHOLD} AS threshold,
         avg(CAST(CAST(r.Dsem >= {SQL_THRESHOLD} AS INTEGER) = r.y AS DOUBLE)) AS accuracy
  FROM (SELECT DISTINCT fold FROM scored) f JOIN scored r ON r.fold <> f.fold JOIN steps s ON true GROUP BY ALL),
best AS (
  SELECT fold, CASE WHEN accuracy > 0 THEN threshold ELSE 0.45 END AS threshold, accuracy AS train_accuracy FROM (
    SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(accuracy, 12) DESC, threshold) AS rn FROM grid) WHERE rn = 1)"""
RULE_STEPS = f"""{GRID_STEPS},
rule AS (
  SELECT fold, threshold, train_accuracy, avg(CAST(CAST(Dsem >= threshold AS INTEGER) = y AS DOUBLE)) AS accuracy
  FROM scored JOIN best USING (fold) GROUP BY ALL)"""
GRID = f"{I.FEATURES}, {GRID_STEPS}"
RULE = f"{I.FEATURES}, {RULE_STEPS}"


def _scored(spark, sf):
    rows = I.features(spark, sf).select("post_id", "label", "Dsem", is_sarcasm(F.col("label")).alias("y"))
    return folds.stratified_folds(rows)


@query(f"WITH {GRID} SELECT fold, step, {I.r6('threshold')} AS threshold, {I.r6('accuracy')} AS accuracy FROM grid")
def threshold_grid(spark, sf):
    return _rounded(metrics.threshold_grid(_scored(spark, sf)), "fold", "step")


@query(f"WITH {GRID} SELECT fold, {I.r6('threshold')} AS threshold, {I.r6('train_accuracy')} AS train_accuracy FROM best")
def best_threshold(spark, sf):
    return _rounded(metrics.best_threshold(metrics.threshold_grid(_scored(spark, sf))), "fold")


@query(
    f"""WITH {RULE} SELECT fold, {I.r6('threshold')} AS threshold, {I.r6('train_accuracy')} AS train_accuracy,
      {I.r6('accuracy')} AS accuracy FROM rule"""
)
def dsem_rule(spark, sf):
    return _rounded(metrics.dsem_rule(_scored(spark, sf)), "fold")


SQL_DELTA = """(SELECT avg((f1_positive_sarcasm + f1_negative_sarcasm) / 2) FROM fold_scores)
  - (SELECT avg((f1_positive_sarcasm + f1_negative_sarcasm) / 2) FROM other_scores)"""
SQL_RULE_MEAN = "(SELECT avg(accuracy) FROM rule)"
SQL_PEAK = "(SELECT max(user_id * 10000000 + event_id) FROM events) / 1073741824.0"
CLAIMS = f"{BOTH_RUNS}, {RULE_STEPS}"


@query(
    f"""WITH {CLAIMS}
    SELECT 'sarcasm_f1_delta' AS claim, {I.r6(SQL_DELTA)} AS value, CAST(0.1 AS DOUBLE) AS bound, {SQL_DELTA} >= 0.1 AS holds
    UNION ALL SELECT 'binary_sarcasm_accuracy', {I.r6(SQL_RULE_MEAN)}, 0.7, {SQL_RULE_MEAN} >= 0.7
    UNION ALL SELECT 'peak_memory_gib', {I.r6(SQL_PEAK)}, 1.0, {SQL_PEAK} <= 1.0"""
)
def claims_table(spark, sf):
    """Both runs and the rule's score stored beside each other once, with their folds."""
    side = F.when(F.col("polarity_T") > 0.05, "positive").when(F.col("polarity_T") < -0.05, "negative_sarcasm")
    rows = I.features(spark, sf).select(
        "post_id", "label", argmax_label(F.col("proba")).alias("pred"), side.otherwise("neutral").alias("other"), "Dsem"
    )
    path = scratch_path(spark, "scored")
    rows.write.parquet(path)
    scored = folds.stratified_folds(spark.read.parquet(path))
    return metrics.claims_table(scored, I.timings(spark, sf)).select("claim", I.rounded("value"), "bound", "holds")


# --- metric tables as files -------------------------------------------------

SQL_CELLS = ", ".join(f"CAST({I.r6(c)} AS VARCHAR) AS {c}" for c in SCORE_COLUMNS)
SQL_SPREADS = ", ".join(f"printf('%.4f', avg({c})) || '±' || printf('%.4f', stddev_pop({c}))" for c in SCORE_COLUMNS)


SQL_FOOTER = "coalesce(avg(sarcasm_accuracy), 0)"
SQL_BLANKS = "".join(", NULL" for _ in SCORE_COLUMNS[1:])


@query(
    f"""WITH {I.FOLD_SCORES} SELECT CAST(fold AS VARCHAR) AS fold, {SQL_CELLS} FROM fold_scores
    UNION ALL SELECT 'mean±std', {SQL_SPREADS} FROM fold_scores
    UNION ALL SELECT '# sarcasm_mean_accuracy', printf('%.4f', {SQL_FOOTER}){SQL_BLANKS} FROM fold_scores
    UNION ALL SELECT '# meets_hypothesis_70pct', CASE WHEN {SQL_FOOTER} >= 0.7 THEN 'true' ELSE 'false' END{SQL_BLANKS} FROM fold_scores"""
)
def write_metric_table(spark, sf):
    """Fold rows, the mean row and the footers of a report file, read back as text."""
    per_fold = _fold_scores(spark, sf)
    shown = per_fold.select("fold", *[I.rounded(c) for c in SCORE_COLUMNS], "sarcasm_accuracy")
    path = scratch_path(spark, "metrics")
    tables.write_metric_table(
        metrics.metric_table(shown, SCORE_COLUMNS), metrics.metric_footer(per_fold), path
    )
    return reports.read_report_csv(spark, path)


@query(
    f"""WITH {I.FOLD_SCORES} SELECT 'sarcasm_mean_accuracy' AS key, printf('%.4f', {SQL_FOOTER}) AS value FROM fold_scores
    UNION ALL SELECT 'meets_hypothesis_70pct', CASE WHEN {SQL_FOOTER} >= 0.7 THEN 'true' ELSE 'false' END FROM fold_scores"""
)
def metric_footer(spark, sf):
    return metrics.metric_footer(_fold_scores(spark, sf))


@query(
    f"""WITH {I.FOLD_SCORES} SELECT fold, {I.r6('round(accuracy, 6)')} AS accuracy, {I.r6('round(macro_f1, 6)')} AS macro_f1,
      {I.r6(f"(SELECT CAST(printf('%.4f', {SQL_FOOTER}) AS DOUBLE) FROM fold_scores)")} AS footer,
      {I.r6("(SELECT CAST(printf('%.4f', avg(macro_f1)) AS DOUBLE) FROM fold_scores)")} AS mean
    FROM fold_scores"""
)
def read_report_csv(spark, sf):
    """One report file with fold rows, the mean row and footers, parsed again."""
    per_fold = _fold_scores(spark, sf)
    shown = per_fold.select("fold", I.rounded("accuracy"), I.rounded("macro_f1"), "sarcasm_accuracy")
    table = metrics.metric_table(shown, ["accuracy", "macro_f1"])
    path = scratch_path(spark, "report")
    tables.write_metric_table(table, metrics.metric_footer(per_fold), path)
    report = reports.read_report_csv(spark, path)
    stored = reports.report_mean(report, "sarcasm_mean_accuracy", "accuracy").scalar()
    fallback = reports.report_mean(report, "no_such_footer", "macro_f1").scalar()
    return reports.fold_rows(report, ["accuracy", "macro_f1"]).select(
        "fold",
        I.rounded("accuracy"),
        I.rounded("macro_f1"),
        I.rounded(stored, "footer"),
        I.rounded(fallback, "mean"),
    )


# --- timings ----------------------------------------------------------------

TIMINGS = """timings AS (
  SELECT event_type AS stage, value AS latency_s, user_id * 10000000 + event_id AS peak_bytes FROM events),
sorted AS (
  SELECT stage, list(latency_s ORDER BY latency_s) AS x, count(*) AS n, max(peak_bytes) AS peak FROM timings GROUP BY stage),
ranks AS (SELECT *, greatest(least(19 * (n + 1) // 20, n - 1), 1) AS j FROM sorted),
stages AS (
  SELECT stage, n AS n_samples, (x[(n + 1) // 2] + x[n // 2 + 1]) / 2 AS median_latency_s,
         CASE WHEN n >= 20 THEN (x[j] * (20 - (19 * (n + 1) - 20 * j)) + x[j + 1] * (19 * (n + 1) - 20 * j)) / 20
              ELSE x[n] END AS p95_latency_s,
         peak AS peak_bytes, peak / 1073741824.0 AS peak_gib, peak <= 1073741824 AS under_1gib_budget FROM ranks)"""


@query(
    f"""WITH {TIMINGS} SELECT stage, n_samples, {I.r6('median_latency_s')} AS median_latency_s,
      {I.r6('p95_latency_s')} AS p95_latency_s, peak_bytes, {I.r6('peak_gib')} AS peak_gib, under_1gib_budget FROM stages"""
)
def stage_timing_summary(spark, sf):
    return timings.stage_timing_summary(I.timings(spark, sf)).select(
        "stage",
        "n_samples",
        I.rounded("median_latency_s"),
        I.rounded("p95_latency_s"),
        "peak_bytes",
        I.rounded("peak_gib"),
        "under_1gib_budget",
    )


@query(
    f"""WITH {TIMINGS} SELECT count(*) AS n_stages, max(peak_bytes) AS peak_bytes, {I.r6('max(peak_gib)')} AS peak_gib,
      max(peak_bytes) <= 1073741824 AS under_1gib_budget, {I.r6('sum(median_latency_s)')} AS median_total_latency_s FROM stages"""
)
def run_timing_summary(spark, sf):
    run = timings.run_timing_summary(timings.stage_timing_summary(I.timings(spark, sf)))
    return run.select(
        "n_stages", "peak_bytes", I.rounded("peak_gib"), "under_1gib_budget", I.rounded("median_total_latency_s")
    )
