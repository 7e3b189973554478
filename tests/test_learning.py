from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.operators import folds, learning, predict, scoring

#: One corner per class, told apart by two signs and the size of the gap.
CENTRES = {
    "positive": (0.30, 0.25, 0.60, 0.55, 0.45, 0.50),
    "negative": (0.30, 0.25, 0.60, 0.55, -0.45, -0.50),
    "neutral": (0.32, 0.20, 0.40, 0.35, -0.02, 0.02),
    "positive_sarcasm": (0.95, 1.10, 0.50, 0.10, 0.50, -0.40),
    "negative_sarcasm": (0.95, 1.10, 0.50, 0.10, -0.40, 0.50),
}


@pytest.fixture(scope="module")
def folded(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    rows = [
        (f"{label}-{i}", label, *[float(v) for v in rng.normal(centre, 0.05)])
        for label, centre in CENTRES.items()
        for i in range(40)
    ]
    columns = ", ".join(f"{c} double" for c in K.FEATURE_NAMES)
    df = folds.stratified_folds(spark.createDataFrame(rows, f"post_id string, label string, {columns}"))
    path = str(tmp_path_factory.mktemp("learn") / "folded")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_separable_classes_are_learned(folded):
    result = learning.select_and_fit(folded)
    assert result.pack.name == "LogisticRegression"
    assert result.mean_macro_f1 > 0.95
    assert result.predictions.count() == folded.count()


def test_logistic_regression_is_at_the_optimum(folded):
    """Gradient of the penalised, balanced, summed loss at the solution."""
    pack = learning.fit_logreg(folded)
    rows = folded.select("label", *K.FEATURE_NAMES).collect()
    x = np.array([[r[c] for c in K.FEATURE_NAMES] for r in rows])
    y = np.array([[r["label"] == c for c in pack.classes] for r in rows], float)
    w = pack.model.coefficientMatrix.toArray()
    z = x @ w.T + pack.model.interceptVector.toArray()
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert np.abs(w + (p - y).T @ x).max() < 0.02  # balanced weights are all 1 here


def test_calibrated_svm(folded):
    pack = learning.fit_linear_svc_calibrated(folded)
    scored = learning.with_proba(pack, folded)
    totals = scored.select(F.aggregate("proba", F.lit(0.0), lambda a, v: a + v).alias("t"))
    assert all(r["t"] == pytest.approx(1.0) for r in totals.collect())
    right = learning.with_prediction(pack, folded).filter("pred = label").count()
    assert right > 0.95 * folded.count()


def test_svm_margins_are_at_the_optimum(folded):
    label, n = "positive", folded.count()
    x = F.array(*[F.col(c) for c in K.FEATURE_NAMES], F.lit(1.0))
    data = folded.select(x.alias("_x"), F.col("label").alias("_label"), F.lit(2).alias("_inner"))
    w = learning._fit_margins(data, [(1, label)], {label: 2.5}, 7, 50)[1, label]
    rows = folded.select("label", *K.FEATURE_NAMES).collect()
    m = np.array([[r[c] for c in K.FEATURE_NAMES] + [1.0] for r in rows])
    y = np.array([1.0 if r["label"] == label else -1.0 for r in rows])
    c = np.where(y > 0, 2.5, 1.0)
    slack = np.maximum(0, 1 - y * (m @ w))
    assert len(rows) == n
    assert np.abs(w - 2 * (m.T @ (c * y * slack))).max() < 1e-6


def test_model_round_trip(folded, tmp_path):
    pack = learning.fit_logreg(folded)
    learning.save_model(pack, str(tmp_path / "m"))
    again = learning.load_model(str(tmp_path / "m"))
    assert again.classes == pack.classes and again.features == pack.features
    one = lambda p: [r["pred"] for r in learning.with_prediction(p, folded).orderBy("post_id").collect()]
    assert one(pack) == one(again)


def test_unseen_class_gets_zero(folded):
    pack = learning.fit_logreg(folded.filter(~F.col("label").isin("neutral", "positive_sarcasm")))
    p = learning.with_proba(pack, folded).first()["proba"]
    assert p[2] == 0.0 and p[3] == 0.0 and sum(p) == pytest.approx(1.0)


def test_ablation_covers_all_subsets(folded):
    rows = {r["configuration"]: r for r in learning.ablation(folded).collect()}
    assert len(rows) == 7 and rows["Dsem"]["n_features"] == 4 and rows["Dsem+Dsen+Fvt"]["n_features"] == 6


def test_conflict_rules(spark):
    rows = [
        ("a", 0.57, -0.07, 0.50, 0.3, [0.05, 0.24, 0.05, 0.05, 0.05]),
        ("b", 0.80, 0.70, -0.50, 0.1, [0.40, 0.05, 0.05, 0.05, 0.05]),
        ("c", 0.30, 0.70, -0.50, 0.8, [0.40, 0.05, 0.05, 0.05, 0.05]),
        ("d", 0.80, 0.70, -0.50, 0.8, [0.05, 0.05, 0.05, 0.81, 0.05]),
    ]
    schema = "post_id string, Dsen double, polarity_T double, polarity_T_hat double, Fvt double, proba array<double>"
    df = spark.createDataFrame(rows, schema).withColumns({"Dsem": F.lit(0.4), "cos_TI": F.lit(0.2)})
    got = {r["post_id"]: r["prediction"] for r in predict.predict_table(df, fvt_threshold=0.3).collect()}
    assert (got["a"]["label"], got["a"]["confidence"]) == ("negative_sarcasm", pytest.approx(0.39))
    assert (got["b"]["label"], got["b"]["confidence"]) == ("positive_sarcasm", pytest.approx(0.55))
    assert got["c"]["label"] == "positive"
    assert (got["d"]["label"], got["d"]["confidence"]) == ("positive_sarcasm", 0.81)
    assert got["b"]["low_fidelity"] and not got["d"]["low_fidelity"]


def test_incomplete_stage_is_named(spark):
    records = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "post_id string")
    with pytest.raises(RuntimeError, match=r"captions stage incomplete: 4 record\(s\) missing.*'b', 'c', 'd'"):
        scoring.require_complete(records, records.filter("post_id = 'a'"), "captions")


def test_stage_scores_each_record_once(spark, tmp_path):
    path = str(tmp_path / "stage")
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            calls.add(len(b))
            yield b.assign(n=1)[["post_id", "n"]]

    scorer = scoring.Scorer("count", (), "n int", count)
    records = spark.range(20).select(F.col("id").cast("string").alias("post_id"))
    step = lambda df: scoring.run_scorer(df, scorer)
    scoring.run_stage(records.filter("post_id < '15'"), path, step)
    assert scoring.run_stage(records, path, step).count() == 20
    scoring.run_stage(records, path, step)
    assert calls.value == 20


def test_binary_task_after_an_observed_write(folded, tmp_path):
    """Scoring must not drag the session into a task, which fails once it has observed a write."""
    from tonegap.sources.tables import write_jsonl

    assert write_jsonl(folded.select("post_id"), str(tmp_path / "ids")) == folded.count()
    rows = learning.binary_sarcasm(folded.drop("fold")).collect()
    assert len(rows) == 5 and all(r["accuracy"] > 0.9 and r["f1"] > 0.9 for r in rows)
    assert all(r["dsem_rule_accuracy"] > 0.9 for r in rows)


def test_both_classifiers_are_saved(folded, tmp_path):
    pack = learning.fit_linear_svc_calibrated(folded)
    learning.save_model(pack, str(tmp_path / "svm"))
    again = learning.load_model(str(tmp_path / "svm"))
    assert isinstance(again, learning.CalibratedSvcPack) and again == pack


def test_nothing_to_learn_from(folded):
    with pytest.raises(ValueError, match="no usable record"):
        learning.select_and_fit(folded.limit(0))


def test_shared_fits_are_those_of_one_model(folded):
    """All folds and subsets in one fit, against a separate optimiser for each."""
    sets = [learning.ablation_columns(s) for s in learning.feature_subsets()]
    fits = learning.fit_folds(folded, sets)
    assert all(f.converged for f in fits)
    for fit, fold in ((fits[0], 1), (fits[-1], 4)):
        one = learning.fit_logreg(folded.filter(F.col("fold") != fold), fit.features)
        assert np.abs(np.array(fit.coefficients[fold])[:, :-1] - one.weights).max() < 1e-4
        offsets = np.array(fit.coefficients[fold])[:, -1]
        assert np.abs((offsets - offsets.mean()) - (one.offsets - one.offsets.mean())).max() < 1e-3


def test_shared_binary_fits(folded):
    rows = learning.binary_folds(folded.drop("fold"))
    fit = learning.fit_folds(rows, [K.DISCREPANCY_SIGNALS], "y")[0]
    one = learning.fit_logreg(rows.filter("fold <> 2"), K.DISCREPANCY_SIGNALS, "y")
    assert len(fit.coefficients[2]) == 1
    assert np.abs(np.array(fit.coefficients[2][0]) - [*one.weights[0], *one.offsets]).max() < 1e-4


def test_an_ablation_takes_few_jobs(spark, folded):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ablation", "counted")
    try:
        assert learning.ablation(folded).count() == 7
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup("ablation")) <= 30


def test_masses_tell_a_fit_from_one_of_shuffled_labels(folded):
    rows = folded.count()
    fits = learning.fit_folds(folded, [K.FEATURE_NAMES])
    held = {r["fold"]: r["n"] for r in folded.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    for r in learning.training_masses(fits, folded).collect():
        assert r["mass"] == pytest.approx((rows - held[r["fold"]]) / 5, abs=1e-6)
    names = F.array(*[F.lit(x) for x in K.LABELS])
    mixed = folded.withColumn("label", F.get(names, F.pmod(F.xxhash64("post_id"), F.lit(5)).cast("int")))
    wrong = learning.training_masses(learning.fit_folds(mixed, [K.FEATURE_NAMES]), folded).collect()
    assert max(abs(r["mass"] - (rows - held[r["fold"]]) / 5) for r in wrong) > 0.01


def test_a_class_that_a_fold_never_saw(folded):
    """The only fold with a class is left out: that model gives it nothing."""
    rows = folded.filter("label <> 'neutral' OR fold = 1")
    fit = learning.fit_folds(rows, [K.FEATURE_NAMES])[0]
    assert fit.coefficients[1][fit.classes.index("neutral")] is None
    scored = learning.with_probabilities([fit], rows).select("fold", F.col("_p0").alias("p"))
    at = fit.classes.index("neutral")
    assert all(r["p"][at] == 0.0 for r in scored.filter("fold = 1").collect())
    assert all(sum(r["p"]) == pytest.approx(1.0) for r in scored.collect())


def test_svm_slopes(folded):
    pack = learning.fit_linear_svc_calibrated(folded)
    assert pack.converged and min(pack.steps) > 1
    rows = learning.svc_slopes(pack, folded).collect()
    assert len(rows) == 15 and all(r["margin_slope"] < 1e-6 and r["calibration_slope"] < 1e-6 for r in rows)
    off = [[([x + 0.1 for x in w], a, b) for w, a, b in m] for m in pack.members]
    moved = learning.svc_slopes(learning.CalibratedSvcPack(off, pack.classes, pack.features), folded).collect()
    assert min(r["margin_slope"] for r in moved) > 1e-3
    plan = learning.with_proba(pack, folded)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
