"""Classifiers on the discrepancy features.

A single logistic regression is Spark ML's. Cross-validations and ablations fit all their models together, in one pass
over the rows per Newton step (``moments``); only class counts and a few sums per model reach the driver.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.functions.vectors import align_proba, argmax_first, finite_or_zero, softmax
from tonegap.operators import moments
from tonegap.operators.folds import stratified_folds
from tonegap.operators.keyed import settled
from tonegap.operators.metrics import confusion, dsem_rule, fold_metrics, is_sarcasm
from tonegap.operators.predict import label_array
from tonegap.session import cut_lineage

PARALLEL_FITS = 8


def _vectors(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Features as one vector column; non-finite values count as 0."""
    clean = df.withColumns({f"_x_{c}": finite_or_zero(F.col(c)) for c in columns})
    assembler = VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="_x")
    return assembler.transform(clean).drop(*[f"_x_{c}" for c in columns])


def _class_counts(df: DataFrame, label: str) -> dict[str, int]:
    rows = df.groupBy(label).agg(F.count("*").alias("n")).orderBy(label).collect()
    return {row[0]: row[1] for row in rows}


def _by_class(label: Column, values: dict) -> Column:
    return _map_of(values)[label]


def _balanced(counts: dict[str, int]) -> dict[str, float]:
    n = sum(counts.values())
    return {c: n / (len(counts) * m) for c, m in counts.items()}


def _softmax_of(logits: list[Column]) -> Column:
    """Probabilities of two classes from one score, else of as many as there are scores."""
    if len(logits) == 1:
        second = _sigmoid(logits[0])
        return F.array(1.0 - second, second)
    return softmax(F.array(*logits))


@dataclass
class LogisticPack:
    """A fitted multinomial (or binary) logistic regression with its class order."""

    model: LogisticRegressionModel
    classes: list
    features: tuple[str, ...]
    name: str = "LogisticRegression"

    @property
    def weights(self) -> np.ndarray:
        return self.model.coefficientMatrix.toArray()

    @property
    def offsets(self) -> np.ndarray:
        return self.model.interceptVector.toArray()

    def class_probabilities(self, df: DataFrame) -> DataFrame:
        """Scores as plain expressions: compiled with the rest of the query, no model is shipped."""
        x = [finite_or_zero(F.col(c)) for c in self.features]
        logits = [
            _dot([F.lit(float(w)) for w in row], x) + F.lit(float(offset))
            for row, offset in zip(self.weights, self.offsets)
        ]
        return df.withColumn("_p", _softmax_of(logits))


@dataclass
class FoldedLogits:
    """The logistic regressions of one cross-validation: coefficients per fold, the constant last.

    With two classes a fold has one row of coefficients, else one per class. A class that a fold never saw has None.
    """

    coefficients: dict[int, list[list[float] | None]]
    classes: list
    features: tuple[str, ...]
    steps: int = 0
    converged: bool = True

    def rows_of(self, fold: int) -> list[list[float]]:
        """The coefficients of the model that left out a fold; a class it never saw can't be reached."""
        unseen = [*[0.0] * len(self.features), -1e300]
        return [[float(v) for v in row or unseen] for row in self.coefficients[fold]]


def _dot_with(x: Column) -> Callable[[Column], Column]:
    return lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def with_probabilities(fits: list[FoldedLogits], df: DataFrame, fold: str = "fold") -> DataFrame:
    """``df`` with ``_p0``, ``_p1``...: probabilities of each fit's classes, by its model that left out ``fold``.

    The models of a fold are one row of a small table that is joined by fold, whatever the number of fits: the scan is one.
    """
    table = [(f, [fit.rows_of(f) for fit in fits]) for f in fits[0].coefficients]
    models = df.sparkSession.createDataFrame(table, "_fold int, _w array<array<array<double>>>")
    joined = df.join(F.broadcast(models), df[fold] == models["_fold"]).drop("_fold")  # a row per fold
    out = joined
    for n, fit in enumerate(fits):
        x = F.array(*[finite_or_zero(F.col(c)) for c in fit.features], F.lit(1.0))
        logits = F.transform(F.get("_w", F.lit(n)), _dot_with(x))
        if len(fit.classes) == 2:
            second = _sigmoid(F.get(logits, F.lit(0)))
            out = out.withColumn(f"_p{n}", F.array(1.0 - second, second))
        else:
            out = settled(out, f"_z{n}", logits).withColumn(f"_p{n}", softmax(F.col(f"_z{n}"))).drop(f"_z{n}")
    return out.drop("_w")


def fit_logreg(
    df: DataFrame,
    features: tuple[str, ...] = K.FEATURE_NAMES,
    label: str = "label",
    c: float = 1.0,
    max_iter: int = 2000,
    tol: float = 1e-10,
) -> LogisticPack:
    """L2-penalised, class-balanced logistic regression without scaling.

    Spark averages the loss over the weights, so a penalty of 1 on the summed loss is
    ``1 / (C * sum of weights)``, and balanced weights sum to the number of rows.
    """
    counts = _class_counts(df, label)
    classes = list(counts)
    order = {c_: i for i, c_ in enumerate(classes)}
    data = _vectors(df, features).select(
        "_x",
        _by_class(F.col(label), order).cast("double").alias("_y"),
        _by_class(F.col(label), _balanced(counts)).alias("_w"),
    )
    estimator = LogisticRegression(
        featuresCol="_x",
        labelCol="_y",
        weightCol="_w",
        family="multinomial" if len(classes) > 2 else "binomial",
        standardization=False,
        regParam=1.0 / (c * sum(counts.values())),
        maxIter=max_iter,
        tol=tol,
    )
    return LogisticPack(estimator.fit(data), classes, features)


def logreg_gradient(
    pack: LogisticPack, df: DataFrame, label: str = "label", c: float = 1.0
) -> np.ndarray:
    """Gradient of the summed, balanced, penalised loss per class: features, then the intercept.

    Zero at the optimum; one aggregation. For more than two classes.
    """
    balance = _by_class(F.col(label), _balanced(_class_counts(df, label)))
    x = [finite_or_zero(F.col(name)) for name in pack.features] + [F.lit(1.0)]
    scored = pack.class_probabilities(df)
    rest = [
        balance * (F.get("_p", F.lit(i)) - (F.col(label) == name).cast("double"))
        for i, name in enumerate(pack.classes)
    ]
    sums = scored.agg(F.array(*[F.sum(r * v) for r in rest for v in x])).first()[0]
    slope = np.array(sums).reshape(len(rest), len(x))
    slope[:, :-1] += pack.weights / c
    return slope


@dataclass
class CalibratedSvcPack:
    """One-vs-rest linear SVMs with sigmoid calibration, averaged over inner folds.

    ``members[fold][class]`` is (weights with the intercept last, sigmoid slope, offset).
    """

    members: list[list[tuple[list[float], float, float]]]
    classes: list
    features: tuple[str, ...]
    name: str = "CalibratedLinearSVC"
    #: Steps of the margins and of the sigmoids, and whether both came to rest; of the fit, not of the model.
    steps: tuple[int, int] = field(default=(0, 0), compare=False)
    converged: bool = field(default=True, compare=False)

    def class_probabilities(self, df: DataFrame) -> DataFrame:
        x = [finite_or_zero(F.col(c)) for c in self.features] + [F.lit(1.0)]
        averaged = [F.lit(0.0)] * len(self.classes)
        for member in self.members:
            sigmoids = [
                _sigmoid(F.lit(slope) * _dot([F.lit(w) for w in weights], x) + F.lit(offset))
                for weights, slope, offset in member
            ]
            mass = reduce(lambda a, b: a + b, sigmoids)
            averaged = [a + s / mass / len(self.members) for a, s in zip(averaged, sigmoids)]
        return df.withColumn("_p", F.array(*averaged))


def _dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [x * y for x, y in zip(a, b)])


def _sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


class Fitted(dict):
    """Parameters per model, with the steps taken and how far the last one moved any of them."""

    steps, moved = 0, np.inf


def _indexed(data: DataFrame, classes: list) -> DataFrame:
    """(x, y, inner) with the place of the label in ``classes``, -1 if it is none of them."""
    place = F.coalesce(_by_class(F.col("_label"), {c: i for i, c in enumerate(classes)}), F.lit(-1))
    return data.select(F.col("_x").alias("x"), place.cast("int").alias("y"), F.col("_inner").cast("int").alias("inner"))


def _fit_margins(data: DataFrame, keys: list, weights: dict, size: int, steps: int) -> Fitted:
    """Squared-hinge SVMs (C = 1, intercept penalised like a weight) of all folds and classes.

    The loss is quadratic on the rows inside the margin, so a Newton step needs only their
    second moments. One pass per step serves every model; the driver solves systems of ``size`` unknowns.
    """
    classes = sorted({c for _, c in keys})
    rows = _indexed(data, classes)
    inner = np.array([i for i, _ in keys])
    cls = np.array([classes.index(c) for _, c in keys])
    importance = np.array([float(weights[c]) for _, c in keys])
    now = np.zeros((len(keys), size))
    best = Fitted({k: np.zeros(size) for k in keys})
    value = np.full(len(keys), np.inf)
    for _ in range(steps):
        sums = moments.model_sums(rows, len(keys), 1 + size + size * size, moments.hinge_kernel(now, inner, cls, importance))
        new = now.copy()
        for n, k in enumerate(keys):
            loss = 0.5 * float(now[n] @ now[n]) + sums[n, 0]
            if loss > value[n] + 1e-12 * max(1.0, value[n]):  # overshot: go back half way
                new[n] = (best[k] + now[n]) / 2
            else:
                value[n], best[k] = loss, now[n]
                curve = np.eye(size) + 2 * sums[n, 1 + size :].reshape(size, size)
                new[n] = np.linalg.solve(curve, 2 * sums[n, 1 : 1 + size])
        best.steps, best.moved = best.steps + 1, float(np.abs(new - now).max())
        now = new
        if best.moved < 1e-9:
            break
    return best


def _fit_sigmoids(data: DataFrame, margins: dict, size: int, steps: int) -> Fitted:
    """Slope and offset per model on the rows its inner fold left out, smoothed targets."""
    keys = list(margins)
    classes = sorted({c for _, c in keys})
    rows = _indexed(data, classes)
    models = np.array([margins[k] for k in keys])
    inner = np.array([i for i, _ in keys])
    cls = np.array([classes.index(c) for _, c in keys])
    curves, targets = np.tile([1.0, 0.0], (len(keys), 1)), np.zeros((len(keys), 2))
    counts = moments.model_sums(rows, len(keys), 7, moments.sigmoid_kernel(models, inner, cls, curves, targets))[:, :2]
    targets = np.c_[(counts[:, 0] + 1) / (counts[:, 0] + 2), 1 / (counts[:, 1] + 2)]
    fitted = Fitted()
    for _ in range(steps):
        sums = moments.model_sums(rows, len(keys), 7, moments.sigmoid_kernel(models, inner, cls, curves, targets))
        step = np.zeros_like(curves)
        for n, (zz, z1, one, gz, g1) in enumerate(sums[:, 2:]):
            step[n] = np.clip(np.linalg.solve(np.array([[zz, z1], [z1, one]]) + 1e-10 * np.eye(2), [gz, g1]), -5.0, 5.0)
        curves = curves + step
        fitted.steps, fitted.moved = fitted.steps + 1, float(np.abs(step).max())
        if fitted.moved < 1e-9:
            break
    fitted |= {k: curves[n] for n, k in enumerate(keys)}
    return fitted


def _map_of(values: dict) -> Column:
    return F.create_map(*[x if isinstance(x, Column) else F.lit(x) for item in values.items() for x in item])


def fit_linear_svc_calibrated(
    df: DataFrame,
    features: tuple[str, ...] = K.FEATURE_NAMES,
    label: str = "label",
    key: str = "post_id",
    inner_folds: int = 3,
    max_steps: int = 50,
) -> CalibratedSvcPack:
    """Balanced one-vs-rest SVMs, calibrated on the rows each inner fold leaves out."""
    counts = _class_counts(df, label)
    size = len(features) + 1
    folded = stratified_folds(df.drop("fold"), label=label, key=key, k=inner_folds, seed=1)
    x = F.array(*[finite_or_zero(F.col(c)) for c in features], F.lit(1.0))
    data = folded.select(x.alias("_x"), F.col(label).alias("_label"), F.col("fold").alias("_inner"))
    data = data.persist()
    keys = [(i, c) for i in range(1, inner_folds + 1) for c in counts]
    try:
        margins = _fit_margins(data, keys, _balanced(counts), size, max_steps)
        sigmoids = _fit_sigmoids(data, margins, size, max_steps)
    finally:
        data.unpersist()
    members = [
        [([float(v) for v in margins[i, c]], *map(float, sigmoids[i, c])) for c in counts]
        for i in range(1, inner_folds + 1)
    ]
    at_rest = margins.moved < 1e-6 and sigmoids.moved < 1e-6
    return CalibratedSvcPack(members, list(counts), features, steps=(margins.steps, sigmoids.steps), converged=at_rest)


def svc_slopes(pack: CalibratedSvcPack, df: DataFrame, label: str = "label", key: str = "post_id") -> DataFrame:
    """(inner, label, margin_slope, calibration_slope, calibrated_mass) of a fit on ``df``, from plain aggregates.

    The largest component of the gradient of the penalised squared hinge over the rows that train a machine, that of its
    sigmoid's loss over the rows it left out, and the sum of the sigmoid over these. Slopes are zero at the optimum.
    """
    folds = len(pack.members)
    folded = stratified_folds(df.drop("fold"), label=label, key=key, k=folds, seed=1)
    x = [finite_or_zero(F.col(c)) for c in pack.features] + [F.lit(1.0)]
    weights = _balanced(_class_counts(df, label))
    parts = []
    for inner, member in enumerate(pack.members, start=1):
        for cls, (w, slope, offset) in zip(pack.classes, member):
            own, held = F.col(label) == cls, F.col("fold") == inner
            margin = _dot([F.lit(float(v)) for v in w], x)
            sign = F.when(own, 1.0).otherwise(-1.0)
            pull = F.when(~held, F.greatest(1.0 - sign * margin, F.lit(0.0)) * F.when(own, weights[cls]).otherwise(1.0) * sign).otherwise(0.0)
            q = _sigmoid(F.lit(slope) * margin + F.lit(offset))
            n = lambda c: F.sum((held & c).cast("double"))
            parts.append(
                F.struct(
                    F.lit(inner).alias("inner"),
                    F.lit(cls).alias("label"),
                    F.array(*[F.lit(float(v)) - 2.0 * F.sum(pull * xi) for v, xi in zip(w, x)]).alias("margin"),
                    F.sum(F.when(held & own, q).otherwise(0.0)).alias("q_own"),
                    F.sum(F.when(held & ~own, q).otherwise(0.0)).alias("q_other"),
                    F.sum(F.when(held & own, margin).otherwise(0.0)).alias("z_own"),
                    F.sum(F.when(held & ~own, margin).otherwise(0.0)).alias("z_other"),
                    F.sum(F.when(held, q * margin).otherwise(0.0)).alias("qz"),
                    n(own).alias("pos"),
                    n(~own).alias("neg"),
                )
            )
    rows = folded.agg(F.array(*parts).alias("m")).select(F.inline("m"))
    high, low = (F.col("pos") + 1) / (F.col("pos") + 2), 1 / (F.col("neg") + 2)
    mass = F.col("q_own") + F.col("q_other")
    by_offset = F.abs(F.col("pos") * high + F.col("neg") * low - mass)
    by_slope = F.abs(F.col("z_own") * high + F.col("z_other") * low - F.col("qz"))
    return rows.select(
        "inner",
        "label",
        F.array_max(F.transform("margin", F.abs)).alias("margin_slope"),
        F.greatest(by_offset, by_slope).alias("calibration_slope"),
        mass.alias("calibrated_mass"),
    )


def _in_parallel(spark: SparkSession, jobs: list[Callable]) -> list:
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [f.result() for f in futures]


Pack = LogisticPack | CalibratedSvcPack


def with_proba(pack: Pack, df: DataFrame) -> DataFrame:
    """Append ``proba`` in canonical label order; labels the model never saw get 0."""
    classes = F.array(*[F.lit(c) for c in pack.classes])
    return pack.class_probabilities(df).withColumn("proba", align_proba(classes, F.col("_p"))).drop("_p")


def with_prediction(pack: Pack, df: DataFrame, name: str = "pred") -> DataFrame:
    classes = F.array(*[F.lit(c) for c in pack.classes])
    scored = pack.class_probabilities(df)
    return scored.withColumn(name, F.get(classes, argmax_first(F.col("_p")))).drop("_p")


def fit_folds(
    df: DataFrame, feature_sets: list[tuple[str, ...]], label: str = "label", c: float = 1.0
) -> list[FoldedLogits]:
    """For each set of features the logistic regressions that leave out each ``fold``, all fitted in shared passes.

    The loss is that of ``fit_logreg``: balanced by the rows a model trains on, penalised, constants free.
    """
    columns = list(dict.fromkeys(f for s in feature_sets for f in s))
    counted = df.groupBy("fold", label).agg(F.count("*").alias("n")).collect()
    classes, folds = sorted({r[1] for r in counted}), sorted({r[0] for r in counted})
    x = F.array(*[finite_or_zero(F.col(f)) for f in columns])
    place = _by_class(F.col(label), {v: i for i, v in enumerate(classes)})
    data = df.select(x.alias("x"), place.cast("int").alias("y"), F.col("fold").cast("int").alias("fold")).persist()
    tasks = {}
    for s, names in enumerate(feature_sets):
        for fold in folds:
            rest = {i: sum(r[2] for r in counted if r[1] == v and r[0] != fold) for i, v in enumerate(classes)}
            tasks[s, fold] = moments.LogitTask([columns.index(f) for f in names], fold, rest, 1.0 / c)
    try:
        moments.fit_logits(data, list(tasks.values()))
    finally:
        data.unpersist()
    out = []
    for s, names in enumerate(feature_sets):
        found = {}
        for fold in folds:
            t = tasks[s, fold]
            rows = t.best.tolist()
            if len(classes) > 2:  # a row for every class
                rows = [[0.0] * t.size, *rows] if t.free < len(t.classes) else rows
                rows = [rows[t.classes.index(i)] if i in t.classes else None for i in range(len(classes))]
            elif len(t.classes) < len(classes):  # one class only: certain
                rows = [[*[0.0] * (t.size - 1), 1e300 if t.classes == [1] else -1e300]]
            found[fold] = rows
        own = [tasks[s, fold] for fold in folds]
        out.append(FoldedLogits(found, classes, tuple(names), max((t.steps for t in own), default=0), all(t.done for t in own)))
    return out


def fold_predictions(fits: list[FoldedLogits], df: DataFrame, names: list[str]) -> DataFrame:
    """Out-of-fold predictions of several fits, one column each, in one scan of ``df``."""
    scored = with_probabilities(fits, df)
    best = [
        F.get(F.array(*[F.lit(c) for c in fit.classes]), argmax_first(F.col(f"_p{n}"))).alias(name)
        for n, (fit, name) in enumerate(zip(fits, names))
    ]
    return scored.select(*df.columns, *best)


def training_masses(fits: list[FoldedLogits], df: DataFrame, label: str = "label") -> DataFrame:
    """(model, fold, label, mass): what the probabilities of each class add up to, over the balanced rows a model trained on.

    ``model`` is the place in ``fits``. At the optimum every mass is the rows of the training part over its classes, since constants are free; for any
    other model, one of shuffled labels too, it isn't. One scan, each row once for every fold that it trains.
    """
    counted = df.groupBy("fold", label).agg(F.count("*").alias("n")).collect()
    folds = sorted({r[0] for r in counted})
    weights = []
    for fold in folds:
        rest: dict = {}
        for r in counted:
            if r[0] != fold:
                rest[r[1]] = rest.get(r[1], 0) + r[2]
        weights += [(fold, str(k), float(v)) for k, v in _balanced(rest).items()]
    table = df.sparkSession.createDataFrame(weights, "_left int, _name string, _weight double")
    each = df.withColumn("_name", F.col(label).cast("string")).join(F.broadcast(table), "_name").filter("_left <> fold")  # folds times classes
    each = with_probabilities(fits, each, "_left").withColumnsRenamed({"_left": "_f", "_weight": "_w"}).drop("fold").withColumnRenamed("_f", "fold")
    sums = [
        F.struct(F.lit(n).alias("model"), F.lit(c).alias(label), F.sum(F.col("_w") * F.col(f"_p{n}")[i]).alias("mass"))
        for n, fit in enumerate(fits)
        for i, c in enumerate(fit.classes)
    ]
    return each.groupBy("fold").agg(F.array(*sums).alias("m")).select("fold", F.inline("m")).select("model", "fold", label, "mass")


def cross_validate(
    df: DataFrame,
    features: tuple[str, ...] = K.FEATURE_NAMES,
    label: str = "label",
    fit: Callable[..., Pack] | None = None,
) -> DataFrame:
    """Out-of-fold predictions of a frame with ``fold``; every row appears once.

    Logistic regressions of all folds are fitted together, other models (``fit``) side by side. The held-out rows are scored when the
    result is read, from ``df``: give a stored frame.
    """
    if fit is None:
        return fold_predictions(fit_folds(df, [features], label), df, ["pred"])
    data = df.persist()
    try:
        folds = [r[0] for r in data.select("fold").distinct().orderBy("fold").collect()]
        job = lambda f: fit(data.filter(F.col("fold") != f), features, label)
        packs = _in_parallel(df.sparkSession, [lambda f=f: job(f) for f in folds])
    finally:
        data.unpersist()
    held = [with_prediction(p, df.filter(F.col("fold") == f)) for f, p in zip(folds, packs)]
    return reduce(DataFrame.unionByName, held)


def fold_macro_f1(predictions: DataFrame) -> list[float]:
    """Macro-F1 of every fold, in the order of the folds."""
    per_fold = fold_metrics(confusion(predictions))
    return [r[0] for r in per_fold.orderBy("fold").select("macro_f1").collect()]


@dataclass
class TrainResult:
    pack: Pack
    predictions: DataFrame
    fold_scores: list[float]

    @property
    def mean_macro_f1(self) -> float:
        return float(np.mean(self.fold_scores))

    @property
    def std_macro_f1(self) -> float:
        return float(np.std(self.fold_scores))


def select_and_fit(
    folded: DataFrame,
    features: tuple[str, ...] = K.FEATURE_NAMES,
    floor: float = K.LOGREG_F1_FLOOR,
) -> TrainResult:
    """Logistic regression, unless it stays below the floor and the SVM is strictly better.

    A frame without rows is an error: there is nothing to learn from.
    """
    if not folded.head(1):
        raise ValueError("no usable record to learn from")
    predictions = cross_validate(folded, features)
    scores, fit = fold_macro_f1(predictions), fit_logreg
    if np.mean(scores) < floor:
        challenger = cross_validate(folded, features, fit=fit_linear_svc_calibrated)
        better = fold_macro_f1(challenger)
        if np.mean(better) > np.mean(scores):
            predictions, scores, fit = challenger, better, fit_linear_svc_calibrated
    return TrainResult(fit(folded, features), predictions, scores)


def feature_subsets() -> list[tuple[str, ...]]:
    """The seven non-empty subsets of the core signals, small ones first."""
    sizes = range(1, len(K.CORE_SIGNALS) + 1)
    return [s for n in sizes for s in itertools.combinations(K.CORE_SIGNALS, n)]


def ablation_columns(subset: tuple[str, ...]) -> tuple[str, ...]:
    """The features of a subset; the auxiliary columns always stay."""
    return tuple(c for c in K.FEATURE_NAMES if c in subset or c in K.AUX_SIGNALS)


def ablation_predictions(folded: DataFrame, fits: list[FoldedLogits] | None = None) -> DataFrame:
    """(configuration, n_features, fold, label, pred) of every row and subset: 35 models, fitted together, one scan to score."""
    subsets = feature_subsets()
    fits = fits or fit_folds(folded, [ablation_columns(s) for s in subsets])
    names = [f"_pred{n}" for n in range(len(subsets))]
    scored = fold_predictions(fits, folded.select("fold", "label", *K.FEATURE_NAMES), names)
    each = F.array(
        *[
            F.struct(F.lit("+".join(s)).alias("configuration"), F.lit(len(fit.features)).alias("n_features"), F.col(n).alias("pred"))
            for s, fit, n in zip(subsets, fits, names)
        ]
    )
    return scored.select("fold", "label", F.inline(each)).select("configuration", "n_features", "fold", "label", "pred")


def ablation(folded: DataFrame, fits: list[FoldedLogits] | None = None) -> DataFrame:
    """Mean accuracy and macro-F1 of every subset."""
    keys = ("configuration", "n_features", "fold")
    per_fold = fold_metrics(confusion(ablation_predictions(folded, fits), keys), keys)
    return per_fold.groupBy("configuration", "n_features").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.avg("macro_f1").alias("mean_macro_f1")
    )


#: Columns of the caption's polarity.
POLARITY = ("p_neg", "p_pos")


def unimodal_baseline(folded: DataFrame) -> DataFrame:
    """The same protocol on the caption's polarity alone (columns ``p_neg``, ``p_pos``)."""
    return fold_metrics(confusion(cross_validate(folded, POLARITY)))


def binary_folds(features: DataFrame, key: str = "post_id") -> DataFrame:
    """Rows with target ``y`` (1 for sarcasm) and folds of it, stored: the fits, the scoring and the rule read them."""
    target = features.withColumn("y", is_sarcasm(F.col("label"))).drop("label")
    return cut_lineage(stratified_folds(target, label="y", key=key))


def binary_metrics(folded: DataFrame, fit: FoldedLogits) -> DataFrame:
    """Per fold: accuracy and F1 of a fit, and the threshold rule's where there is a column for it."""
    scored = fold_predictions([fit], folded, ["pred"])
    conf = confusion(scored.withColumnRenamed("y", "label"))
    hit = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    pos = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    tp = pos((F.col("label") == 1) & (F.col("pred") == 1))
    both = pos(F.col("label") == 1) + pos(F.col("pred") == 1)
    fitted = conf.groupBy("fold").agg(
        (hit / F.sum("n")).alias("accuracy"),
        F.when(both > 0, 2 * tp / both).otherwise(0.0).alias("f1"),
    )
    if "Dsem" not in folded.columns:
        return fitted
    rule = dsem_rule(folded).select("fold", "threshold", F.col("accuracy").alias("dsem_rule_accuracy"))
    return fitted.join(rule, "fold")


def binary_sarcasm(
    features: DataFrame, columns: tuple[str, ...] = K.DISCREPANCY_SIGNALS, key: str = "post_id"
) -> DataFrame:
    """Per fold: accuracy and F1 of a binary classifier, and of the threshold rule."""
    folded = binary_folds(features, key)
    return binary_metrics(folded, fit_folds(folded, [columns], "y")[0])


def save_model(pack: Pack, path: str) -> None:
    """Model folder plus a metadata file with class order, feature and label names.

    The few numbers of a calibrated SVM stand in the metadata itself.
    """
    spark = SparkSession.active()
    meta = {
        "classifier_name": pack.name,
        "classes": pack.classes,
        "feature_names": list(pack.features),
        "label_order": list(K.LABELS),
    }
    if isinstance(pack, CalibratedSvcPack):
        meta["members"] = pack.members
    else:
        pack.model.write().overwrite().save(f"{path}/model")
    frame = spark.range(1).select(F.lit(json.dumps(meta)).alias("value"))
    frame.write.mode("overwrite").text(f"{path}/metadata")


def load_model(path: str) -> Pack:
    spark = SparkSession.active()
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    classes, features, name = meta["classes"], tuple(meta["feature_names"]), meta["classifier_name"]
    if "members" in meta:
        members = [[(w, slope, offset) for w, slope, offset in m] for m in meta["members"]]
        return CalibratedSvcPack(members, classes, features, name)
    return LogisticPack(LogisticRegressionModel.load(f"{path}/model"), classes, features, name)


def argmax_label(proba: Column) -> Column:
    return F.get(label_array(), argmax_first(proba))
