"""From class probabilities and discrepancy features to reviewed predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.functions import text as T
from tonegap.functions.vectors import argmax_first


def label_array() -> Column:
    return F.array(*[F.lit(x) for x in K.LABELS])


def conflict_target(polarity_t: Column, polarity_hat: Column, dsen: Column) -> Column:
    """Sarcasm class named by opposite polarities of caption and description, else null."""
    strong = dsen >= K.CONFLICT_MIN_DSEN
    negative_text = (polarity_t <= -K.CONFLICT_TEXT_BAND) & (polarity_hat >= K.CONFLICT_HAT_BAND)
    positive_text = (polarity_t >= K.CONFLICT_TEXT_BAND) & (polarity_hat <= -K.CONFLICT_HAT_BAND)
    return F.when(negative_text & strong, "negative_sarcasm").when(
        positive_text & strong, "positive_sarcasm"
    )


def refine_polarity_conflict(
    label: Column, confidence: Column, proba: Column, target: Column
) -> tuple[Column, Column]:
    """(label, confidence) after promotion to the sarcasm class the polarities call for."""
    moves = target.isNotNull() & (label != target) & label.isin(*K.LABELS)
    target_p = F.coalesce(
        F.get(proba, (F.array_position(label_array(), target) - 1).cast("int")), F.lit(0.0)
    )
    boosted = F.least(confidence + K.CONFLICT_BOOST, F.lit(K.CONFLICT_BOOST_CAP))
    raised = F.least(
        F.greatest(target_p, boosted, F.lit(K.CONFLICT_FLOOR)), F.lit(K.CONFIDENCE_CAP)
    )
    return F.when(moves, target).otherwise(label), F.when(moves, raised).otherwise(confidence)


def low_fidelity(fvt: Column, threshold: float = K.FVT_THRESHOLD) -> Column:
    return fvt < threshold


def predict_table(
    features: DataFrame, proba: str = "proba", *, fvt_threshold: float = K.FVT_THRESHOLD
) -> DataFrame:
    """Append ``prediction`` (label, confidence, discrepancy_vector, low_fidelity).

    ``proba`` holds the class probabilities in canonical label order.
    """
    p = F.col(proba)
    target = conflict_target(F.col("polarity_T"), F.col("polarity_T_hat"), F.col("Dsen"))
    first = features.withColumns(
        {
            "_label": F.get(label_array(), argmax_first(p)),
            "_confidence": F.array_max(p).cast("double"),
            "_target": target,
        }
    )
    label, confidence = refine_polarity_conflict(
        F.col("_label"), F.col("_confidence"), p, F.col("_target")
    )
    prediction = F.struct(
        label.alias("label"),
        confidence.alias("confidence"),
        F.struct(*K.FEATURE_NAMES).alias("discrepancy_vector"),
        low_fidelity(F.col("Fvt"), fvt_threshold).alias("low_fidelity"),
    )
    return first.withColumn("prediction", prediction).drop("_label", "_confidence", "_target")


def review_table(predicted: DataFrame, gold: DataFrame, key: str = "post_id") -> DataFrame:
    """Predictions beside gold labels, with display names and the polarity phrase."""
    joined = predicted.join(gold.select(key, F.col("label").alias("gold_label")), key, "left")
    label = F.col("prediction.label")
    return joined.select(
        key,
        label.alias("label"),
        T.label_display(label).alias("label_name"),
        F.col("prediction.confidence").alias("confidence"),
        "gold_label",
        T.label_display(F.col("gold_label")).alias("gold_name"),
        (label == F.col("gold_label")).alias("matches"),
        T.polarity_phrase(F.col("prediction.discrepancy_vector.polarity_T")).alias("text_polarity"),
        F.col("prediction.low_fidelity").alias("low_fidelity"),
        *[F.col(f"prediction.discrepancy_vector.{c}").alias(c) for c in K.FEATURE_NAMES],
    )
