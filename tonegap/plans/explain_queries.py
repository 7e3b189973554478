"""Queries for token display, attention rollout and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.operators import attention as ATT
from tonegap.operators import predict as P
from tonegap.operators import tokens as TOK
from tonegap.operators.learning import argmax_label
from tonegap.plans import inputs as I
from tonegap.plans.registry import query
from tonegap.plans.text_queries import SQL_DISPLAY

# --- tokens -----------------------------------------------------------------

SQL_PIECE = """CASE WHEN starts_with(token, '▁') THEN CASE WHEN length(token) = 1 THEN ' ' ELSE substring(token, 2) END
  WHEN starts_with(token, '##') THEN substring(token, 3) ELSE token END"""
REMAPPED = f"""{I.TOKENS},
edges AS (SELECT post_id, min(pos) AS a, max(pos) AS b FROM tokens WHERE token NOT IN ({I.SQL_ANCHORS}) GROUP BY post_id),
remapped AS (
  SELECT post_id, CASE WHEN pos BETWEEN a AND b THEN a + b - pos ELSE pos END AS pos, token, score
  FROM tokens LEFT JOIN edges USING (post_id))"""
STRIPPED = f"""{I.TOKENS},
counted AS (SELECT *, count(*) FILTER (WHERE token NOT IN ({I.SQL_ANCHORS})) OVER (PARTITION BY post_id) AS words FROM tokens),
stripped AS (SELECT post_id, pos, token, score FROM counted WHERE token NOT IN ({I.SQL_ANCHORS}) OR words = 0)"""
MERGE_STEPS = f"""pieces AS (
  SELECT *, starts_with(token, '##') OR regexp_matches(piece, '^[!.,;:?؟،٪٫…]+$') AS glued
  FROM (SELECT *, {SQL_PIECE} AS piece FROM stripped) WHERE {I.sql_strip('piece')} <> ''),
islands AS (
  SELECT *, sum(CAST(NOT glued AS INTEGER)) OVER (PARTITION BY post_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS word FROM pieces),
merged AS (
  SELECT post_id, min(pos) AS start, string_agg(piece, '' ORDER BY pos) AS text, max(score) AS score
  FROM islands GROUP BY post_id, word)"""


@query(f"WITH {I.TOKENS} SELECT post_id, pos, {SQL_PIECE} AS piece FROM tokens")
def clean_tokens(spark, sf):
    return I.tokens(spark, sf).select("post_id", "pos", TOK.clean_token(F.col("token")).alias("piece"))


@query(f"WITH {REMAPPED} SELECT * FROM remapped")
def rtl_remap(spark, sf):
    return TOK.rtl_remap(I.tokens(spark, sf))


@query(f"WITH {STRIPPED} SELECT * FROM stripped")
def strip_anchors(spark, sf):
    return TOK.strip_anchors(I.tokens(spark, sf))


@query(f"WITH {STRIPPED}, {MERGE_STEPS} SELECT * FROM merged")
def merge_tokens(spark, sf):
    return TOK.merge_tokens(TOK.strip_anchors(I.tokens(spark, sf)))


SQL_SCALED = I.r6(
    """CASE WHEN max(score) OVER p > min(score) OVER p
      THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 0 END"""
)


@query(f"WITH {I.TOKENS} SELECT post_id, pos, {SQL_SCALED} AS normalized FROM tokens WINDOW p AS (PARTITION BY post_id)")
def minmax_normalize(spark, sf):
    return TOK.minmax_normalize(I.tokens(spark, sf)).select("post_id", "pos", I.rounded("normalized"))


@query(
    f"""WITH {STRIPPED}, {MERGE_STEPS}
    SELECT post_id, start, text, score, {SQL_SCALED} AS normalized FROM merged WINDOW p AS (PARTITION BY post_id)"""
)
def word_heatmap(spark, sf):
    shown = TOK.word_heatmap(I.tokens(spark, sf))
    return shown.select("post_id", "start", "text", "score", I.rounded("normalized"))


# --- attention --------------------------------------------------------------

LAYERS = 2
ROLLED = f"""{I.RESIDUAL},
rolled AS (
  SELECT a.post_id, a.i, r.j, sum(a.w * r.w) AS w FROM residual a
  JOIN residual r ON r.post_id = a.post_id AND r.i = a.j AND r.layer = 0 WHERE a.layer = 1 GROUP BY a.post_id, a.i, r.j)"""


@query(f"WITH {I.ATTENTION} SELECT post_id, layer, i, j, {I.r6('max(w)')} AS w FROM attention GROUP BY post_id, layer, i, j")
def fuse_heads(spark, sf):
    return ATT.fuse_heads(I.attention(spark, sf), "max").select("post_id", "layer", "i", "j", I.rounded("w"))


@query(f"WITH {I.RESIDUAL} SELECT post_id, layer, i, j, {I.r6('w')} AS w FROM residual")
def add_residual(spark, sf):
    fused = ATT.fuse_heads(I.attention(spark, sf))
    return ATT.add_residual(fused).select("post_id", "layer", "i", "j", I.rounded("w"))


@query(f"WITH {ROLLED} SELECT post_id, i, j, {I.r6('w')} AS w FROM rolled")
def rollout(spark, sf):
    return ATT.rollout(I.attention(spark, sf), LAYERS).select("post_id", "i", "j", I.rounded("w"))


@query(f"WITH {ROLLED} SELECT post_id, j, {I.r6('w')} AS score FROM rolled WHERE i = 0")
def cls_scores(spark, sf):
    return ATT.cls_rollout(I.attention(spark, sf), LAYERS).select("post_id", "j", I.rounded("score"))


@query(
    f"""WITH row AS (
      SELECT CAST(vec_id AS VARCHAR) AS post_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
    patches AS (SELECT post_id, CAST(j - 1 AS INTEGER) AS p, CAST(v AS DOUBLE) AS score FROM row WHERE j >= 1),
    sizes AS (SELECT post_id, CAST(ceil(sqrt(count(*))) AS INTEGER) AS side FROM patches GROUP BY post_id),
    cells AS (SELECT post_id, side, CAST(unnest(range(side * side)) AS INTEGER) AS p FROM sizes)
    SELECT post_id, p // side AS row, p % side AS col, {I.r6('coalesce(score, 0)')} AS score
    FROM cells LEFT JOIN patches USING (post_id, p)"""
)
def patch_grid(spark, sf):
    """The 64 entries of a vector as one CLS row: 63 patches on an 8 x 8 grid, one cell padded."""
    row = I.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("post_id"), F.posexplode("embedding").alias("j", "v")
    )
    scores = row.select("post_id", "j", F.col("v").cast("double").alias("score"))
    return ATT.patch_grid(scores).select("post_id", "row", "col", I.rounded("score"))


# --- predictions ------------------------------------------------------------

PREDICTED = f"""{I.FEATURES},
first AS (SELECT *, {I.SQL_ARGMAX} AS label0, list_max(proba) AS conf0,
  CASE WHEN polarity_T <= -0.05 AND polarity_T_hat >= 0.15 AND Dsen >= 0.35 THEN 'negative_sarcasm'
       WHEN polarity_T >= 0.05 AND polarity_T_hat <= -0.15 AND Dsen >= 0.35 THEN 'positive_sarcasm' END AS target
  FROM features),
predicted AS (
  SELECT post_id, label AS gold_label, {', '.join(K.FEATURE_NAMES)}, Fvt < 0.2 AS low_fidelity,
         CASE WHEN target IS NOT NULL AND target <> label0 THEN target ELSE label0 END AS label,
         CASE WHEN target IS NOT NULL AND target <> label0
              THEN least(0.99, greatest(proba[CASE target WHEN 'positive_sarcasm' THEN 4 ELSE 5 END], least(conf0 + 0.15, 0.85), 0.35))
              ELSE conf0 END AS confidence
  FROM first)"""
SQL_FEATURES = ", ".join(f"{I.r6(c)} AS {c}" for c in K.FEATURE_NAMES)


@query(f"WITH {PREDICTED} SELECT post_id, label, {I.r6('confidence')} AS confidence, low_fidelity, {SQL_FEATURES} FROM predicted")
def predict_table(spark, sf):
    predicted = P.predict_table(I.features(spark, sf)).select("post_id", "prediction.*")
    return predicted.select(
        "post_id",
        "label",
        I.rounded("confidence"),
        "low_fidelity",
        *[I.rounded(F.col(f"discrepancy_vector.{c}"), c) for c in K.FEATURE_NAMES],
    )


@query(
    f"""WITH {PREDICTED} SELECT f.post_id, label0 AS before, p.label AS after, {I.r6('p.confidence')} AS confidence
    FROM first f JOIN predicted p ON p.post_id = f.post_id"""
)
def refine_polarity_conflict(spark, sf):
    base = I.features(spark, sf).select(
        "post_id",
        "proba",
        argmax_label(F.col("proba")).alias("before"),
        F.array_max("proba").alias("conf"),
        P.conflict_target(F.col("polarity_T"), F.col("polarity_T_hat"), F.col("Dsen")).alias("target"),
    )
    label, confidence = P.refine_polarity_conflict(
        F.col("before"), F.col("conf"), F.col("proba"), F.col("target")
    )
    return base.select("post_id", "before", label.alias("after"), I.rounded(confidence, "confidence"))


@query(f"WITH {I.FEATURES} SELECT post_id, Fvt < 0.2 AS low_fidelity FROM features")
def low_fidelity(spark, sf):
    return I.features(spark, sf).select("post_id", P.low_fidelity(F.col("Fvt")).alias("low_fidelity"))


def _display(column: str) -> str:
    return SQL_DISPLAY.replace("CASE label", f"CASE {column}").replace("ELSE label", f"ELSE {column}")


@query(
    f"""WITH {PREDICTED} SELECT post_id, label, {_display('label')} AS label_name, {I.r6('confidence')} AS confidence,
      gold_label, {_display('gold_label')} AS gold_name, label = gold_label AS matches,
      CASE WHEN polarity_T > 0.15 THEN 'positive' WHEN polarity_T < -0.15 THEN 'negative' ELSE 'neutral' END AS text_polarity,
      low_fidelity, {SQL_FEATURES} FROM predicted"""
)
def review_table(spark, sf):
    features = I.features(spark, sf)
    reviewed = P.review_table(P.predict_table(features), features.select("post_id", "label"))
    numbers = ("confidence", *K.FEATURE_NAMES)
    return reviewed.select(*[I.rounded(c) if c in numbers else c for c in reviewed.columns])
