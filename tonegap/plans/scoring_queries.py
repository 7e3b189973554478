"""Queries for scorers, stages, learning and streams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.functions import text as T
from tonegap.functions import vectors as V
from tonegap.operators import folds, learning, metrics
from tonegap.operators import gates as G
from tonegap.operators import scoring as SC
from tonegap.plans import inputs as I
from tonegap.plans.curation_queries import _NEG, _POS, SQL_KEYWORD_LABEL, admitted_sql
from tonegap.plans.evaluation_queries import RULE_STEPS
from tonegap.plans.explain_queries import PREDICTED
from tonegap.plans.io_queries import SQL_SIX
from tonegap.plans.registry import query
from tonegap.session import scratch_path
from tonegap.sources import tables as S
from tonegap.streaming import admission, jobs

# --- stand-in scorers: tiny models with the interface of the real ones ------


def _reversed_words(texts: pa.Array) -> pa.Array:
    """The words of each text in reverse: all words of all texts reversed at once, then the texts."""
    words = pc.split_pattern(texts, " ")
    sizes = words.value_lengths().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes[::-1])])
    flat = words.flatten().take(pa.array(np.arange(sizes.sum())[::-1]))
    back = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
    return pc.binary_join(back, " ").take(pa.array(np.arange(len(texts))[::-1]))


def _letter_vectors(texts: pa.Array) -> list[np.ndarray]:
    """Counts of the letters a..h in each text."""
    return list(np.stack([pc.count_substring(texts, c).to_numpy(zero_copy_only=False) for c in "abcdefgh"], axis=1).astype(float))


def _texts(content: pd.Series) -> pa.Array:
    return pa.array(content, pa.binary()).cast(pa.string())


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Media bytes to a description: the file's own text, reversed word by word."""
    for b in batches:
        told = pc.binary_join_element_wise("Assistant: ", _reversed_words(_texts(b["content"])), "")
        yield pd.DataFrame({"post_id": b["post_id"].to_numpy(), "generated": told.to_pandas()})


def _embed_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"post_id": b["post_id"].to_numpy(), "vector": _letter_vectors(pa.array(b["text"], pa.string()))})


def _embed_media(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"post_id": b["post_id"].to_numpy(), "vector": _letter_vectors(_texts(b["content"]))})


DESCRIBE = SC.register_scorer(SC.Scorer("reversed_words", ("content",), "generated string", _describe))
EMBED_TEXT = SC.register_scorer(SC.Scorer("letters", ("text",), "vector array<double>", _embed_text))
EMBED_MEDIA = SC.register_scorer(SC.Scorer("media_letters", ("content",), "vector array<double>", _embed_media))


def media(spark, sf, present="true"):
    """Document texts as the contents of media files; texts have inner spaces only."""
    return I.texts(spark, sf, "documents").filter(present).select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.concat(F.lit("/m/"), F.col("doc_id").cast("string")).alias("path"),
        T.collapse_ws(F.col("text")).cast("binary").alias("content"),
    )


SQL_FLAT = I.sql_collapse("text")
SQL_REVERSED = f"array_to_string(list_reverse(string_split({SQL_FLAT}, ' ')), ' ')"


def _sql_letters(x: str) -> str:
    return "[" + ", ".join(f"CAST(length({x}) - length(replace({x}, '{c}', '')) AS DOUBLE)" for c in "abcdefgh") + "]"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS post_id, {SQL_REVERSED} AS generated FROM documents")
def score_media_text(spark, sf):
    return SC.score_media_text(media(spark, sf), SC.get_scorer("reversed_words"))


SQL_PARTS = ", ".join(f"v[{i + 1}] AS v{i}" for i in range(8))


def _parts(vector: str = "vector"):
    return [F.get(vector, F.lit(i)).alias(f"v{i}") for i in range(8)]


@query(f"SELECT post_id, {SQL_PARTS} FROM (SELECT CAST(doc_id AS VARCHAR) AS post_id, {_sql_letters('text')} AS v FROM documents)")
def score_text_vector(spark, sf):
    texts = I.texts(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("post_id"), "text")
    return SC.score_text_vector(texts, SC.get_scorer("letters")).select("post_id", *_parts())


SQL_UNIT = ", ".join(
    I.r6(f"v[{i + 1}] / greatest(sqrt(list_inner_product(v, v)), 1e-8)") + f" AS v{i}" for i in range(8)
)


@query(f"SELECT post_id, {SQL_UNIT} FROM (SELECT CAST(doc_id AS VARCHAR) AS post_id, {_sql_letters('text')} AS v FROM documents)")
def score_media_vector(spark, sf):
    scored = SC.score_media_vector(media(spark, sf), SC.get_scorer("media_letters"))
    return scored.select("post_id", *[I.rounded(F.get("vector", F.lit(i)), f"v{i}") for i in range(8)])


SQL_POLARITY = (
    f"{I.r6(f'({_NEG} + 1) / CAST({_POS} + {_NEG} + 2 AS DOUBLE)')} AS p_neg,"
    f" {I.r6(f'({_POS} + 1) / CAST({_POS} + {_NEG} + 2 AS DOUBLE)')} AS p_pos"
)


def _polarity(df):
    p = SC.keyword_polarity(F.col("caption"))
    return df.select("post_id", p.alias("p")).select(
        "post_id", F.get("p", F.lit(0)).alias("p_neg"), F.get("p", F.lit(1)).alias("p_pos")
    )


@query(f"WITH {I.CAPTIONS} SELECT post_id, {SQL_POLARITY} FROM captions")
def score_polarity(spark, sf):
    return _polarity(I.captions(spark, sf)).select("post_id", I.rounded("p_neg"), I.rounded("p_pos"))


@query(
    f"""WITH z AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
    p AS (SELECT vec_id, 1 / (1 + exp(b - a)) AS first FROM z)
    SELECT vec_id, {I.r6('CASE WHEN vec_id % 2 = 0 THEN 1 - first ELSE first END')} AS p_neg,
      {I.r6('CASE WHEN vec_id % 2 = 0 THEN first ELSE 1 - first END')} AS p_pos FROM p"""
)
def score_polarity_logits(spark, sf):
    """Two logits per row, in a model's own class order: happy before sad, or classes without meaning."""
    named = F.create_map(F.lit(0), F.lit("HAPPY"), F.lit(1), F.lit("SAD"))
    plain = F.create_map(F.lit(0), F.lit("LABEL_0"), F.lit(1), F.lit("LABEL_1"))
    p = SC.polarity_from_logits(F.slice("embedding", 1, 2), F.when(F.col("vec_id") % 2 == 0, named).otherwise(plain))
    return I.table(spark, sf, "embeddings").select("vec_id", p.alias("p")).select(
        "vec_id", I.rounded(F.get("p", F.lit(0)), "p_neg"), I.rounded(F.get("p", F.lit(1)), "p_pos")
    )


@query(f"WITH {I.CAPTIONS} SELECT post_id, {SQL_KEYWORD_LABEL} AS label, 'weak_keywords' AS annotator FROM captions")
def score_with_fallback(spark, sf):
    """No model can be loaded here, so keywords take over and the annotator says so."""

    def load():
        raise ImportError("no model runtime")

    scored = SC.score_with_fallback(I.captions(spark, sf), load)
    return scored.select("post_id", F.col("weak_label").alias("label"), "annotator")


@query(f"WITH {I.CAPTIONS} SELECT image_path AS path, length(caption) % 2 = 0 AS keep FROM captions")
def media_predicate(spark, sf):
    """A detector over file contents that keeps texts of even length; stored, then read."""

    def even(content: pd.Series) -> pd.Series:
        return content.map(lambda c: len(bytes(c).decode()) % 2 == 0)

    files = I.captions(spark, sf).select(
        F.col("image_path").alias("path"), F.col("caption").cast("binary").alias("content")
    )
    path = scratch_path(spark, "detected")
    SC.media_predicate(files, even).write.parquet(path)
    return spark.read.parquet(path)


@query(f"WITH {I.CAPTIONS} SELECT post_id, {SQL_POLARITY} FROM captions")
def run_stage(spark, sf):
    """An interrupted stage: one language first, then everything that is still missing."""
    posts = I.captions(spark, sf).select("post_id", "lang", "caption")
    path = scratch_path(spark, "stage")
    SC.run_stage(posts.filter("lang = 'en'"), path, _polarity)
    done = SC.run_stage(posts, path, _polarity)
    return done.select("post_id", I.rounded("p_neg"), I.rounded("p_pos"))


@query(f"WITH {I.CAPTIONS} SELECT post_id FROM captions WHERE lang <> 'en'")
def pending_stage(spark, sf):
    posts = I.captions(spark, sf).select("post_id", "lang")
    return SC.pending_stage(posts, posts.filter("lang = 'en'")).select("post_id")


@query("SELECT CAST(doc_id AS VARCHAR) AS post_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_upstream(spark, sf):
    records = I.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("post_id"))
    stage = I.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("post_id"))
    return SC.missing_upstream(records, stage)


@query("SELECT CAST(doc_id AS VARCHAR) AS post_id FROM labels")
def require_complete(spark, sf):
    """Labelled documents need their document; the check passes and hands the rows on."""
    records = I.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("post_id"))
    stage = I.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("post_id"))
    return SC.require_complete(records, stage, "documents")


@query(
    f"WITH {I.FEATURES} SELECT post_id, {I.r6('Dsem')} AS Dsem, {I.r6('Fvt')} AS Fvt, {I.r6('cos_TI')} AS cos_TI FROM features"
)
def lookup_text_vectors(spark, sf):
    wide = I.stage_vectors(spark, sf)
    joined = SC.lookup_text_vectors(
        wide.select("post_id", "emb_I"), wide.select("post_id", "emb_T", "emb_T_hat")
    )
    return joined.select("post_id", *[I.rounded(c) for c in ("Dsem", "Fvt", "cos_TI")])


@query(
    f"""WITH {I.FEATURES} SELECT post_id, label, {SQL_SIX} FROM features
    WHERE CAST(post_id AS BIGINT) % 5 <> 0 AND CAST(post_id AS BIGINT) % 7 <> 0"""
)
def assemble_features(spark, sf):
    """Both stages lack some posts; only posts of both are assembled."""
    wide = I.stage_vectors(spark, sf)
    number = F.col("post_id").cast("long")
    vectors = V.with_features(wide.filter(number % 5 != 0)).select("post_id", "Dsem", "Fvt", "cos_TI")
    polarity = wide.filter(number % 7 != 0).select("post_id", "pol_T", "pol_T_hat")
    full = SC.assemble_features(wide.select("post_id", "label"), vectors, polarity)
    return full.select("post_id", "label", *[I.rounded(c) for c in K.FEATURE_NAMES])


def _sql_cos(a: str, b: str) -> str:
    return f"""CASE WHEN list_inner_product({a}, {a}) = 0 OR list_inner_product({b}, {b}) = 0 THEN 0
      ELSE list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))) END"""


def _sql_keyword_probs(x: str) -> str:
    pos, neg = I.sql_keyword_counts(x)
    return f"({neg} + 1) / CAST({pos} + {neg} + 2 AS DOUBLE)"


ONE_PASS = f"""docs AS (SELECT CAST(doc_id AS VARCHAR) AS post_id, {SQL_FLAT} AS flat, n_chars FROM documents),
described AS (SELECT *, flat || ' love' AS caption, array_to_string(list_reverse(string_split(flat, ' ')), ' ') AS hat
  FROM docs WHERE n_chars % 13 <> 0),
vecs AS (SELECT *, {_sql_letters('caption')} AS t, {_sql_letters('hat')} AS h, {_sql_letters('flat')} AS i,
  {_sql_keyword_probs('caption')} AS nt, {_sql_keyword_probs('hat')} AS nh FROM described),
six AS (SELECT post_id, greatest(0, least(2, 1 - {_sql_cos('t', 'h')})) AS Dsem, 2 * abs(nt - nh) AS Dsen,
  {_sql_cos('i', 'h')} AS Fvt, {_sql_cos('t', 'i')} AS cos_TI, 1 - 2 * nt AS polarity_T, 1 - 2 * nh AS polarity_T_hat FROM vecs)"""


@query(f"WITH {ONE_PASS} SELECT post_id, {SQL_SIX}, (SELECT count(*) FROM docs WHERE n_chars % 13 = 0) AS skipped FROM six")
def features_one_pass(spark, sf):
    """Features of all records with media, and how many records had none."""
    docs = I.texts(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("post_id"),
        F.lit("neutral").alias("label"),
        F.concat(T.collapse_ws(F.col("text")), F.lit(" love")).alias("caption"),
        F.concat(F.lit("/m/"), F.col("doc_id").cast("string")).alias("image_path"),
    )
    files = media(spark, sf, "n_chars % 13 <> 0").select("path", "content")
    path = scratch_path(spark, "features")
    skipped = SC.build_features(docs, files, path, DESCRIBE, EMBED_TEXT, EMBED_MEDIA)
    rows = spark.read.parquet(path)
    return rows.select("post_id", *[I.rounded(c) for c in K.FEATURE_NAMES], F.lit(skipped).cast("long").alias("skipped"))


# --- learning: exact columns beside what only holds for a right fit ----------


def _folded(spark, sf):
    """Features with folds, stored once for the many fits."""
    path = scratch_path(spark, "folded")
    polarity = [F.get("pol_T", F.lit(i)).alias(n) for i, n in enumerate(("p_neg", "p_pos"))]
    rows = I.features(spark, sf).select("post_id", "label", *K.FEATURE_NAMES, *polarity)
    folds.stratified_folds(rows).write.parquet(path)
    return spark.read.parquet(path)


def _recomputed(predictions, label="label"):
    """Accuracy per fold as a plain mean over predictions."""
    return predictions.groupBy("fold").agg(F.avg((F.col(label) == F.col("pred")).cast("double")).alias("plain"))


def _agrees(metrics, predictions, label="label"):
    """``metrics`` with ``consistent``: their accuracy is that of the predictions."""
    both = metrics.join(_recomputed(predictions, label), "fold")
    return both.withColumn("consistent", F.abs(F.col("accuracy") - F.col("plain")) < 1e-12)


#: What a fold's training rows weigh per class: all of them, balanced over the classes.
SQL_MASS = I.r6("((SELECT count(*) FROM folded) - count(*) OVER (PARTITION BY fold)) / (SELECT count(DISTINCT label) FROM folded)")


@query(
    f"""WITH {I.FEATURES} SELECT label, count(*) AS n,
      {I.r6("(SELECT count(*) FROM features) / (SELECT count(DISTINCT label) FROM features)")} AS weighted_mass,
      TRUE AS at_optimum FROM features GROUP BY label"""
)
def fit_logreg(spark, sf):
    """Per class: rows, their balanced weight in all, and whether the penalised loss has no slope left."""
    rows = _folded(spark, sf)
    pack = learning.fit_logreg(rows)
    slope = learning.logreg_gradient(pack, rows)
    flat = {c: bool(abs(slope[i]).max() < 1e-3) for i, c in enumerate(pack.classes)}
    at_optimum = F.create_map(*[F.lit(x) for item in flat.items() for x in item])[F.col("label")]
    weights = folds.class_weights(rows).select("label", "n", (F.col("weight") * F.col("n")).alias("mass"))
    return weights.select("label", "n", I.rounded("mass", "weighted_mass"), at_optimum.alias("at_optimum"))


SQL_INNER = I.SQL_FOLD.replace("'0:'", "'1:'").replace("% 5", "% 3")


@query(
    f"""WITH {I.FEATURES}, folded AS (SELECT label, {SQL_INNER} AS fold FROM features),
    machines AS (
      SELECT i.fold AS inner_fold, l.label, count(*) FILTER (WHERE f.label = l.label) AS pos,
             count(*) FILTER (WHERE f.label <> l.label) AS neg
      FROM (SELECT DISTINCT fold FROM folded) i, (SELECT DISTINCT label FROM folded) l
      JOIN folded f ON f.fold = i.fold GROUP BY ALL)
    SELECT inner_fold, label, {I.r6("pos * (pos + 1) / (pos + 2) + neg / (neg + 2)")} AS calibrated_mass,
      TRUE AS margin_at_optimum, TRUE AS calibration_at_optimum, TRUE AS converged FROM machines"""
)
def fit_linear_svc_calibrated(spark, sf):
    """Per machine (class and inner fold): what its sigmoid adds up to on the rows it left out, which smoothed targets fix at the
    optimum, and whether the hinge and the sigmoid have no slope left, by plain aggregates over the rows."""
    rows = _folded(spark, sf)
    pack = learning.fit_linear_svc_calibrated(rows)
    slopes = learning.svc_slopes(pack, rows)
    return slopes.select(
        F.col("inner").alias("inner_fold"),
        "label",
        I.rounded("calibrated_mass"),
        (F.col("margin_slope") < 1e-6).alias("margin_at_optimum"),
        (F.col("calibration_slope") < 1e-6).alias("calibration_at_optimum"),
        F.lit(pack.converged).alias("converged"),
    )


@query(
    f"""WITH {I.FEATURES}, folded AS (SELECT post_id, label, {I.SQL_FOLD} AS fold FROM features)
    SELECT post_id, label, fold, TRUE AS known, {SQL_MASS} AS mass FROM folded"""
)
def cross_validate(spark, sf):
    """Every row once, predicted by the model of its own fold, beside what that model gives the row's class over the rows it learned
    from: the balanced rows of the class, if the model is the right one."""
    rows = _folded(spark, sf)
    fits = learning.fit_folds(rows, [K.FEATURE_NAMES])
    known = F.coalesce(F.col("pred").isin(*K.LABELS), F.lit(False)).alias("known")
    scored = learning.fold_predictions(fits, rows, ["pred"])
    masses = learning.training_masses(fits, rows)
    return scored.join(masses, ["fold", "label"]).select("post_id", "label", "fold", known, I.rounded("mass"))


@query(
    f"""WITH {I.FEATURES}, folded AS (SELECT {I.SQL_FOLD} AS fold FROM features)
    SELECT fold, count(*) AS n, TRUE AS consistent, CAST(5 AS INTEGER) AS n_scores, TRUE AS at_optimum FROM folded GROUP BY fold"""
)
def select_and_fit(spark, sf):
    """The choice agrees with the scores of the predictions that are returned with it, and the model it returns has no slope left."""
    rows = _folded(spark, sf)
    result = learning.select_and_fit(rows)
    mean = sum(scores := learning.fold_macro_f1(result.predictions)) / len(scores)
    if isinstance(result.pack, learning.CalibratedSvcPack):
        slopes = learning.svc_slopes(result.pack, rows).agg(F.max("margin_slope"), F.max("calibration_slope")).first()
        at_optimum, named = max(slopes) < 1e-6, result.pack.name == "CalibratedLinearSVC"
    else:
        at_optimum, named = bool(abs(learning.logreg_gradient(result.pack, rows)).max() < 1e-3), result.pack.name == "LogisticRegression"
    agrees = named and abs(mean - result.mean_macro_f1) < 1e-9 and result.std_macro_f1 >= 0
    return result.predictions.groupBy("fold").agg(F.count("*").alias("n")).select(
        "fold", "n", F.lit(agrees).alias("consistent"), F.lit(len(result.fold_scores)).alias("n_scores"), F.lit(at_optimum).alias("at_optimum")
    )


@query(
    f"""WITH {I.FEATURES} SELECT name AS classifier, post_id, TRUE AS same
    FROM features, (VALUES ('LogisticRegression'), ('CalibratedLinearSVC')) AS t(name)"""
)
def save_model(spark, sf):
    """Both classifiers saved, loaded again and applied: the same answers as before."""
    folded = _folded(spark, sf)
    rows = I.features(spark, sf).select("post_id", *K.FEATURE_NAMES)
    parts = []
    for fit in (learning.fit_logreg, learning.fit_linear_svc_calibrated):
        pack, path = fit(folded), scratch_path(spark, "model")
        learning.save_model(pack, path)
        both = learning.with_prediction(learning.load_model(path), learning.with_prediction(pack, rows, "before"), "after")
        parts.append(both.select(F.lit(pack.name).alias("classifier"), "post_id", F.col("before").eqNullSafe(F.col("after")).alias("same")))
    return parts[0].unionByName(parts[1])


@query(
    f"""WITH {I.FEATURES}, folded AS (SELECT label, {I.SQL_FOLD} AS fold FROM features),
    parts AS (SELECT DISTINCT label, fold, {SQL_MASS} AS mass FROM folded)
    SELECT configuration, CAST(n_features AS INTEGER) AS n_features, fold, label, mass, TRUE AS consistent
    FROM parts, (VALUES ('Dsem', 4), ('Dsen', 4), ('Fvt', 4), ('Dsem+Dsen', 5), ('Dsem+Fvt', 5), ('Dsen+Fvt', 5),
      ('Dsem+Dsen+Fvt', 6)) AS t(configuration, n_features)"""
)
def ablation(spark, sf):
    """Per subset, fold and class: what the fold's model gives the class over the rows it learned from (fixed at the optimum), and whether
    the subset's mean accuracy is that of its predictions."""
    rows = _folded(spark, sf)
    subsets = learning.feature_subsets()
    fits = learning.fit_folds(rows, [learning.ablation_columns(s) for s in subsets])
    keys = ["configuration", "n_features"]
    plain = (
        learning.ablation_predictions(rows, fits)
        .groupBy(*keys, "fold")
        .agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("plain"))
        .groupBy(*keys)
        .agg(F.avg("plain").alias("plain"))
    )
    scores = learning.ablation(rows, fits).join(plain, keys)
    consistent = (F.abs(F.col("mean_accuracy") - F.col("plain")) < 1e-9) & F.col("mean_macro_f1").between(0, 1)
    names = F.array(*[F.lit("+".join(s)) for s in subsets])
    masses = learning.training_masses(fits, rows).withColumn("configuration", F.get(names, F.col("model")))
    return masses.join(scores.select(*keys, consistent.alias("consistent")), "configuration").select(
        *keys, "fold", "label", I.rounded("mass"), "consistent"
    )


@query(
    f"""WITH {I.FEATURES}, folded AS (SELECT label, {I.SQL_FOLD} AS fold FROM features)
    SELECT DISTINCT fold, label, count(*) OVER (PARTITION BY fold) AS n_rows, {SQL_MASS} AS mass, TRUE AS consistent FROM folded"""
)
def unimodal_baseline(spark, sf):
    """Per fold and class: rows scored, the class's mass over the training rows, and whether accuracy is that of the predictions."""
    rows = _folded(spark, sf)
    fits = learning.fit_folds(rows, [learning.POLARITY])
    metrics = _agrees(learning.unimodal_baseline(rows), learning.fold_predictions(fits, rows, ["pred"]))
    return learning.training_masses(fits, rows).join(metrics, "fold").select("fold", "label", "n_rows", I.rounded("mass"), "consistent")


SQL_BINARY_FOLD = I.SQL_FOLD.replace("PARTITION BY label", f"PARTITION BY {I.SQL_IRONIC}")
BINARY_RULE = f"{I.FEATURES}, {RULE_STEPS.replace(I.SQL_FOLD, SQL_BINARY_FOLD)}"
#: The mass of class 1 over the training rows of a fold: half of them.
SQL_BINARY_MASS = f"""ironic AS (SELECT {SQL_BINARY_FOLD} AS fold FROM features),
    halves AS (SELECT fold, {I.r6('((SELECT count(*) FROM ironic) - count(*)) / 2')} AS mass FROM ironic GROUP BY fold)"""


def _binary(rows, columns):
    """Metrics per fold, whether they agree with the predictions, and the mass of class 1."""
    folded = learning.binary_folds(rows)
    fit = learning.fit_folds(folded, [columns], "y")[0]
    metrics = _agrees(learning.binary_metrics(folded, fit), learning.fold_predictions([fit], folded, ["pred"]), "y")
    masses = learning.training_masses([fit], folded, "y").filter("y = 1").select("fold", I.rounded("mass"))
    return metrics.join(masses, "fold")


@query(
    f"""WITH {BINARY_RULE}, {SQL_BINARY_MASS} SELECT fold, {I.r6('threshold')} AS threshold, {I.r6('accuracy')} AS dsem_rule_accuracy,
      mass, TRUE AS consistent FROM rule JOIN halves USING (fold)"""
)
def binary_sarcasm(spark, sf):
    return _binary(_folded(spark, sf).drop("fold"), K.DISCREPANCY_SIGNALS).select(
        "fold", I.rounded("threshold"), I.rounded("dsem_rule_accuracy"), "mass", "consistent"
    )


@query(f"WITH {I.FEATURES}, {SQL_BINARY_MASS} SELECT fold, mass, TRUE AS consistent FROM halves")
def unimodal_binary_sarcasm(spark, sf):
    """The binary task on the caption's polarity alone."""
    return _binary(_folded(spark, sf).drop("fold", "Dsem"), learning.POLARITY).select("fold", "mass", "consistent")


# --- streams ----------------------------------------------------------------


def _table_stream(spark, sf, name):
    """A table as it arrives, be it one file or a folder of files; the pattern matches its name only, as a stream's plain path must be a folder."""
    schema = I.table(spark, sf, name).schema
    return jobs.file_stream(spark, f"{sf}/{name}.parque[t]", schema)


#: Files of a stream, in the order in which they arrive, and its first second (a watermark is never before 1970).
ARRIVAL, STREAM_START = (1, 0, 3, 2), 1_000_000_000


def _arriving_posts(spark, sf):
    """A folder of posts that come out of order, a stretch of ``ARRIVAL`` after the other, closed by a heartbeat; the posts' schema, how late
    a row can be in seconds, and the files of a batch.

    A stretch is many files, or few tasks would read it. A batch takes about a stretch, and need not keep to its ends: whatever
    files it takes, no row is later than two stretches.
    """
    folder = scratch_path(spark, "arriving")
    posts = I.grouped_posts(spark, sf).select(
        "ord", "post_id", "caption", "media_ok", "face_ok", F.timestamp_seconds(F.col("ord") + STREAM_START).alias("posted")
    )
    last = posts.agg(F.max("ord")).first()[0] or 0
    span = last // len(ARRIVAL) + 1
    tasks = 2 * spark.sparkContext.defaultParallelism
    for part in ARRIVAL:
        stretch = posts.filter(F.col("ord").between(part * span, (part + 1) * span - 1))
        stretch.repartition(tasks, "ord").write.mode("append").parquet(folder)
    files = len(spark.read.parquet(folder).inputFiles())
    late = F.lit(last + 10 * span).cast("long")
    beat = spark.range(1).select(
        late.alias("ord"),
        F.lit(None).cast("string").alias("post_id"),
        F.lit("").alias("caption"),
        F.lit(True).alias("media_ok"),
        F.lit(True).alias("face_ok"),
        F.timestamp_seconds(late + STREAM_START).alias("posted"),
    )
    beat.coalesce(1).write.mode("append").parquet(folder)
    return folder, posts.schema, 2 * span, -(-files // len(ARRIVAL))


GATES = {"feed": G.FEED, "local": G.LOCAL, "embed": G.EMBED}


@query(" UNION ALL ".join(f"(WITH {admitted_sql(rules)} SELECT '{name}' AS gate, ord, post_id, caption FROM admitted)" for name, rules in GATES.items()))
def stream_ingest(spark, sf):
    """The three gates over files that come out of order; the watermark trails by what that takes. The same posts as from the batch gates."""
    folder, schema, lateness, files = _arriving_posts(spark, sf)
    parts = []
    for name, rules in GATES.items():
        posts = jobs.file_stream(spark, folder, schema, maxFilesPerTrigger=files)
        accepted = admission.stream_ingest(
            posts,
            rules,
            I.seen_posts(spark, sf),
            event_time="posted",
            lateness=f"{lateness} seconds",
            media_ok=F.col("media_ok"),
            face_ok=F.col("face_ok"),
        )
        out = scratch_path(spark, f"ingested-{name}")
        jobs.append_to_parquet(accepted, out, f"{out}-checkpoint").awaitTermination()
        parts.append(spark.read.parquet(out).select(F.lit(name).alias("gate"), "ord", "post_id", "caption"))
    return reduce(DataFrame.unionByName, parts)


@query("SELECT CAST(label AS VARCHAR) AS label, count(*) AS n FROM embeddings GROUP BY label")
def stream_upsert(spark, sf):
    rows = _table_stream(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("post_id"),
        F.col("label").cast("string").alias("label"),
        *[F.col("embedding").alias(c) for c in K.VECTOR_ROW_FIELDS[2:]],
    )
    path = scratch_path(spark, "streamed")
    for attempt in ("first", "replayed"):
        jobs.stream_upsert(rows, path, scratch_path(spark, attempt)).awaitTermination()
    return S.fetch_vectors(spark, path).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {PREDICTED} SELECT post_id, label, {I.r6('confidence')} AS confidence, low_fidelity FROM predicted")
def stream_predict(spark, sf):
    """Features stored as files, streamed through the prediction rules."""
    folder, out = scratch_path(spark, "arriving"), scratch_path(spark, "predicted")
    I.features(spark, sf).write.parquet(folder)
    stream = jobs.file_stream(spark, folder, spark.read.parquet(folder).schema)
    jobs.append_to_parquet(jobs.stream_predict(stream), out, f"{out}-checkpoint").awaitTermination()
    done = spark.read.parquet(out)
    return done.select(
        "post_id",
        F.col("prediction.label").alias("label"),
        I.rounded(F.col("prediction.confidence"), "confidence"),
        F.col("prediction.low_fidelity").alias("low_fidelity"),
    )


@query(
    f"""WITH {I.AUDIT} SELECT coalesce(annotator_id, '_unknown_') AS annotator_id, count(*) AS n FROM audit
    WHERE label IN ({I.SQL_LABELS}) GROUP BY 1"""
)
def stream_agreement(spark, sf):
    """Running counts over the log as it arrives; the newest value per annotator."""
    kind, user = F.col("event_type"), F.col("user_id")
    label = F.when(kind == "error", F.when(F.col("value") > 60, "unsure").otherwise("negative")).otherwise("neutral")
    log = _table_stream(spark, sf, "events").select(
        label.alias("label"), F.when(user % 9 != 0, F.concat(F.lit("u"), user.cast("string"))).alias("annotator_id")
    )
    out = scratch_path(spark, "counts")
    jobs.update_table(jobs.stream_agreement(log), out, f"{out}-checkpoint").awaitTermination()
    return jobs.latest_counts(spark.read.parquet(out))
