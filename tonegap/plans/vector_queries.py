"""Queries for vectors, probabilities and discrepancy features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.functions import vectors as V
from tonegap.plans import inputs as I
from tonegap.plans.registry import query

T, H, IMG = "emb_T", "emb_T_hat", "emb_I"


def _from(source: str, expr: str) -> str:
    ctes = I.VECTORS if source == "vectors" else I.FEATURES
    return f"WITH {ctes} SELECT post_id, {expr} FROM {source}"


SQL_DIRTY = """dirty AS (
  SELECT vec_id, p, CASE WHEN p % 17 = 0 THEN 0 WHEN p % 19 = 0 THEN 0 ELSE CAST(v AS DOUBLE) END AS x FROM (
    SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"""


@query(f"WITH {SQL_DIRTY} SELECT vec_id, {I.r6('sum(x)')} AS total, count(*) AS n FROM dirty GROUP BY vec_id")
def sanitize_vector(spark, sf):
    spoiled = F.transform(
        "embedding",
        lambda x, p: F.when(p % 17 == 0, F.lit(float("nan")))
        .when(p % 19 == 0, F.lit(float("-inf")))
        .otherwise(x.cast("double")),
    )
    clean = V.sanitize_vector(spoiled)
    return I.table(spark, sf, "embeddings").select(
        "vec_id", I.rounded(V.total(clean), "total"), F.size(clean).cast("long").alias("n")
    )


@query(_from("vectors", f"{I.r6('list_cosine_similarity(t, i)')} AS similarity"))
def cosine_similarity(spark, sf):
    return I.stage_vectors(spark, sf).select("post_id", I.rounded(V.cosine_similarity(F.col(T), F.col(IMG)), "similarity"))


@query(_from("features", f"{I.r6('Dsem')} AS distance"))
def cosine_distance(spark, sf):
    return I.stage_vectors(spark, sf).select("post_id", I.rounded(V.cosine_distance(F.col(T), F.col(H)), "distance"))


@query(_from("features", f"{I.r6('polarity_T')} AS polarity"))
def polarity_scalar(spark, sf):
    return I.stage_vectors(spark, sf).select("post_id", I.rounded(V.polarity_scalar(F.col("pol_T")), "polarity"))


@query(_from("features", f"{I.r6('Dsen')} AS distance"))
def polarity_l1(spark, sf):
    gap = V.polarity_l1(F.col("pol_T"), F.col("pol_T_hat"))
    return I.stage_vectors(spark, sf).select("post_id", I.rounded(gap, "distance"))


@query(_from("features", f"{I.r6('Dsem')} AS dsem"))
def dsem(spark, sf):
    return I.stage_vectors(spark, sf).select("post_id", I.rounded(V.dsem(F.col(T), F.col(H)), "dsem"))


@query(_from("features", f"{I.r6('Dsen')} AS dsen"))
def dsen(spark, sf):
    gap = V.dsen(F.col("pol_T"), F.col("pol_T_hat"))
    return I.stage_vectors(spark, sf).select("post_id", I.rounded(gap, "dsen"))


@query(_from("features", f"{I.r6('Fvt')} AS fvt"))
def fvt(spark, sf):
    return I.stage_vectors(spark, sf).select("post_id", I.rounded(V.fvt(F.col(IMG), F.col(H)), "fvt"))


SQL_SIX = ", ".join(f"{I.r6(c)} AS {c}" for c in K.FEATURE_NAMES)


@query(_from("features", f"label, {SQL_SIX}"))
def build_features(spark, sf):
    return I.features(spark, sf).select("post_id", "label", *[I.rounded(c) for c in K.FEATURE_NAMES])


@query(
    _from("features", f"{I.r6(' + '.join(f'CAST(CAST({c} AS FLOAT) AS DOUBLE)' for c in K.FEATURE_NAMES))} AS total, 6 AS n")
)
def features_as_array(spark, sf):
    row = V.features_as_array()
    return I.features(spark, sf).select("post_id", row.alias("x")).select(
        "post_id",
        I.rounded(V.total(F.transform("x", lambda v: v.cast("double"))), "total"),
        F.size("x").alias("n"),
    )


@query(
    f"""WITH long AS (
      SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS value,
             CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS mask FROM embeddings)
    SELECT label, CAST(dim AS INTEGER) AS dim, {I.r6('sum(value * mask) / sum(mask)')} AS pooled
    FROM long GROUP BY label, dim"""
)
def masked_mean_pool(spark, sf):
    """Vectors of one label as the tokens of one text, every third one masked out."""
    long = I.table(spark, sf, "embeddings").select(
        "label",
        F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1).alias("mask"),
        F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("dim", "value"),
    )
    return V.masked_mean_pool(long, ["label"]).select("label", "dim", I.rounded("pooled"))


@query(
    f"""WITH {I.VECTORS}, unit AS (
      SELECT post_id, list_transform(t, lambda x: x / greatest(sqrt(list_inner_product(t, t)), 1e-8)) AS u FROM vectors)
    SELECT post_id, {I.r6('list_sum(u)')} AS total, {I.r6('list_inner_product(u, u)')} AS squares FROM unit"""
)
def l2_normalize(spark, sf):
    unit = I.stage_vectors(spark, sf).select("post_id", V.l2_normalize(F.col(T)).alias("u"))
    return unit.select(
        "post_id",
        I.rounded(V.total(F.col("u")), "total"),
        I.rounded(V.dot(F.col("u"), F.col("u")), "squares"),
    )


@query(_from("vectors", ", ".join(f"{I.r6(f'proba[{i + 1}]')} AS p{i}" for i in range(5))))
def softmax(spark, sf):
    return I.stage_vectors(spark, sf).select(
        "post_id", *[I.rounded(F.get("proba", F.lit(i)), f"p{i}") for i in range(5)]
    )


@query(
    f"""WITH mass AS (
      SELECT vec_id, greatest(embedding[1], 0)::DOUBLE AS a, greatest(embedding[2], 0)::DOUBLE AS b FROM embeddings)
    SELECT vec_id, {I.r6('CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.5 END')} AS p_neg,
           {I.r6('CASE WHEN a + b > 0 THEN b / (a + b) ELSE 0.5 END')} AS p_pos FROM mass"""
)
def renormalize_probs(spark, sf):
    raw = F.transform(F.slice("embedding", 1, 2), lambda x: F.when(x > 0, x.cast("double")).otherwise(F.lit(float("nan"))))
    p = V.renormalize_probs(raw)
    return I.table(spark, sf, "embeddings").select("vec_id", p.alias("p")).select(
        "vec_id", I.rounded(F.get("p", F.lit(0)), "p_neg"), I.rounded(F.get("p", F.lit(1)), "p_pos")
    )


def _names(*pairs):
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


@query(
    f"""WITH {I.VECTORS} SELECT post_id,
      {I.r6("CASE vec_id % 3 WHEN 0 THEN proba[2] ELSE proba[1] END")} AS p_neg,
      {I.r6("CASE vec_id % 3 WHEN 0 THEN proba[1] WHEN 1 THEN proba[3] ELSE proba[2] END")} AS p_pos
    FROM vectors"""
)
def canonicalize_polarity(spark, sf):
    """Class names in reverse order, with a neutral class between, and without meaning."""
    kind = F.col("post_id").cast("long") % 3
    names = (
        F.when(kind == 0, _names((0, "happy"), (1, "SAD"), (2, "x")))
        .when(kind == 1, _names((0, "Negative"), (1, "neutral"), (2, "Positive")))
        .otherwise(_names((0, "LABEL_0"), (1, "LABEL_1"), (2, "LABEL_2")))
    )
    p = V.canonicalize_polarity(F.col("proba"), names)
    return I.stage_vectors(spark, sf).select("post_id", p.alias("p")).select(
        "post_id", I.rounded(F.get("p", F.lit(0)), "p_neg"), I.rounded(F.get("p", F.lit(1)), "p_pos")
    )


@query(_from("vectors", "CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS idx"))
def argmax_first(spark, sf):
    return I.stage_vectors(spark, sf).select("post_id", V.argmax_first(F.col("proba")).alias("idx"))


@query(
    _from(
        "vectors",
        f"{I.r6('proba[3]')} AS positive, {I.r6('proba[1]')} AS negative, {I.r6('proba[2]')} AS neutral,"
        f" {I.r6('0')} AS positive_sarcasm, {I.r6('0')} AS negative_sarcasm",
    )
)
def align_proba(spark, sf):
    """A model that knows three classes, in an order of its own."""
    classes = F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive"))
    p = V.align_proba(classes, F.slice("proba", 1, 3))
    return I.stage_vectors(spark, sf).select("post_id", p.alias("p")).select(
        "post_id", *[I.rounded(F.get("p", F.lit(i)), name) for i, name in enumerate(K.LABELS)]
    )


@query(
    """WITH probes AS (
      SELECT label, embedding, list_inner_product(embedding, embedding) AS n2 FROM embeddings)
    SELECT label, count(*) AS n, CAST(0 AS BIGINT) AS n_not_finite,
           count(*) FILTER (WHERE n2 = 0) AS n_zero,
           count(*) > 1 AND count(DISTINCT embedding) = 1 AS all_identical,
           count(*) FILTER (WHERE n2 = 0) = 0 AND NOT (count(*) > 1 AND count(DISTINCT embedding) = 1) AS usable
    FROM (SELECT 0 AS label, embedding, n2 FROM probes) GROUP BY label"""
)
def embedding_health(spark, sf):
    return V.embedding_health(I.table(spark, sf, "embeddings"), "embedding").select(F.lit(0).alias("label"), "*")


NAME_SETS = (
    ("DELIGHT", "ANGRY", "neutral", "other", "1"),
    ("very_neg", "0", "2", "3", "POSITIVE"),
    ("a", "b", "c", "d", "e"),
)
SQL_WEAK = """CASE WHEN name IN ('DELIGHT', 'HAPPY', 'POSITIVE', '1') OR contains(name, 'POS') THEN 'positive'
  WHEN name IN ('SAD', 'ANGRY', 'NEGATIVE') OR contains(name, 'NEG') OR contains(name, 'ANGR') OR contains(name, 'SAD')
    THEN 'negative'
  WHEN name = 'NEUTRAL' THEN 'neutral' WHEN idx = 0 THEN 'negative' WHEN idx >= 3 THEN 'positive' ELSE 'neutral' END"""
SQL_NAME_SETS = "[" + ", ".join(I.sql_list(s) for s in NAME_SETS) + "]"


@query(
    f"""WITH {I.VECTORS}, named AS (
      SELECT post_id, idx, upper(list_extract(list_extract({SQL_NAME_SETS}, CAST(vec_id % 3 + 1 AS INTEGER)), idx + 1)) AS name
      FROM (SELECT *, CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS idx FROM vectors))
    SELECT post_id, {SQL_WEAK} AS label FROM named"""
)
def weak_label_from_probs(spark, sf):
    kind = F.col("post_id").cast("long") % 3
    maps = [_names(*enumerate(names)) for names in NAME_SETS]
    names = F.when(kind == 0, maps[0]).when(kind == 1, maps[1]).otherwise(maps[2])
    return I.stage_vectors(spark, sf).select(
        "post_id", V.weak_label_from_probs(F.col("proba"), names).alias("label")
    )
