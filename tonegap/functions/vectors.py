"""Vector and probability functions over array columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegap import constants as K

_MAX_DOUBLE = 1.7976931348623157e308


def _fail(message: str) -> Column:
    return F.raise_error(F.lit(message))


def finite_or_zero(x: Column) -> Column:
    """NaN, infinities and nulls become 0.0 (NaN sorts above every number in Spark)."""
    x = x.cast("double")
    return F.when(x.between(-_MAX_DOUBLE, _MAX_DOUBLE), x).otherwise(F.lit(0.0))


def sanitize_vector(v: Column) -> Column:
    return F.when(F.size(v) > 0, F.transform(v, finite_or_zero)).otherwise(
        _fail("vector without components").cast("array<double>")
    )


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def norm(v: Column) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return F.when(n <= _MAX_DOUBLE, n).otherwise(F.lit(0.0))


def _cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    same_size = F.size(a) == F.size(b)
    value = dot(a, b) / (norm_a * norm_b)
    return (
        F.when(~same_size, _fail("vectors differ in length").cast("double"))
        .when((norm_a == 0.0) | (norm_b == 0.0), F.lit(0.0))
        .otherwise(finite_or_zero(value))
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    a, b = sanitize_vector(a), sanitize_vector(b)
    return _cosine(a, b, norm(a), norm(b))


def _distance(similarity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - similarity))


def cosine_distance(a: Column, b: Column) -> Column:
    return _distance(cosine_similarity(a, b))


def polarity_scalar(p: Column) -> Column:
    p = sanitize_vector(p)
    return F.when(F.size(p) >= 2, F.get(p, F.lit(1)) - F.get(p, F.lit(0))).otherwise(
        _fail("polarity needs two entries (neg, pos)").cast("double")
    )


def polarity_l1(a: Column, b: Column) -> Column:
    a, b = sanitize_vector(a), sanitize_vector(b)
    return F.when(
        F.size(a) == F.size(b), total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    ).otherwise(_fail("polarities differ in length").cast("double"))


def dsem(text: Column, text_hat: Column) -> Column:
    """Semantic gap between the caption and the description of its image."""
    return cosine_distance(text, text_hat)


def dsen(polarity: Column, polarity_hat: Column) -> Column:
    """Sentiment gap between the caption and the description."""
    return polarity_l1(polarity, polarity_hat)


def fvt(image: Column, text_hat: Column) -> Column:
    """How faithful the description is to the image."""
    return cosine_similarity(image, text_hat)


def with_features(
    df: DataFrame,
    text: str = "emb_T",
    text_hat: str = "emb_T_hat",
    image: str = "emb_I",
    polarity: str = "pol_T",
    polarity_hat: str = "pol_T_hat",
) -> DataFrame:
    """Append the six discrepancy columns.

    Cleaned vectors and their norms live in projections of their own, so each is computed
    once per row although every vector takes part in two similarities.
    """
    vectors = {text: "_t", text_hat: "_h", image: "_i"}
    clean = df.withColumns({alias: sanitize_vector(F.col(c)) for c, alias in vectors.items()})
    normed = clean.withColumns({f"{a}n": norm(F.col(a)) for a in vectors.values()})
    pair = lambda a, b: _cosine(
        F.col(a), F.col(b), F.col(f"{a}n"), F.col(f"{b}n")
    )
    out = normed.withColumns(
        {
            "Dsem": _distance(pair("_t", "_h")),
            "Dsen": polarity_l1(F.col(polarity), F.col(polarity_hat)),
            "Fvt": pair("_i", "_h"),
            "cos_TI": pair("_t", "_i"),
            "polarity_T": polarity_scalar(F.col(polarity)),
            "polarity_T_hat": polarity_scalar(F.col(polarity_hat)),
        }
    )
    return out.drop("_t", "_h", "_i", "_tn", "_hn", "_in")


def features_as_array(columns: tuple[str, ...] = K.FEATURE_NAMES) -> Column:
    """Feature columns in canonical order, single precision, non-finite values as 0."""
    return F.array(*[finite_or_zero(F.col(c)).cast("float") for c in columns])


def l2_normalize(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(1e-8))
    return F.transform(v, lambda x: x.cast("double") / n)


def softmax(logits: Column) -> Column:
    peak = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x.cast("double") - peak))
    return F.transform(powers, lambda x: x / total(powers))


def renormalize_probs(p: Column) -> Column:
    """Sanitised and scaled to sum 1; an all-zero distribution becomes even."""
    clean = F.transform(p, finite_or_zero)
    mass = total(clean)
    return F.when(mass > 0.0, F.transform(clean, lambda x: x / mass)).otherwise(
        F.array(F.lit(0.5), F.lit(0.5))
    )


def _first_class(id2label: Column, names: tuple[str, ...]) -> Column:
    """Lowest class id whose upper-cased name is in ``names``, null when none is."""
    ids = F.map_keys(
        F.map_filter(id2label, lambda _, name: F.upper(name).isin(*names))
    )
    return F.array_min(ids)


def canonicalize_polarity(p: Column, id2label: Column) -> Column:
    """(p_neg, p_pos) by class name; without usable names the first two entries as they are."""
    neg = _first_class(id2label, K.POLARITY_NEG_NAMES)
    pos = _first_class(id2label, K.POLARITY_POS_NAMES)
    named = F.array(F.get(p, neg), F.get(p, pos))
    return (
        F.when(F.size(p) < 2, _fail("polarity needs two entries").cast("array<double>"))
        .when(neg.isNotNull() & pos.isNotNull() & (neg != pos), named)
        .otherwise(F.slice(p, 1, 2))
    )


def argmax_first(p: Column) -> Column:
    """0-based position of the maximum, the first one on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def align_proba(classes: Column, proba: Column, labels: tuple[str, ...] = K.LABELS) -> Column:
    """Probabilities in canonical label order; a class the model never saw gets 0.0."""
    slots = [
        F.coalesce(
            F.get(proba, F.nullif(F.array_position(classes, label), F.lit(0)).cast("int") - 1),
            F.lit(0.0),
        )
        for label in labels
    ]
    return F.array(*slots)


def weak_label_from_probs(p: Column, id2label: Column) -> Column:
    """Weak label by the name of the strongest class, else by its index on a 5-point scale."""
    idx = argmax_first(p)
    name = F.upper(F.coalesce(F.element_at(id2label, idx), idx.cast("string")))
    positive = name.isin(*K.WEAK_POSITIVE_NAMES, "1") | name.contains("POS")
    negative = name.isin(*K.WEAK_NEGATIVE_NAMES)
    for part in K.WEAK_NEGATIVE_PARTS:
        negative = negative | name.contains(part)
    return (
        F.when(positive, "positive")
        .when(negative, "negative")
        .when(name.isin(*K.WEAK_NEUTRAL_NAMES), "neutral")
        .when(idx == 0, "negative")
        .when(idx >= 3, "positive")
        .otherwise("neutral")
    )


def keyword_polarity(pos: Column, neg: Column) -> Column:
    """(p_neg, p_pos) from keyword counts with add-one smoothing."""
    total_hits = (pos + neg + 2).cast("double")
    return F.array((neg + 1) / total_hits, (pos + 1) / total_hits)


def masked_mean_pool(
    df: DataFrame,
    keys: list[str],
    dim: str = "dim",
    value: str = "value",
    mask: str = "mask",
) -> DataFrame:
    """Mean over unmasked tokens per (key, dimension) of a long token table; 0 where all are masked."""
    mean = F.try_divide(F.sum(F.col(value) * F.col(mask)), F.sum(F.col(mask)))
    return df.groupBy(*keys, dim).agg(F.coalesce(mean, F.lit(0.0)).alias("pooled"))


def embedding_health(df: DataFrame, vector: str) -> DataFrame:
    """One row that tells whether a set of probe vectors is usable."""
    v = F.col(vector)
    broken = F.exists(v, lambda x: ~x.cast("double").between(-_MAX_DOUBLE, _MAX_DOUBLE))
    size = F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x)))
    counted = df.select(
        broken.alias("broken"), (size == 0.0).alias("zero"), F.xxhash64(v).alias("digest")
    ).agg(
        F.count("*").alias("n"),
        F.count_if("broken").alias("n_not_finite"),
        F.count_if("zero").alias("n_zero"),
        (F.min("digest") == F.max("digest")).alias("same"),
    )
    identical = F.coalesce(F.col("same") & (F.col("n") > 1), F.lit(False))
    usable = (F.col("n_not_finite") == 0) & (F.col("n_zero") == 0) & ~identical
    return counted.select(
        "n", "n_not_finite", "n_zero", identical.alias("all_identical"), usable.alias("usable")
    )
