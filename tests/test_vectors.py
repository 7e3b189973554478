from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.functions import vectors as V

NAN = float("nan")


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


@pytest.mark.parametrize(
    "a, b, value",
    [
        ((4, 4, 7), (8, 8, 14), 1.0),
        ((3, -6), (2, 1), 0.0),
        ((5, 12), (-10, -24), -1.0),
        ((0, 0), (1, 2), 0.0),
        ((NAN, NAN), (1, 2), 0.0),
        ((math.inf, 1), (5, 2), 2 / math.sqrt(29)),
    ],
)
def test_cosine(one, a, b, value):
    assert one(V.cosine_similarity(arr(*a), arr(*b))) == pytest.approx(value)


@pytest.mark.parametrize("a, b", [((1, 2), (1, 2, 3)), ((), (1,))])
def test_cosine_errors(one, a, b):
    left = arr(*a) if a else F.array().cast("array<double>")
    with pytest.raises(Exception, match="vector"):
        one(V.cosine_similarity(left, arr(*b)))


def test_polarity(one):
    assert one(V.polarity_l1(arr(0.25, 0.75), arr(0.9, 0.1))) == pytest.approx(1.3)
    assert one(V.polarity_scalar(arr(0.75, 0.25))) == pytest.approx(-0.5)
    with pytest.raises(Exception, match="polarity"):
        one(V.polarity_scalar(arr(1)))


def test_canonical_polarity(one):
    names = F.create_map(F.lit(0), F.lit("HAPPY"), F.lit(1), F.lit("SAD"))
    assert one(V.canonicalize_polarity(arr(0.1, 0.9), names)) == [0.9, 0.1]
    unnamed = F.create_map(F.lit(0), F.lit("a"), F.lit(1), F.lit("b"))
    assert one(V.canonicalize_polarity(arr(0.1, 0.9), unnamed)) == [0.1, 0.9]


def test_probabilities(one):
    assert one(V.renormalize_probs(arr(0, NAN))) == [0.5, 0.5]
    assert sum(one(V.softmax(arr(1, 2, 1000)))) == pytest.approx(1.0)
    assert one(V.argmax_first(arr(1, 3, 3))) == 1
    classes = F.array(F.lit("positive"), F.lit("negative"))
    assert one(V.align_proba(classes, arr(0.4, 0.6))) == [0.4, 0.6, 0, 0, 0]


def test_feature_signature(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [-1.0, 0.0], [-1.0, 0.0], [0.2, 0.8], [0.65, 0.35])],
        "emb_T array<float>, emb_T_hat array<float>, emb_I array<float>, pol_T array<double>, pol_T_hat array<double>",
    )
    f = V.with_features(rows).select(*K.FEATURE_NAMES).first()
    assert f["Dsem"] == pytest.approx(2.0) and f["Dsen"] == pytest.approx(0.9)
    assert f["Fvt"] == pytest.approx(1.0) and f["cos_TI"] == pytest.approx(-1.0)
    assert f["polarity_T"] == pytest.approx(0.6) and f["polarity_T_hat"] == pytest.approx(-0.3)


def test_embedding_health(spark):
    good = spark.createDataFrame([([1.0, 2.0],), ([2.0, 1.0],)], "v array<double>")
    same = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0],)], "v array<double>")
    zero = spark.createDataFrame([([0.0, 0.0],), ([2.0, 1.0],)], "v array<double>")
    broken = spark.createDataFrame([([NAN, 0.0],), ([2.0, 1.0],)], "v array<double>")
    verdicts = [V.embedding_health(df, "v").first()["usable"] for df in (good, same, zero, broken)]
    assert verdicts == [True, False, False, False]


def test_weak_label_from_probs(one):
    names = F.create_map(F.lit(0), F.lit("x"), F.lit(1), F.lit("y"))
    assert one(V.weak_label_from_probs(arr(0.1, 0.9), names)) == "neutral"
    unnamed = F.create_map(F.lit(9), F.lit("z"))
    assert one(V.weak_label_from_probs(arr(0.1, 0.9), unnamed)) == "positive"  # class named "1"
    assert one(V.weak_label_from_probs(arr(0.9, 0.1), unnamed)) == "negative"


def test_masked_mean_without_tokens(spark):
    rows = spark.createDataFrame([("a", 0, 2.0, 1), ("a", 0, 4.0, 1), ("a", 0, 9.0, 0), ("b", 0, 5.0, 0)], "id string, dim int, value double, mask int")
    assert {r["id"]: r["pooled"] for r in V.masked_mean_pool(rows, ["id"]).collect()} == {"a": 3.0, "b": 0.0}
