from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tonegap.functions import html as H
from tonegap.functions import text as T


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("علي كتاب", "علی کتاب"),
        ("٠١٢ و ۳۴۵", "012 و 345"),
        ("see https://x.y/z?a=1 now", "see now"),
        ("hi @user_1, mail a@b.c", "hi , mail a@b.c"),
        ("a \n\t b c", "a b c"),
        ("آب", "آب"),
        ("é", "é"),
        ("", ""),
        ("WWW.Example.org", ""),
        ("@a@b @@c", "@b @"),
    ],
)
def test_preprocess(one, raw, clean):
    assert one(T.preprocess_caption(F.lit(raw))) == clean


@pytest.mark.parametrize(
    "text, ratio", [("کتاب نو", 1.0), ("plain text? 🐌", 0.0), ("2048 %", 0.0), ("", 0.0), ("برف is cold", 3 / 9)]
)
def test_script_ratio(one, text, ratio):
    assert one(T.script_ratio(F.lit(text))) == pytest.approx(ratio)


def test_spam(one):
    assert one(T.is_spam_caption(F.lit("برای دریافت پرامپت کامنت کن #AIart")))
    assert one(T.is_spam_caption(F.lit("PROMPT below")))
    assert not one(T.is_spam_caption(F.lit("یک روز خوب با دوستان")))
    assert not one(T.is_spam_caption(F.lit("")))
    assert one(T.is_spam_caption(F.lit("الف " * 120 + "نورپردازی")))
    assert not one(T.is_spam_caption(F.lit("نورپردازی")))


@pytest.mark.parametrize(
    "text, hit",
    [
        ("امروز خیلی ناراحتم 😂", True),
        ("عالی بود ولی خسته شدم", True),
        ("یک روز معمولی در خانه", False),
        ("این یک طنز است", True),
        ("sad", False),
        ("this is ſARCASM here", True),
        ('he said "a" "b" today', True),
        ("happy and great but fine", True),
        ("زندگی خوب است 😭 love", True),
    ],
)
def test_sarcasm_candidates(one, text, hit):
    assert one(T.is_sarcasm_candidate(F.lit(text))) is hit


def test_weak_labels(one):
    assert one(T.keyword_weak_label(F.lit("خیلی شاد و عالی"))) == "positive"
    assert one(T.keyword_weak_label(F.lit("اشک و غم"))) == "negative"
    assert one(T.keyword_weak_label(F.lit("شاد ولی غم"))) == "neutral"


@pytest.mark.parametrize(
    "line, code, kind",
    [
        ("https://www.instagram.com/reel/ABC_12-x/?a=1", "ABC_12-x", "reel"),
        ("https://www.instagram.com/p/ABCDE/", "ABCDE", "p"),
        ("ABCDE12", "ABCDE12", "p"),
        ("# https://www.instagram.com/p/ABCDE/", None, "p"),
        ("abc", None, "p"),
        ("not a code", None, "p"),
    ],
)
def test_post_ref(one, line, code, kind):
    ref = one(H.post_ref(F.lit(line)))
    assert ref["shortcode"] == code
    if code:
        assert ref["kind"] == kind


@pytest.mark.parametrize(
    "desc, caption",
    [
        ('12 likes, 3 comments - x on May 1: "سلام &amp; دنیا" ', "سلام & دنیا"),
        ("12 likes: 'plain'", "plain"),
        ("no colon here", "no colon here"),
        ('a: "multi\nline"', "multi\nline"),
        ("", ""),
    ],
)
def test_caption_from_og(one, desc, caption):
    assert one(H.caption_from_og(F.lit(desc))) == caption


def test_caption_from_html(one):
    page = '<span class="Caption" x>a <b>b</b>&amp;c</span><meta property="og:description" content="k: &quot;no&quot;">'
    assert one(H.caption_from_html(F.lit(page))) == "a  b &c"
    assert one(H.caption_from_html(F.lit(page[page.index("<meta") :]))) == "no"


def test_image_choice(spark):
    base = "https://a.scontent.b/"
    page = f'"{base}s150x150/aaaaaaaaaaaaaaaaaa.jpg" "{base}one.jpg?x=1&amp;y=2" "{base}two.jpg?x=1&amp;y=2"'
    rows = spark.createDataFrame([(1, page), (2, f'"{base}s150x150/a.jpg"'), (3, "none")], "id int, html string")
    got = {r["id"]: r["image_url"] for r in H.with_image_url(rows).collect()}
    assert got == {1: f"{base}one.jpg?x=1&y=2", 2: f"{base}s150x150/a.jpg", 3: None}


def test_required_image_fails(spark):
    with pytest.raises(Exception, match="no media"):
        spark.range(1).select(H.require_image_url(F.lit(None).cast("string"))).collect()


def test_embedded_json(one):
    page = (
        '<script type="application/json">{"a":[{"text":"long enough text","__typename":"Other"},'
        '{"edge_media_to_caption":{"edges":[{"node":{"text":"found"}}]}}]}</script>'
    )
    assert one(H.caption_from_embedded_json(F.lit(page))) == "found"
    assert one(H.caption_from_embedded_json(F.lit("<p>nothing</p>"))) == ""


@pytest.mark.parametrize(
    "body, caption",
    [
        ('{"x": ' * 60 + '{"caption": {"text": "deep down"}}' + "}" * 60, "deep down"),
        ('[{"caption": {"text": "abc"}}, {"y": {"text": "a remark worth it", "__typename": "GraphComment"}}]', "a remark worth it"),
        ('{"edge_media_to_caption": {"edges": []}, "z": [1, null, {"caption": {"text": "second"}}]}', "second"),
        ('{"caption": {"text": 12345}, "text": "long enough text", "__typename": "Photo"}', ""),
        ("null", ""),
        ("[" * 100_000, ""),
    ],
)
def test_embedded_json_shapes(one, body, caption):
    page = f'<script type="application/json">{body}</script>'
    assert one(H.caption_from_embedded_json(F.lit(page))) == caption


def test_generated_text(one):
    assert one(T.clean_generated_text(F.lit("User: x Assistant: a cat "))) == "a cat"
    assert one(T.clean_generated_text(F.lit("  "))) == "."
    assert one(T.polarity_phrase(F.lit(None).cast("double"))) == "ambiguous"
