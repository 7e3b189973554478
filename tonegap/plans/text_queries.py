"""Queries for the text and page functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.functions import html as H
from tonegap.functions import text as T
from tonegap.plans import inputs as I
from tonegap.plans.registry import query


def _text_sql(expr: str, source: str = "captions", ctes: str = I.CAPTIONS) -> str:
    return f"WITH {ctes} SELECT post_id, {expr} FROM {source}"


@query(_text_sql("nfc_normalize(caption) AS text"))
def nfc(spark, sf):
    return I.captions(spark, sf).select("post_id", T.nfc(F.col("caption")).alias("text"))


@query(_text_sql(f"{I.sql_normalize('caption')} AS text"))
def normalize_persian(spark, sf):
    return I.captions(spark, sf).select("post_id", T.normalize_persian(F.col("caption")).alias("text"))


@query(_text_sql(f"{I.sql_strip_urls('caption')} AS text"))
def strip_urls(spark, sf):
    return I.captions(spark, sf).select("post_id", T.strip_urls(F.col("caption")).alias("text"))


@query(_text_sql(f"{I.sql_strip_mentions('caption')} AS text"))
def strip_mentions(spark, sf):
    return I.captions(spark, sf).select("post_id", T.strip_mentions(F.col("caption")).alias("text"))


@query(_text_sql(f"{I.sql_collapse('caption')} AS text"))
def collapse_ws(spark, sf):
    return I.captions(spark, sf).select("post_id", T.collapse_ws(F.col("caption")).alias("text"))


@query(_text_sql("caption AS text", "clean", I.CLEAN))
def preprocess_caption(spark, sf):
    return I.captions(spark, sf).select("post_id", T.preprocess_caption(F.col("caption")).alias("text"))


@query(_text_sql(f"{I.r6(I.sql_ratio('caption'))} AS ratio"))
def script_ratio(spark, sf):
    return I.captions(spark, sf).select("post_id", I.rounded(T.script_ratio(F.col("caption")), "ratio"))


@query(_text_sql(f"{I.sql_ratio('caption')} >= 0.5 AS enough"))
def is_script_enough(spark, sf):
    return I.captions(spark, sf).select("post_id", T.is_script_enough(F.col("caption")).alias("enough"))


@query(_text_sql(f"{I.sql_spam('caption')} AS spam"))
def is_spam_caption(spark, sf):
    return I.captions(spark, sf).select("post_id", T.is_spam_caption(F.col("caption")).alias("spam"))


@query(_text_sql(f"{I.sql_sarcasm('caption')} AS candidate", "clean", I.CLEAN))
def is_sarcasm_candidate(spark, sf):
    return I.captions(spark, sf).select(
        "post_id", T.is_sarcasm_candidate(F.col("caption")).alias("candidate")
    )


_POS, _NEG = I.sql_keyword_counts("caption")
SQL_KEYWORD_LABEL = (
    f"CASE WHEN {_POS} > {_NEG} THEN 'positive' WHEN {_NEG} > {_POS} THEN 'negative' ELSE 'neutral' END"
)


@query(_text_sql(f"{_POS} AS pos, {_NEG} AS neg, {SQL_KEYWORD_LABEL} AS label"))
def keyword_weak_label(spark, sf):
    pos, neg = T.keyword_counts(F.col("caption"))
    return I.captions(spark, sf).select(
        "post_id", pos.alias("pos"), neg.alias("neg"), T.keyword_weak_label(F.col("caption")).alias("label")
    )


SQL_SHORTCODE = f"""CASE WHEN NOT starts_with(t, '#') THEN coalesce(
  nullif(regexp_extract(t, '{K.SHORTCODE_PATTERN}', 1), ''),
  CASE WHEN regexp_matches(t, '{K.BARE_SHORTCODE_PATTERN}') THEN t END) END"""
SQL_KIND = r"coalesce(nullif(regexp_extract(t, '/(p|reel|tv)/[A-Za-z0-9_-]+', 1), ''), 'p')"
REFS = f"""{I.LINKS},
refs AS (SELECT line_no, {SQL_SHORTCODE} AS shortcode, {SQL_KIND} AS kind
         FROM (SELECT *, {I.sql_strip('value')} AS t FROM links))"""


@query(f"WITH {REFS} SELECT line_no, shortcode, kind FROM refs")
def extract_shortcode(spark, sf):
    ref = H.post_ref(F.col("value"))
    return I.links(spark, sf).select("line_no", ref.alias("ref")).select("line_no", "ref.*")


def described_pages(spark, sf):
    """Page titles dressed up as page descriptions of three shapes."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    shape = F.col("page_id") % 3
    text = (
        F.when(shape == 0, F.concat(F.lit('12 likes, 3 comments - someone: "'), title, F.lit('" ')))
        .when(shape == 1, F.concat(F.lit("12 likes: '"), title, F.lit("'")))
        .otherwise(title)
    )
    return I.texts(spark, sf, "pages").select("page_id", text.alias("description"), "html", "url")


SQL_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
DESCRIBED = f"""described AS (
  SELECT page_id, html, url, CASE page_id % 3 WHEN 0 THEN '12 likes, 3 comments - someone: "' || {SQL_TITLE} || '" '
    WHEN 1 THEN '12 likes: ''' || {SQL_TITLE} || '''' ELSE {SQL_TITLE} END AS description FROM pages)"""


def sql_og(d: str) -> str:
    d = I.sql_strip(d)
    quoted = f"""regexp_extract({d}, '(?s):[{I.SQL_WS}]*["“](.+?)["”][{I.SQL_WS}]*$', 1)"""
    tail = I.sql_strip(f"list_extract(string_split({d}, ':'), -1)")
    tail = f"""regexp_replace(regexp_replace({tail}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')"""
    return (
        f"CASE WHEN {quoted} <> '' THEN {I.sql_strip(I.sql_unescape(quoted))}"
        f" WHEN contains({d}, ':') THEN {I.sql_strip(I.sql_unescape(tail))}"
        f" ELSE {I.sql_unescape(d)} END"
    )


@query(f"WITH {DESCRIBED} SELECT page_id, {sql_og('description')} AS caption FROM described")
def caption_from_og(spark, sf):
    return described_pages(spark, sf).select(
        "page_id", H.caption_from_og(F.col("description")).alias("caption")
    )


SQL_HEADING = I.sql_strip(
    I.sql_unescape("regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')")
)


#: What a page of each shape shows by default: a marked caption, a description only, neither.
SQL_BY_DEFAULT = f"""CASE page_id % 3 WHEN 0 THEN {I.sql_strip(I.sql_unescape(f"regexp_replace({SQL_TITLE}, '<[^>]+>', ' ', 'g')"))}
  WHEN 1 THEN {sql_og(I.sql_unescape(f"'12 likes: ' || replace({SQL_TITLE}, chr(34), '')"))} ELSE '' END"""


@query(f"SELECT page_id, {SQL_HEADING} AS caption, {SQL_BY_DEFAULT} AS default_caption FROM pages")
def caption_from_html(spark, sf):
    """Headings by a marker of their own; and pages that get a marked caption, a description or neither, by the default marker."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    marked = F.concat(F.lit('<span class="Caption" dir="auto">'), title, F.lit("</span>"))
    described = F.concat(
        F.lit('<meta property="og:description" content="12 likes: '), F.replace(title, F.lit('"'), F.lit("")), F.lit('"/>')
    )
    shape = F.col("page_id") % 3
    head = F.when(shape == 0, F.concat(marked, described)).when(shape == 1, described).otherwise("")
    return I.texts(spark, sf, "pages").select(
        "page_id",
        H.caption_from_html(F.col("html"), "<h1", "h1").alias("caption"),
        H.caption_from_html(F.concat(head, "html")).alias("default_caption"),
    )


LINK_PATTERN = r'href="([^"#]+)"'
LINK_MARKERS = ("/the", "/que", "/und")
SQL_URLS = f"""urls AS (
  SELECT page_id, unnest(found) AS raw, generate_subscripts(found, 1) AS pos
  FROM (SELECT page_id, regexp_extract_all(html, '{LINK_PATTERN}', 1) AS found FROM pages)),
plain AS (SELECT page_id, pos, {I.sql_unescape('raw')} AS url FROM urls)"""
SQL_PICK = f"""{SQL_URLS},
picked AS (
  SELECT page_id, url FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY
      CAST({I.sql_contains_any('url', LINK_MARKERS)} AS INTEGER), length(url) DESC, pos) AS rn FROM plain)
  WHERE rn = 1)"""


@query(f"WITH {SQL_URLS} SELECT page_id, CAST(pos AS INTEGER) AS pos, url FROM plain")
def image_urls(spark, sf):
    urls = H.image_urls(F.col("html"), LINK_PATTERN, 1)
    return (
        I.texts(spark, sf, "pages")
        .select("page_id", F.posexplode(urls).alias("pos", "url"))
        .withColumn("pos", F.col("pos") + 1)
    )


@query(
    f"""WITH {SQL_PICK} SELECT page_id, picked.url,
      CASE page_id % 3 WHEN 0 THEN 'https://x.scontent.net/' || page_id || '.webp?a=1&b=2'
        WHEN 1 THEN 'https://img.example/' || page_id || '.png?a=1&b=2' END AS default_url
    FROM pages LEFT JOIN picked USING (page_id)"""
)
def pick_image_url(spark, sf):
    """Links by a pattern of their own; and pages that get media with a longer thumbnail, an og:image or neither, by the default pattern."""
    number = F.col("page_id").cast("string")
    media = F.concat(
        F.lit("<img src='https://x.scontent.net/s150x150/a-much-longer-name-"), number, F.lit(".jpg'>"),
        F.lit('<img src="https://x.scontent.net/'), number, F.lit('.webp?a=1&amp;b=2">'),
    )
    og = F.concat(F.lit('<meta property="og:image" content="https://img.example/'), number, F.lit('.png?a=1&amp;b=2"/>'))
    shape = F.col("page_id") % 3
    head = F.when(shape == 0, F.concat(media, og)).when(shape == 1, og).otherwise("")
    pages = I.texts(spark, sf, "pages").select("page_id", "html", F.concat(head, "html").alias("dressed"))
    linked = H.with_image_url(pages, name="url", pattern=LINK_PATTERN, group=1, thumbnail_markers=LINK_MARKERS)
    return H.with_image_url(linked, html="dressed", name="default_url").select("page_id", "url", "default_url")


@query(f"SELECT page_id, {I.sql_unescape('html')} AS text FROM pages")
def html_unescape(spark, sf):
    return I.texts(spark, sf, "pages").select("page_id", H.html_unescape(F.col("html")).alias("text"))


@query(
    f"""WITH {DESCRIBED}
    SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {I.sql_strip('url')} ELSE {sql_og('description')} END AS caption
    FROM described"""
)
def modal_caption(spark, sf):
    dom = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" "), "url", F.lit(" ")))
    return described_pages(spark, sf).select(
        "page_id", H.modal_caption(dom, F.col("description")).alias("caption")
    )


@query(
    f"""WITH texts AS (SELECT doc_id, {I.sql_strip('text')} AS t, length(text) AS n FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 4 = 3 OR (doc_id % 4 = 2 AND n <= 8) OR (doc_id % 4 = 0 AND n <= 3) THEN '' ELSE t END AS caption
    FROM texts"""
)
def caption_from_embedded_json(spark, sf):
    """Documents wrapped into the three JSON shapes that carry a caption, and one that does not."""
    text = F.col("text")
    shape = F.col("doc_id") % 4
    caption = F.struct(F.array(F.struct(F.struct(text.alias("text")).alias("caption"))).alias("items"))
    edge = F.struct(
        F.struct(
            F.struct(F.array(F.struct(F.struct(text.alias("text")).alias("node"))).alias("edges")).alias(
                "edge_media_to_caption"
            )
        ).alias("media")
    )
    typed = F.struct(F.struct(F.lit("XCaption").alias("__typename"), text.alias("text")).alias("inner"))
    other = F.struct(F.struct(F.lit("Other").alias("__typename"), text.alias("text")).alias("inner"))
    body = (
        F.when(shape == 0, F.to_json(caption))
        .when(shape == 1, F.to_json(edge))
        .when(shape == 2, F.to_json(typed))
        .otherwise(F.to_json(other))
    )
    page = F.concat(
        F.lit('<p></p><script type="application/json">{broken</script><script type="application/json">'),
        body,
        F.lit("</script>"),
    )
    return I.table(spark, sf, "documents").select(
        "doc_id", H.caption_from_embedded_json(page).alias("caption")
    )


SQL_MEDIA_URL = "url || CASE WHEN page_id % 2 = 0 THEN '/a.WEBP?x=1' ELSE '/a.png?y=.webp' END"


@query(
    f"""SELECT page_id, CASE WHEN contains(lower(list_extract(string_split({SQL_MEDIA_URL}, '?'), 1)), '.webp')
         THEN '.webp' ELSE '.jpg' END AS suffix FROM pages"""
)
def media_suffix(spark, sf):
    tail = F.when(F.col("page_id") % 2 == 0, "/a.WEBP?x=1").otherwise("/a.png?y=.webp")
    return I.texts(spark, sf, "pages").select(
        "page_id", H.media_suffix(F.concat("url", tail)).alias("suffix")
    )


@query(
    f"""WITH {REFS} SELECT line_no,
      'https://www.instagram.com/' || kind || '/' || shortcode || '/embed/captioned/' AS url
    FROM refs WHERE shortcode IS NOT NULL"""
)
def build_embed_url(spark, sf):
    ref = H.post_ref(F.col("value"))
    refs = I.links(spark, sf).select("line_no", ref.alias("r")).filter("r.shortcode IS NOT NULL")
    return refs.select("line_no", H.embed_url(F.col("r.shortcode"), F.col("r.kind")).alias("url"))


@query(
    f"""SELECT conv_id, turn, CASE WHEN t = '' THEN '.' ELSE t END AS text FROM (
      SELECT conv_id, turn, {I.sql_strip("list_extract(string_split(x, 'Assistant:'), -1)")} AS t FROM (
        SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'User: q Assistant: ' || text || ' '
               WHEN turn % 3 = 0 THEN 'Assistant: ' ELSE text END AS x FROM conversations))"""
)
def clean_generated_text(spark, sf):
    raw = (
        F.when(F.col("role") == "assistant", F.concat(F.lit("User: q Assistant: "), "text", F.lit(" ")))
        .when(F.col("turn") % 3 == 0, "Assistant: ")
        .otherwise(F.col("text"))
    )
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", T.clean_generated_text(raw).alias("text")
    )


@query(
    f"""WITH {I.FEATURES} SELECT post_id, CASE WHEN polarity_T > 0.15 THEN 'positive'
      WHEN polarity_T < -0.15 THEN 'negative' ELSE 'neutral' END AS phrase FROM features"""
)
def polarity_phrase(spark, sf):
    return I.features(spark, sf).select("post_id", T.polarity_phrase(F.col("polarity_T")).alias("phrase"))


SQL_DISPLAY = (
    "CASE label "
    + " ".join(f"WHEN {I.sql_text(k)} THEN {I.sql_text(v)}" for k, v in K.LABEL_DISPLAY.items())
    + " ELSE label END"
)


@query(f"WITH {I.AUDIT} SELECT ord, label, {SQL_DISPLAY} AS name FROM audit")
def label_display(spark, sf):
    return I.audit_log(spark, sf).select("ord", "label", T.label_display(F.col("label")).alias("name"))


@query(
    f"SELECT conv_id, turn, length({I.sql_strip('text')}) >= 80 AS long_enough FROM conversations"
)
def min_text_len(spark, sf):
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", T.min_text_len(F.col("text"), 80).alias("long_enough")
    )


SQL_TAGGED = rf"""tagged AS (
  SELECT ord, post_id, regexp_extract_all(
    regexp_replace(caption, '(^| )([{I.SQL_WORD}]{{7,}})', '\1#\2', 'g'), '#([{I.SQL_WORD}]+)', 1) AS tags
  FROM captions)"""


def tagged_captions(spark, sf):
    """Captions whose long words are written as hashtags."""
    text = F.regexp_replace("caption", rf"(^| )([{T.WORD}]{{7,}})", "$1#$2")
    return I.captions(spark, sf).select("ord", "post_id", T.hashtags(text).alias("tags"))


@query(f"WITH {I.CAPTIONS}, {SQL_TAGGED} SELECT post_id, unnest(tags) AS tag FROM tagged")
def extract_hashtags(spark, sf):
    return tagged_captions(spark, sf).select("post_id", F.explode("tags").alias("tag"))


@query(
    f"""WITH {I.AUDIT} SELECT ord, timestamp AS stamp, CAST(epoch(CAST(timestamp AS TIMESTAMP)) AS BIGINT) AS seconds
    FROM audit"""
)
def event_timestamp(spark, sf):
    stamp = F.col("timestamp")
    return I.audit_log(spark, sf).select(
        "ord", stamp.alias("stamp"), F.unix_timestamp(T.event_timestamp(stamp)).alias("seconds")
    )
