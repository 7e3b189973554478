"""Posts, logs, vectors, tokens and timings derived from the given tables.

Every derivation exists twice with the same formula: as a DataFrame and as the text of a
common table expression, so that a query and its SQL twin start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.functions import vectors as V
from tonegap.operators.folds import stratified_folds
from tonegap.operators.learning import argmax_label

LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
SCRIPT = "ابپتثجچحخدذرزژسشصضطظعغفقكي" * 2 + K.PERSIAN_DIGITS
CUES = (
    "prompt",
    "دایرکت",
    "طنز",
    "ناراحت 😀",
    "خوشحالم 😢",
    "ولي غمگین",
    "مگه happy",
    '"a" b',
    "«x»",
    "https://t.example/ab?c=1 @user_۱۲ www.Example.org/x",
    "\u00a0 tab\tend ",
    "e\u0301 پنل",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows are long texts, in the splits its files give."""
    return table(spark, sf, name)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def r6(expr: str) -> str:
    """Rounded in SQL, without a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


def rounded(column: str | Column, name: str | None = None) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col.cast("double"), 6).alias(name or column)


def position(i: Column) -> Column:
    return i.cast("int")


# --- captions ---------------------------------------------------------------


def captions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as posts: non-English texts in Persian script, one cue appended to each.

    ``group_id`` repeats (texts of equal length share it) and serves as a post id wherever
    duplicates are wanted.
    """
    cue = F.element_at(F.array(*[F.lit(c) for c in CUES]), (F.col("n_chars") % len(CUES) + 1).cast("int"))
    script = F.when(F.col("lang") != "en", F.translate("text", LATIN, SCRIPT)).otherwise(F.col("text"))
    doc_id = F.col("doc_id").cast("string")
    return texts(spark, sf, "documents").select(
        F.col("doc_id").alias("ord"),
        doc_id.alias("post_id"),
        F.col("n_chars").cast("string").alias("group_id"),
        "source",
        "lang",
        "n_chars",
        F.concat(script, F.lit(" "), cue).alias("caption"),
        F.concat(F.lit("/pool/"), "source", F.lit("/"), doc_id, F.lit(".jpg")).alias("image_path"),
        (F.col("n_chars") % 13 != 0).alias("media_ok"),
        (F.col("n_chars") % 7 != 0).alias("face_ok"),
    )


CAPTIONS = f"""captions AS (
  SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS post_id, CAST(n_chars AS VARCHAR) AS group_id,
         source, lang, n_chars,
         (CASE WHEN lang <> 'en' THEN translate(text, {sql_text(LATIN)}, {sql_text(SCRIPT)}) ELSE text END)
           || ' ' || list_extract({sql_list(CUES)}, CAST(n_chars % {len(CUES)} + 1 AS INTEGER)) AS caption,
         '/pool/' || source || '/' || doc_id || '.jpg' AS image_path,
         n_chars % 13 <> 0 AS media_ok, n_chars % 7 <> 0 AS face_ok
  FROM documents)"""

SQL_WS = r"\t-\r\x1c-\x20\x{85}\p{Z}"
SQL_WORD = r"\p{L}\p{N}_"
SQL_LETTER = r"\p{L}\p{Nl}\p{No}"


def sql_normalize(x: str) -> str:
    source = K.ARABIC_FORMS_FROM + K.ARABIC_INDIC_DIGITS + K.PERSIAN_DIGITS
    target = K.ARABIC_FORMS_TO + K.ASCII_DIGITS + K.ASCII_DIGITS
    return f"translate(nfc_normalize({x}), {sql_text(source)}, {sql_text(target)})"


def sql_strip_urls(x: str) -> str:
    return rf"regexp_replace({x}, '(?i)https?://[^{SQL_WS}]+|www\.[^{SQL_WS}]+', ' ', 'g')"


def sql_strip_mentions(x: str) -> str:
    return rf"regexp_replace({x}, '(^|[^{SQL_WORD}])@[{SQL_WORD}]+', '\1 ', 'g')"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SQL_WS}]+', ' ', 'g'))"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SQL_WS}]+|[{SQL_WS}]+$', '', 'g')"


def sql_preprocess(x: str) -> str:
    return sql_collapse(sql_strip_mentions(sql_strip_urls(sql_normalize(x))))


def sql_ratio(x: str) -> str:
    letters = f"regexp_replace({x}, '[^{SQL_LETTER}]+', '', 'g')"
    inside = rf"length(regexp_replace({letters}, '[^\x{{0600}}-\x{{06FF}}]+', '', 'g'))"
    return f"(CASE WHEN length({letters}) > 0 THEN CAST({inside} AS DOUBLE) / length({letters}) ELSE 0 END)"


def sql_contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {sql_text(w)})" for w in words) + ")"


def sql_spam(x: str) -> str:
    return (
        f"({sql_contains_any(f'lower({x})', K.SPAM_SUBSTRINGS_LATIN)}"
        f" OR {sql_contains_any(x, K.SPAM_SUBSTRINGS_FA)}"
        f" OR (length({x}) > {K.SPAM_LONG_TEXT} AND {sql_contains_any(x, K.SPAM_LONG_WORDS)}))"
    )


def sql_matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {sql_text('(?i)' + pattern)})"


def sql_sarcasm(x: str) -> str:
    neg, pos = sql_matches(x, K.NEG_PATTERN), sql_matches(x, K.POS_PATTERN)
    turn = sql_matches(x, K.TURN_PATTERN)
    return f"""(length({x}) >= {K.SARCASM_MIN_LENGTH} AND (
      {sql_matches(x, K.IRONY_PATTERN)}
      OR ({neg} AND {sql_matches(x, K.HAPPY_EMOJI)})
      OR ({pos} AND {sql_matches(x, K.SAD_EMOJI)})
      OR ({neg} AND {pos})
      OR ({turn} AND ({neg} OR {pos}))
      OR length({x}) - length(replace({x}, '"', '')) >= 2
      OR contains({x}, '«')))"""


def sql_keyword_counts(x: str) -> tuple[str, str]:
    count = lambda words: "(" + " + ".join(
        f"CAST(contains({x}, {sql_text(w)}) AS INTEGER)" for w in words
    ) + ")"
    return count(K.WEAK_POSITIVE_WORDS), count(K.WEAK_NEGATIVE_WORDS)


CLEAN = f"""{CAPTIONS},
clean AS (SELECT * EXCLUDE (caption), {sql_preprocess('caption')} AS caption FROM captions)"""


def seen_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that are already known: lengths of the benchmark texts."""
    return table(spark, sf, "benchmark").select(F.length("text").cast("string").alias("post_id"))


SEEN = "seen AS (SELECT CAST(length(text) AS VARCHAR) AS post_id FROM benchmark)"


def pool(spark: SparkSession, sf: str) -> DataFrame:
    return captions(spark, sf).select("ord", "post_id", "caption", "image_path")


def grouped_posts(spark: SparkSession, sf: str) -> DataFrame:
    """The same posts with repeating ids."""
    return captions(spark, sf).withColumn("post_id", F.col("group_id")).drop("group_id")


# --- annotation log ---------------------------------------------------------


def audit_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as annotations: 40 in a row belong to one post, hours make equal timestamps."""
    kind, user = F.col("event_type"), F.col("user_id")
    label = (
        F.when(kind == "view", "neutral")
        .when(kind == "click", "positive")
        .when(kind == "purchase", "positive_sarcasm")
        .when(kind == "signup", "negative_sarcasm")
        .when(F.col("value") > 60, "unsure")
        .otherwise("negative")
    )
    return table(spark, sf, "events").select(
        F.col("event_id").alias("ord"),
        (F.floor(F.col("event_id") / 40) * 5).cast("string").alias("post_id"),
        label.alias("label"),
        F.when(user % 9 != 0, F.concat(F.lit("u"), user.cast("string"))).alias("annotator_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:00:00").alias("timestamp"),
    )


AUDIT = """audit AS (
  SELECT event_id AS ord, CAST((event_id // 40) * 5 AS VARCHAR) AS post_id,
         CASE event_type WHEN 'view' THEN 'neutral' WHEN 'click' THEN 'positive'
              WHEN 'purchase' THEN 'positive_sarcasm' WHEN 'signup' THEN 'negative_sarcasm'
              ELSE CASE WHEN value > 60 THEN 'unsure' ELSE 'negative' END END AS label,
         CASE WHEN user_id % 9 <> 0 THEN 'u' || user_id END AS annotator_id,
         strftime(ts, '%Y-%m-%dT%H:00:00') AS timestamp
  FROM events)"""
SQL_LABELS = ", ".join(sql_text(x) for x in K.LABELS)
LATEST = f"""{AUDIT},
latest AS (
  SELECT annotator_id, post_id, label FROM (
    SELECT coalesce(nullif(annotator_id, ''), '_unknown_') AS annotator_id, post_id, label,
           row_number() OVER (PARTITION BY coalesce(nullif(annotator_id, ''), '_unknown_'), post_id
                              ORDER BY ord DESC) AS rn
    FROM audit WHERE label IN ({SQL_LABELS})) WHERE rn = 1)"""


# --- vectors and features ---------------------------------------------------


def class_label(column: str = "label") -> Column:
    names = F.array(*[F.lit(x) for x in K.LABELS])
    return F.element_at(names, (F.col(column) % 5 + 1).cast("int"))


def scaled_softmax(vector: Column, start: int, n: int) -> Column:
    return V.softmax(F.transform(F.slice(vector, start, n), lambda x: x.cast("double") * 10))


def stage_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector is a post's caption, the next one its description, the one after its media."""
    base = table(spark, sf, "embeddings")
    other = lambda step, name: base.select(
        (F.col("vec_id") - step).alias("vec_id"), F.col("embedding").alias(name)
    )
    own = F.col("embedding")
    joined = base.join(other(1, "_hat"), "vec_id", "left").join(other(2, "_img"), "vec_id", "left")
    hat = F.coalesce("_hat", own)
    return joined.select(
        F.col("vec_id").cast("string").alias("post_id"),
        class_label().alias("label"),
        own.alias("emb_T"),
        hat.alias("emb_T_hat"),
        F.coalesce("_img", own).alias("emb_I"),
        scaled_softmax(own, 1, 2).alias("pol_T"),
        scaled_softmax(hat, 1, 2).alias("pol_T_hat"),
        scaled_softmax(own, 4, 5).alias("proba"),
    )


def features(spark: SparkSession, sf: str) -> DataFrame:
    wide = V.with_features(stage_vectors(spark, sf))
    return wide.select("post_id", "label", *K.FEATURE_NAMES, "pol_T", "proba")


def sql_softmax(x: str) -> str:
    powers = f"list_transform({x}, lambda v: exp(v - list_max({x})))"
    return f"list_transform({powers}, lambda p: p / list_sum({powers}))"


def _softmax_slice(v: str, start: int, n: int) -> str:
    return ", ".join(f"10 * {v}[{i}]" for i in range(start, start + n))


VECTORS = f"""raw_vectors AS (
  SELECT a.vec_id, CAST(a.vec_id AS VARCHAR) AS post_id,
         list_extract({sql_list(K.LABELS)}, a.label % 5 + 1) AS label,
         CAST(a.embedding AS DOUBLE[]) AS t,
         CAST(coalesce(b.embedding, a.embedding) AS DOUBLE[]) AS h,
         CAST(coalesce(c.embedding, a.embedding) AS DOUBLE[]) AS i
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1
  LEFT JOIN embeddings c ON c.vec_id = a.vec_id + 2),
logits AS (
  SELECT *, [{_softmax_slice('t', 1, 2)}] AS lt, [{_softmax_slice('h', 1, 2)}] AS lh,
         [{_softmax_slice('t', 4, 5)}] AS lp FROM raw_vectors),
vectors AS (
  SELECT vec_id, post_id, label, t, h, i, {sql_softmax('lt')} AS pt, {sql_softmax('lh')} AS ph,
         {sql_softmax('lp')} AS proba FROM logits)"""
FEATURE_ROWS = """features AS (
  SELECT post_id, label, proba, pt, ph,
         greatest(0, least(2, 1 - list_cosine_similarity(t, h))) AS Dsem,
         abs(pt[1] - ph[1]) + abs(pt[2] - ph[2]) AS Dsen,
         list_cosine_similarity(i, h) AS Fvt,
         list_cosine_similarity(t, i) AS cos_TI,
         pt[2] - pt[1] AS polarity_T, ph[2] - ph[1] AS polarity_T_hat
  FROM vectors)"""
FEATURES = f"{VECTORS}, {FEATURE_ROWS}"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """``(post_id, fold, label, pred)``: gold classes against the strongest probability."""
    scored = stage_vectors(spark, sf).select("post_id", "label", argmax_label(F.col("proba")).alias("pred"))
    return stratified_folds(scored)


SQL_FOLD = (
    "CAST((row_number() OVER (PARTITION BY label ORDER BY md5('0:' || post_id), post_id) - 1) % 5 + 1"
    " AS INTEGER)"
)
SQL_ARGMAX = f"list_extract({sql_list(K.LABELS)}, CAST(list_position(proba, list_max(proba)) AS INTEGER))"
PREDICTIONS = f"""{VECTORS},
predictions AS (
  SELECT post_id, label, {SQL_ARGMAX} AS pred, {SQL_FOLD} AS fold FROM vectors)"""


def _sql_f1(label: str) -> str:
    tp = f"sum(CASE WHEN label = '{label}' AND pred = '{label}' THEN 1 ELSE 0 END)"
    both = f"(sum(CAST(label = '{label}' AS INTEGER)) + sum(CAST(pred = '{label}' AS INTEGER)))"
    return f"CASE WHEN {both} > 0 THEN CAST(2 * {tp} AS DOUBLE) / {both} ELSE 0 END AS f1_{label}"


SQL_IRONIC = "label IN ('positive_sarcasm', 'negative_sarcasm')"


def fold_scores_sql(source: str, name: str) -> str:
    """CTEs that turn a predictions table into per-fold scores."""
    return f"""{name}_raw AS (
  SELECT fold, count(*) AS n_rows, avg(CAST(label = pred AS DOUBLE)) AS accuracy,
         {', '.join(_sql_f1(x) for x in K.LABELS)},
         avg(CASE WHEN {SQL_IRONIC} THEN CAST(label = pred AS DOUBLE) END) AS sarcasm_accuracy
  FROM {source} GROUP BY fold),
{name} AS (
  SELECT *, ({' + '.join('f1_' + x for x in K.LABELS)}) / 5 AS macro_f1 FROM {name}_raw)"""


FOLD_SCORES = f"{PREDICTIONS}, {fold_scores_sql('predictions', 'fold_scores')}"


# --- timings, tokens, attention, pages --------------------------------------


def timings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("stage"),
        F.col("value").alias("latency_s"),
        (F.col("user_id") * 10_000_000 + F.col("event_id")).alias("peak_bytes"),
    )


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns cut at spaces, between two anchors; lengths decide sub-word markers."""
    words = F.concat(F.array(F.lit("[CLS]")), F.split("text", " "), F.array(F.lit("[SEP]")))
    each = table(spark, sf, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("post_id"),
        F.posexplode(words).alias("pos", "word"),
    )
    size = F.length("word")
    token = (
        F.when(F.col("word").isin("[CLS]", "[SEP]"), F.col("word"))
        .when(size >= 9, F.concat(F.lit("##"), "word"))
        .when(size == 3, F.concat(F.lit("▁"), "word"))
        .when(size == 2, "…")
        .otherwise(F.col("word"))
    )
    score = ((size * 7 + F.col("pos")) % 11 - 3).cast("double")
    return each.select("post_id", F.col("pos").cast("long").alias("pos"), token.alias("token"), score.alias("score"))


TOKENS = """words AS (
  SELECT post_id, unnest(list) AS word, CAST(generate_subscripts(list, 1) - 1 AS BIGINT) AS pos FROM (
    SELECT conv_id || ':' || turn AS post_id,
           list_concat(['[CLS]'], string_split(text, ' '), ['[SEP]']) AS list FROM conversations)),
tokens AS (
  SELECT post_id, pos,
         CASE WHEN word IN ('[CLS]', '[SEP]') THEN word WHEN length(word) >= 9 THEN '##' || word
              WHEN length(word) = 3 THEN '▁' || word WHEN length(word) = 2 THEN '…' ELSE word END AS token,
         CAST((length(word) * 7 + pos) % 11 - 3 AS DOUBLE) AS score
  FROM words)"""
SQL_ANCHORS = ", ".join(sql_text(x) for x in K.ANCHOR_TOKENS)


def attention(spark: SparkSession, sf: str) -> DataFrame:
    """The 64 entries of a vector as 2 layers x 2 heads x a 4 x 4 matrix."""
    each = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("post_id"), F.posexplode("embedding").alias("p", "v")
    )
    p = F.col("p")
    return each.select(
        "post_id",
        F.floor(p / 32).cast("int").alias("layer"),
        F.floor(p % 32 / 16).cast("int").alias("head"),
        F.floor(p % 16 / 4).cast("int").alias("i"),
        (p % 4).alias("j"),
        F.exp(F.col("v").cast("double")).alias("w"),
    )


ATTENTION = """entries AS (
  SELECT CAST(vec_id AS VARCHAR) AS post_id, unnest(embedding) AS v,
         CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS p FROM embeddings),
attention AS (
  SELECT post_id, p // 32 AS layer, p % 32 // 16 AS head, p % 16 // 4 AS i, p % 4 AS j,
         exp(CAST(v AS DOUBLE)) AS w FROM entries)"""
RESIDUAL = f"""{ATTENTION},
fused AS (SELECT post_id, layer, i, j, avg(w) AS w FROM attention GROUP BY post_id, layer, i, j),
raised AS (SELECT post_id, layer, i, j, w + CASE WHEN i = j THEN 1 ELSE 0 END AS w FROM fused),
residual AS (SELECT post_id, layer, i, j, w / sum(w) OVER (PARTITION BY post_id, layer, i) AS w FROM raised)"""


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as lines of a link file: links of three kinds, bare ids, comments, noise."""
    code = F.substring(F.md5("url"), 1, 11)
    kind = F.element_at(F.array(F.lit("p"), F.lit("reel"), F.lit("tv")), (F.col("page_id") % 3 + 1).cast("int"))
    line = (
        F.when(F.col("page_id") % 7 == 0, code)
        .when(F.col("page_id") % 11 == 0, F.concat(F.lit("# "), "url"))
        .when(F.col("page_id") % 13 == 0, F.col("url"))
        .otherwise(F.concat(F.lit(" https://www.instagram.com/"), kind, F.lit("/"), code, F.lit("/?x=1 ")))
    )
    return table(spark, sf, "pages").select(F.col("page_id").alias("line_no"), line.alias("value"), "url")


LINKS = """links AS (
  SELECT page_id AS line_no, url,
         CASE WHEN page_id % 7 = 0 THEN substring(md5(url), 1, 11)
              WHEN page_id % 11 = 0 THEN '# ' || url WHEN page_id % 13 = 0 THEN url
              ELSE ' https://www.instagram.com/' || list_extract(['p', 'reel', 'tv'], CAST(page_id % 3 + 1 AS INTEGER))
                   || '/' || substring(md5(url), 1, 11) || '/?x=1 ' END AS value
  FROM pages)"""


def sql_unescape(x: str) -> str:
    """The entities that occur in the pages, also when a cut text lost their semicolon."""
    pairs = [("&quot", '"'), ("&copy", "©"), ("&middot", "·"), ("&lt", "<"), ("&gt", ">"), ("&amp", "&")]
    for entity, char in pairs:
        x = f"regexp_replace({x}, {sql_text(entity + ';?')}, {sql_text(char)}, 'g')"
    return x
