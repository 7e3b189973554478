"""Queries for gates, joins, dedup and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.functions import html as H
from tonegap.functions import text as T
from tonegap.operators import curate as C
from tonegap.operators import gates as G
from tonegap.operators import keyed
from tonegap.operators.annotation import pending_for_annotator as pending
from tonegap.plans import inputs as I
from tonegap.plans.registry import query
from tonegap.plans.text_queries import SQL_KEYWORD_LABEL, SQL_TAGGED, tagged_captions
from tonegap.session import scratch_path
from tonegap.sources import tables as S

# --- gates ------------------------------------------------------------------


def judged_sql(rules: G.GateRules) -> str:
    steps = []
    if rules.media_first:
        steps.append("WHEN NOT media_ok THEN 'no_media'")
    if rules.require_caption:
        steps.append("WHEN caption = '' THEN 'no_caption'")
    blank_ok = "caption <> '' AND " if rules.allow_blank else ""
    steps.append(f"WHEN {blank_ok}{I.sql_ratio('caption')} < 0.5 THEN 'wrong_script'")
    steps.append(f"WHEN {I.sql_spam('caption')} THEN 'spam'")
    if rules.sarcasm_only:
        steps.append(f"WHEN NOT {I.sql_sarcasm('caption')} THEN 'not_sarcasm'")
    if not rules.media_first:
        steps.append("WHEN NOT media_ok THEN 'no_media'")
    steps.append("WHEN NOT face_ok THEN 'no_face'")
    return f"""{I.CLEAN}, {I.SEEN},
fresh AS (SELECT * FROM clean WHERE group_id NOT IN (SELECT post_id FROM seen)),
judged AS (SELECT ord, group_id AS post_id, caption, CASE {' '.join(steps)} ELSE 'accepted' END AS reason FROM fresh)"""


def admitted_sql(rules: G.GateRules) -> str:
    blocking = ", ".join(I.sql_text(r) for r in G.blocking_reasons(rules))
    return f"""{judged_sql(rules)},
admitted AS (
  SELECT ord, post_id, caption FROM (
    SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY ord) AS rn
    FROM judged WHERE reason IN ({blocking})) WHERE rn = 1 AND reason = 'accepted')"""


SARCASM_EMBED = G.GateRules(require_caption=True, spam_blocks=True, sarcasm_only=True)


def _gated(spark, sf, rules: G.GateRules):
    return G.gate(
        I.grouped_posts(spark, sf),
        rules,
        seen=I.seen_posts(spark, sf),
        media_ok=F.col("media_ok"),
        face_ok=F.col("face_ok"),
    ).select("ord", "post_id", "caption")


@query(f"WITH {admitted_sql(G.FEED)} SELECT * FROM admitted")
def gate_feed(spark, sf):
    return _gated(spark, sf, G.FEED)


@query(f"WITH {admitted_sql(G.LOCAL)} SELECT * FROM admitted")
def gate_local(spark, sf):
    return _gated(spark, sf, G.LOCAL)


@query(f"WITH {admitted_sql(SARCASM_EMBED)} SELECT * FROM admitted")
def gate_embed(spark, sf):
    return _gated(spark, sf, SARCASM_EMBED)


@query(
    f"""WITH {judged_sql(G.LOCAL)}, stops AS (
      SELECT post_id, min(ord) FILTER (WHERE reason IN ('accepted', 'no_face', 'spam')) AS stop
      FROM judged GROUP BY post_id),
    final AS (SELECT CASE WHEN ord > stop THEN 'duplicate' ELSE reason END AS reason FROM judged JOIN stops USING (post_id)
      UNION ALL SELECT 'duplicate' FROM clean WHERE group_id IN (SELECT post_id FROM seen))
    SELECT reason, count(*) AS n FROM final GROUP BY reason"""
)
def gate_counters(spark, sf):
    judged = G.verdicts(
        I.grouped_posts(spark, sf), G.LOCAL, media_ok=F.col("media_ok"), face_ok=F.col("face_ok")
    )
    path = scratch_path(spark, "verdicts")
    judged.select("post_id", "ord", "reason").write.parquet(path)
    return G.gate_counters(spark.read.parquet(path), G.LOCAL, seen=I.seen_posts(spark, sf))


@query(f"WITH {admitted_sql(G.FEED)} SELECT ord, post_id FROM admitted ORDER BY ord LIMIT 50")
def limit_accepted(spark, sf):
    return G.limit_accepted(_gated(spark, sf, G.FEED).select("ord", "post_id"), 50)


@query(
    f"""WITH {I.CAPTIONS}, starts AS (SELECT source FROM captions GROUP BY source ORDER BY min(ord) LIMIT 12)
    SELECT source, ord FROM (
      SELECT source, ord, row_number() OVER (PARTITION BY source ORDER BY ord) AS rn FROM captions
      WHERE source IN (SELECT source FROM starts)) WHERE rn <= 10"""
)
def cap_per_source(spark, sf):
    posts = I.captions(spark, sf).select("source", "ord")
    return G.cap_per_source(posts, "source", per_source=10, max_sources=12)


@query(f"WITH {I.CAPTIONS} SELECT ord, source FROM captions WHERE lang <> 'de'")
def photo_only(spark, sf):
    """German posts stand for videos."""
    return G.photo_only(I.captions(spark, sf).withColumn("is_video", F.col("lang") == "de")).select("ord", "source")


@query(
    """WITH accounts AS (
      SELECT c_custkey, c_acctbal < 0 AS is_private, c_mktsegment = 'BUILDING' AS followed, count(o_orderkey) AS media_count
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
    SELECT c_custkey, media_count FROM accounts WHERE NOT (is_private AND NOT followed) AND media_count > 0"""
)
def visible_only(spark, sf):
    """Customers as accounts: debtors are private, one segment is followed, orders are posts."""
    posts = I.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    accounts = I.table(spark, sf, "customer").join(posts, "c_custkey", "left").select(
        "c_custkey",
        (F.col("c_acctbal") < 0).alias("is_private"),
        (F.col("c_mktsegment") == "BUILDING").alias("followed"),
        F.coalesce("n", F.lit(0)).alias("media_count"),
    )
    return G.visible_only(accounts).select("c_custkey", "media_count")


@query(f"WITH {I.AUDIT} SELECT ord, post_id FROM audit WHERE label = 'negative_sarcasm'")
def filter_by_label(spark, sf):
    return G.filter_by_label(I.audit_log(spark, sf), "negative_sarcasm").select("ord", "post_id")


@query(
    f"""WITH {I.AUDIT} SELECT label, min(ord) AS ord FROM audit WHERE label IN ({I.SQL_LABELS}) GROUP BY label"""
)
def first_per_label(spark, sf):
    return C.first_per_label(I.audit_log(spark, sf)).select("label", "ord")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def head_n(spark, sf):
    return G.head_n(I.table(spark, sf, "documents").select("doc_id", "source"), 100, "doc_id")


@query(
    f"""WITH {I.CAPTIONS}, {I.AUDIT} SELECT post_id FROM captions
    WHERE post_id NOT IN (SELECT post_id FROM audit WHERE annotator_id = 'u1')"""
)
def pending_for_annotator(spark, sf):
    return pending(I.pool(spark, sf), I.audit_log(spark, sf), "u1").select("post_id")


@query("SELECT s_name, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_name ORDER BY s_name")
def ordered_output(spark, sf):
    """Sorted at the sink only, after the aggregation."""
    counts = I.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    names = I.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return counts.join(names, "l_suppkey").select("s_name", "n").orderBy("s_name")


SQL_FILE = "url || CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.webp' WHEN 2 THEN '.gif' ELSE '' END"


@query(
    f"""SELECT page_id, lower(regexp_extract({SQL_FILE}, '(\\.[^./]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.webp')
      OR page_id % 5 = 0 AS usable FROM pages"""
)
def usable_media_type(spark, sf):
    suffix = F.element_at(F.array(F.lit(".JPG"), F.lit(".webp"), F.lit(".gif"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    mime = F.when(F.col("page_id") % 5 == 0, "image/PNG").otherwise("text/html")
    return I.table(spark, sf, "pages").select(
        "page_id", G.media_type_ok(F.concat("url", suffix), mime).alias("usable")
    )


# --- joins, set operations, dedup -------------------------------------------


@query(f"WITH {I.CAPTIONS}, {I.SEEN} SELECT ord, group_id AS post_id FROM captions WHERE group_id NOT IN (SELECT post_id FROM seen)")
def anti_seen(spark, sf):
    posts = I.grouped_posts(spark, sf).select("ord", "post_id")
    return keyed.anti_seen(posts, I.seen_posts(spark, sf))


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.07 AND l_returnflag = 'A'")
def set_difference(spark, sf):
    lines = I.table(spark, sf, "lineitem")
    left = lines.filter("l_returnflag = 'R'").select("l_suppkey")
    right = lines.filter("l_quantity > 49 AND l_discount > 0.07 AND l_returnflag = 'A'").select("l_suppkey")
    return keyed.set_difference(left, right)


def _search_terms(spark, sf):
    """The last words of part names as search terms, part types as exact ones."""
    parts = I.table(spark, sf, "part")
    word = F.element_at(F.split("p_name", " "), -1)
    search = F.col("p_partkey") % 2 == 0
    return parts.groupBy(
        F.when(search, word).otherwise(F.col("p_type")).alias("term"), search.alias("search")
    ).agg(F.min("p_partkey").alias("ord")).select("ord", "term", "search")


SQL_TERMS = """specs AS (
  SELECT min(p_partkey) AS ord, term, search FROM (
    SELECT p_partkey, p_partkey % 2 = 0 AS search,
           CASE WHEN p_partkey % 2 = 0 THEN list_extract(string_split(p_name, ' '), -1) ELSE p_type END AS term
    FROM part) GROUP BY term, search)"""


@query(
    f"""WITH {I.CAPTIONS}, {SQL_TAGGED}, {SQL_TERMS},
    each AS (SELECT ord AS r, unnest(tags) AS tag, generate_subscripts(tags, 1) AS p FROM tagged),
    catalogue AS (SELECT tag, min(r * 100000 + p) AS tag_ord FROM each GROUP BY tag),
    hits AS (
      SELECT s.ord, c.tag, c.tag_ord, row_number() OVER (PARTITION BY s.ord ORDER BY c.tag_ord) AS rn
      FROM specs s JOIN catalogue c ON s.search AND contains(lower(c.tag), lower(s.term))),
    found AS (SELECT ord, tag, rn FROM hits
      UNION ALL SELECT ord, term, 0 FROM specs WHERE ord NOT IN (SELECT ord FROM hits))
    SELECT ord, tag FROM (
      SELECT *, row_number() OVER (PARTITION BY lower(tag) ORDER BY ord, rn) AS first FROM found) WHERE first = 1"""
)
def expand_terms(spark, sf):
    catalogue = C.tag_catalogue(tagged_captions(spark, sf), F.col("tags")).select(
        "tag", (F.col("ord._row") * 100000 + F.col("ord._pos")).alias("ord")
    )
    return C.expand_terms(_search_terms(spark, sf), catalogue).select("ord", "tag")


@query(
    """SELECT 0 AS feed, doc_id AS ord, source AS name FROM documents
    UNION ALL SELECT 1, page_id, url FROM pages UNION ALL SELECT 2, item_id, CAST(item_id AS VARCHAR) FROM benchmark"""
)
def union_sources(spark, sf):
    docs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("name"))
    pages = I.table(spark, sf, "pages").select(F.col("page_id").alias("ord"), F.col("url").alias("name"))
    items = I.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("ord"), F.col("item_id").cast("string").alias("name")
    )
    return C.union_sources([docs, pages, items]).select("feed", "ord", "name")


@query(
    """SELECT doc_id AS post_id, coalesce(quality, CAST(n_chars AS INTEGER)) AS value
    FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""
)
def overlay(spark, sf):
    base = I.table(spark, sf, "documents").select(
        F.col("doc_id").alias("post_id"), F.col("n_chars").cast("int").alias("value")
    )
    top = I.table(spark, sf, "labels").select(F.col("doc_id").alias("post_id"), F.col("quality").alias("value"))
    return keyed.overlay(base, top)


def _first_last_sql(order: str) -> str:
    return f"""SELECT user_id, event_id, event_type FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {order}) AS rn FROM events)
    WHERE rn = 1"""


def _events(spark, sf):
    return I.table(spark, sf, "events").select("user_id", "event_type", "event_id")


@query(_first_last_sql("ASC"))
def first_wins(spark, sf):
    return keyed.first_wins(_events(spark, sf), ["user_id", "event_type"], "event_id")


@query(_first_last_sql("DESC"))
def last_wins(spark, sf):
    return keyed.last_wins(_events(spark, sf), ["user_id", "event_type"], "event_id")


@query(
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (
      SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn
      FROM lineitem) WHERE rn <= 5"""
)
def top_n_per_group(spark, sf):
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    lines = I.table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    return keyed.top_n_per_group(lines, ["l_suppkey"], order, 5).drop("l_extendedprice")


# --- curation ---------------------------------------------------------------


def existing_records(spark, sf):
    """Labelled documents as the existing corpus."""
    posts = I.captions(spark, sf)
    gold = I.table(spark, sf, "labels").select(
        F.col("doc_id").alias("ord"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label")
    )
    return posts.join(gold, "ord").select(
        F.col("group_id").alias("post_id"),
        "caption",
        "image_path",
        "label",
        F.array(F.lit("gold")).alias("annotators"),
        F.lit(None).cast("double").alias("kappa"),
    )


EXISTING = f"""{I.CAPTIONS},
existing AS (
  SELECT group_id AS post_id, caption, image_path, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label
  FROM captions JOIN labels ON doc_id = ord)"""


@query(
    f"""WITH {EXISTING}, fresh AS (
      SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ord) AS rn FROM captions
      WHERE group_id NOT IN (SELECT post_id FROM existing))
    SELECT post_id, caption, image_path, label, 'gold' AS annotator FROM existing
    UNION ALL SELECT group_id, caption, image_path, {SQL_KEYWORD_LABEL}, 'weak_keywords' FROM fresh WHERE rn = 1"""
)
def bootstrap_merge(spark, sf):
    merged = C.bootstrap_merge(
        existing_records(spark, sf), I.grouped_posts(spark, sf), T.keyword_weak_label(F.col("caption"))
    )
    return merged.select(
        "post_id", "caption", "image_path", "label", F.array_join("annotators", ",").alias("annotator")
    )


def media_listing(spark, sf):
    """Files that exist: the media of posts whose media is present."""
    return I.captions(spark, sf).filter("media_ok").select(F.col("image_path").alias("path"))


_POS, _NEG = I.sql_keyword_counts("caption")


@query(
    f"""WITH {EXISTING}, usable AS (
      SELECT ord, group_id AS post_id, {I.sql_strip('caption')} AS caption, image_path FROM captions
      WHERE media_ok AND group_id NOT IN (SELECT post_id FROM existing)),
    first AS (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY ord) AS rn FROM usable WHERE length(caption) >= 4)
    SELECT post_id, caption, image_path, CASE WHEN {_POS} >= {_NEG} THEN 'positive_sarcasm' ELSE 'negative_sarcasm' END AS label
    FROM first WHERE rn = 1"""
)
def augment_weak_sarcasm(spark, sf):
    pos, neg = T.keyword_counts(F.col("caption"))
    added = C.augment_weak_sarcasm(
        existing_records(spark, sf), I.grouped_posts(spark, sf), media_listing(spark, sf), neg, pos
    )
    return added.select("post_id", "caption", "image_path", "label")


PRUNED = f"""{I.CAPTIONS}, {I.AUDIT}, done AS (SELECT post_id FROM audit WHERE annotator_id = 'u1'),
parts AS (
  SELECT post_id, CASE WHEN post_id IN (SELECT post_id FROM done) THEN 'kept' ELSE 'archived' END AS part,
         CASE WHEN post_id IN (SELECT post_id FROM done) OR NOT media_ok THEN image_path
              ELSE '/archive/pool/' || post_id || '.jpg' END AS image_path FROM captions)"""


@query(f"WITH {PRUNED} SELECT * FROM parts")
def prune_pool(spark, sf):
    kept, archived = C.prune_pool(
        I.pool(spark, sf),
        I.audit_log(spark, sf),
        "u1",
        archive_media_dir="/archive/pool",
        media=media_listing(spark, sf),
    )
    both = kept.withColumn("part", F.lit("kept")).unionByName(archived.withColumn("part", F.lit("archived")))
    return both.select("post_id", "part", "image_path")


@query(f"WITH {PRUNED} SELECT part, count(*) AS n FROM parts GROUP BY part")
def prune_counts(spark, sf):
    kept, archived = C.prune_pool(
        I.pool(spark, sf), I.audit_log(spark, sf), "u1", archive_media_dir="/archive/pool"
    )
    return C.prune_counts(kept, archived)


@query(
    f"""WITH {I.CAPTIONS} SELECT post_id, '/images/' || post_id || '.jpg' AS image_path, true AS changed,
      NOT media_ok AS dangling FROM captions"""
)
def rewrite_media_paths(spark, sf):
    """Paths with back-slashes and folders of their own, moved into one folder."""
    posts = I.captions(spark, sf).select(
        "post_id", F.replace("image_path", F.lit("/"), F.lit("\\")).alias("image_path")
    )
    moved = C.rewrite_media_paths(posts, "/images")
    present = media_listing(spark, sf).select(
        F.concat(F.lit("/images/"), C.base_name(F.col("path"))).alias("path")
    )
    dangling = C.dangling_media(moved, present).select("post_id", F.lit(True).alias("_d"))
    return moved.join(dangling, "post_id", "left").select(
        "post_id", "image_path", "changed", F.coalesce("_d", F.lit(False)).alias("dangling")
    )


@query(f"WITH {I.CAPTIONS} SELECT post_id, image_path FROM captions WHERE media_ok")
def usable_records(spark, sf):
    return C.usable_records(I.pool(spark, sf), media_listing(spark, sf)).select("post_id", "image_path")


@query(
    f"""WITH {I.CAPTIONS}, {I.SEEN} SELECT DISTINCT group_id AS post_id FROM captions
    WHERE group_id NOT IN (SELECT post_id FROM seen)"""
)
def append_new_ids(spark, sf):
    """New ids, sorted, appended to a text list and read back."""
    path = scratch_path(spark, "ignored")
    S.append_new_ids(I.grouped_posts(spark, sf), I.seen_posts(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("post_id"))


@query(
    """SELECT CAST(vec_id AS VARCHAR) AS post_id, CAST(label AS VARCHAR) AS label, 'old' AS version FROM embeddings
      WHERE label NOT IN (SELECT label FROM embeddings GROUP BY label HAVING min(vec_id) % 2 = 0)
    UNION ALL SELECT CAST(vec_id AS VARCHAR), CAST(label AS VARCHAR), 'new' FROM embeddings
      WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING min(vec_id) % 2 = 0)"""
)
def upsert_vectors(spark, sf):
    """Half of the label groups arrive again and replace their rows in the stored table."""
    path = scratch_path(spark, "vectors")
    base = I.table(spark, sf, "embeddings")
    chosen = base.groupBy("label").agg(F.min("vec_id").alias("m")).filter("m % 2 = 0").select("label")

    def rows(df, version):
        return df.select(
            F.col("vec_id").cast("string").alias("post_id"),
            F.col("label").cast("string").alias("label"),
            F.col("embedding").alias("image_emb"),
            F.col("embedding").alias("text_emb"),
            F.col("embedding").alias("T_hat_emb"),
            F.array(F.lit(version)).cast("array<float>").alias("discrepancy_vec"),
        )

    S.upsert_vectors(rows(base, 0.0), path)
    S.upsert_vectors(rows(base.join(chosen, "label", "left_semi"), 1.0), path)
    version = F.when(F.get("discrepancy_vec", F.lit(0)) == 1.0, "new").otherwise("old")
    return S.fetch_vectors(spark, path).select("post_id", "label", version.alias("version"))


@query("SELECT CAST(vec_id AS VARCHAR) AS post_id, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def fetch_vectors(spark, sf):
    path = scratch_path(spark, "vectors")
    same = [F.col("embedding").alias(c) for c in K.VECTOR_ROW_FIELDS[2:]]
    S.upsert_vectors(
        I.table(spark, sf, "embeddings").select(
            F.col("vec_id").cast("string").alias("post_id"), F.col("label").cast("string").alias("label"), *same
        ),
        path,
    )
    return S.fetch_vectors(spark, path).select("post_id", F.size("text_emb").alias("n"))


@query(
    """SELECT 'https://www.instagram.com/p/' || page_id || '/' AS link FROM pages
    WHERE (SELECT count(*) FROM pages WHERE url LIKE 'ftp:%') = 0"""
)
def spill_pending(spark, sf):
    pages = I.table(spark, sf, "pages")
    imported = pages.filter(F.col("url").startswith("ftp:"))
    return C.spill_pending(
        pages.select("page_id"), imported, H.post_url(F.col("page_id").cast("string"), F.lit("p"))
    )
