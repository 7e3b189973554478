"""The queries of this subpackage, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegap.llm import alignment, archives, bpe, decontamination, extraction, hard_negatives, language, minhash, mixing, neighbours, quality, toxicity, url_rules
from tonegap.llm.common import read_table
from tonegap.plans.registry import Build, Query

QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    def register(build: Build) -> Build:
        QUERIES[build.__name__] = Query(build.__name__, build, sql)
        return build

    return register


@query()
def op1_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf, "documents"), words=2, percent=80)


#: The rules of the query, in order.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


@query(
    r"""
    WITH u AS (
      SELECT row_number() OVER () AS k, page_id,
             translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
      FROM pages),
    r(verdict, rhost, rpath) AS (VALUES
      ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
      ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    m AS (
      SELECT k, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
             arg_max(verdict, length(rhost || rpath)) AS verdict
      FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
      GROUP BY k)
    SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict
    FROM u LEFT JOIN m USING (k)
    """
)
def op7_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.judge_urls(read_table(spark, sf, "pages"), url_rules.rule_table(spark, URL_RULES))


#: The tokenizer file of the query.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op4_bpe_codec(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(read_table(spark, sf, "documents"), tokenizer_path()))


@query()
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, read_table(spark, sf, "labels")))


@query()
def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return quality.score_quality(docs, quality.fit(docs, read_table(spark, sf, "labels")))


@query()
def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return language.identify_language(docs, language.fit(docs))


@query()
def op10_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf, "embeddings"), every=20, top=20)


@query()
def op8_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extract_text(read_table(spark, sf, "pages"))


@query(
    r"""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
    FROM m
    """
)
def op2_warc_members(spark: SparkSession, sf: str) -> DataFrame:
    return archives.archive_round_trip(read_table(spark, sf, "pages"), spark)


@query()
def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


@query(
    r"""
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT
               / 4503599627370496::DOUBLE AS draw
      FROM documents),
    t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (
      SELECT *, 2 * source_size AS cap,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
      FROM t),
    f AS (
      SELECT *, row_number() OVER filling AS place,
             1.5::DOUBLE * (SELECT sum(source_size) FROM t)::DOUBLE - (sum(cap) OVER filling - cap)::DOUBLE AS rest,
             (SELECT sum(weight) FROM w)::DOUBLE - (sum(weight) OVER filling - weight)::DOUBLE AS weights
      FROM w WINDOW filling AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT arg_min(rest, place) AS rest, arg_min(weights, place) AS weights FROM f WHERE weight * rest / weights <= cap),
    s AS (SELECT source, source_size, least(cap::DOUBLE, weight * rest / weights) AS target
          FROM w, l)
    SELECT doc_id, size, source_size, target,
           CASE WHEN source_size = 0 THEN 0
                ELSE size * (floor(target / source_size)
                     + (draw < target / source_size - floor(target / source_size))::INT) END::BIGINT AS taken
    FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
    """
)
def op11_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_plan(read_table(spark, sf, "documents")).drop("copies")


@query(
    """
    WITH e AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score
      FROM e AS a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
    p AS (
      SELECT anchor_id, id AS positive_id, score AS positive_score
      FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id,
           (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
    """
)
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved))


@query()
def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    paths = [tokenizer_path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.alignment_counts(read_table(spark, sf, "documents"), *paths)
