"""Queries for the annotation log, agreement and class structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.operators import annotation as A
from tonegap.operators import folds
from tonegap.operators.metrics import degenerate_features as degenerate
from tonegap.plans import inputs as I
from tonegap.plans.registry import query
from tonegap.session import cut_lineage, scratch_path
from tonegap.sources.lines import numbered_lines

MAJORITY = f"""{I.AUDIT},
per_label AS (SELECT post_id, label, count(*) AS votes, max(timestamp) AS newest FROM audit GROUP BY post_id, label),
timed AS (
  SELECT p.post_id, p.label, p.votes, p.newest, min(a.ord) AS early FROM per_label p
  JOIN audit a ON a.post_id = p.post_id AND a.label = p.label AND a.timestamp = p.newest
  GROUP BY p.post_id, p.label, p.votes, p.newest),
majority AS (
  SELECT post_id, label, votes FROM (
    SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY votes DESC, newest DESC, early) AS rn FROM timed) WHERE rn = 1),
annotators AS (
  SELECT post_id, string_agg(annotator_id, ',' ORDER BY annotator_id) AS annotators
  FROM (SELECT DISTINCT post_id, annotator_id FROM audit WHERE annotator_id IS NOT NULL) GROUP BY post_id)"""


@query(f"WITH {MAJORITY} SELECT * FROM majority")
def majority_label(spark, sf):
    return A.majority_label(I.audit_log(spark, sf))


@query(f"WITH {MAJORITY} SELECT * FROM annotators")
def annotators_of(spark, sf):
    named = I.audit_log(spark, sf).filter("annotator_id IS NOT NULL")
    return A.annotators_of(named).select("post_id", F.array_join("annotators", ",").alias("annotators"))


@query(
    f"""WITH {MAJORITY}, {I.CAPTIONS} SELECT post_id, caption, image_path, label, annotators
    FROM majority JOIN annotators USING (post_id) JOIN captions USING (post_id)"""
)
def canonical_join_pool(spark, sf):
    log = I.audit_log(spark, sf)
    return A.canonical_records(log, I.pool(spark, sf)).select(
        "post_id", "caption", "image_path", "label", F.array_join("annotators", ",").alias("annotators")
    )


@query(f"WITH {I.LATEST} SELECT * FROM latest")
def latest_annotation(spark, sf):
    return A.latest_annotation(I.audit_log(spark, sf))


@query(f"WITH {I.LATEST} SELECT annotator_id, count(*) AS n_posts FROM latest GROUP BY annotator_id")
def annotator_counts(spark, sf):
    return A.annotator_counts(A.latest_annotation(I.audit_log(spark, sf)))


PAIRS = f"""{I.LATEST},
pairs AS (
  SELECT a.post_id, a.annotator_id AS annotator_a, b.annotator_id AS annotator_b, a.label AS label_a, b.label AS label_b
  FROM latest a JOIN latest b ON a.post_id = b.post_id AND a.annotator_id < b.annotator_id),
pair_sizes AS (
  SELECT annotator_a, annotator_b, count(*) AS n, sum(CAST(label_a = label_b AS INTEGER)) AS agreed
  FROM pairs GROUP BY annotator_a, annotator_b),
side_a AS (SELECT annotator_a, annotator_b, label_a AS label, count(*) AS ca FROM pairs GROUP BY ALL),
side_b AS (SELECT annotator_a, annotator_b, label_b AS label, count(*) AS cb FROM pairs GROUP BY ALL),
chance AS (
  SELECT annotator_a, annotator_b, sum(ca * cb) AS s FROM side_a JOIN side_b USING (annotator_a, annotator_b, label)
  GROUP BY annotator_a, annotator_b),
kappas AS (
  SELECT annotator_a, annotator_b, n AS overlap,
         CASE WHEN coalesce(s, 0) >= n * n THEN 0
              ELSE CAST(agreed * n - coalesce(s, 0) AS DOUBLE) / (n * n - coalesce(s, 0)) END AS kappa
  FROM pair_sizes LEFT JOIN chance USING (annotator_a, annotator_b))"""


def _latest(spark, sf):
    return A.latest_annotation(I.audit_log(spark, sf))


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def annotator_pairs(spark, sf):
    return A.annotator_pairs(cut_lineage(_latest(spark, sf)), part_size=16)


@query(f"WITH {PAIRS} SELECT annotator_a, annotator_b, n AS overlap FROM pair_sizes")
def pair_overlap(spark, sf):
    return A.pair_overlap(A.label_pairs(cut_lineage(_latest(spark, sf))))


@query(f"WITH {PAIRS} SELECT annotator_a, annotator_b, overlap, {I.r6('kappa')} AS kappa FROM kappas")
def cohens_kappa(spark, sf):
    kappas = A.cohens_kappa(A.label_pairs(cut_lineage(_latest(spark, sf))))
    return kappas.select("annotator_a", "annotator_b", "overlap", I.rounded("kappa"))


def _sql_lines(section: int, lines) -> str:
    return f"SELECT {section} AS section, lpad(CAST(p AS VARCHAR), 4, '0') AS a, '' AS b, ({I.sql_list(lines)})[p + 1] AS line FROM range({len(lines)}) t(p)"


@query(
    f"""WITH {PAIRS}, lines AS (
      {_sql_lines(0, (*K.REPORT_TITLE, *K.REPORT_PAIRS_HEAD))}
      UNION ALL SELECT 1, annotator_a, annotator_b, printf('| %s | %s | %d | %.4f |', annotator_a, annotator_b, overlap, CAST(kappa AS DOUBLE)) FROM kappas
      UNION ALL {_sql_lines(2, K.REPORT_COUNTS_HEAD)}
      UNION ALL SELECT 3, annotator_id, '', printf('| %s | %d |', annotator_id, count(*)) FROM latest GROUP BY annotator_id)
    SELECT row_number() OVER (ORDER BY section, a, b) AS line_no, line FROM lines"""
)
def agreement_report(spark, sf):
    """The report as a file, read back line by line."""
    path = scratch_path(spark, "agreement")
    A.write_agreement_report(I.audit_log(spark, sf), path)
    return numbered_lines(spark, path).select(F.col("ord").cast("long").alias("line_no"), F.col("value").alias("line"))


@query(f"WITH {I.AUDIT} SELECT label, count(*) AS n FROM audit GROUP BY label")
def label_support(spark, sf):
    return A.label_support(I.audit_log(spark, sf))


@query(f"WITH {I.AUDIT} SELECT post_id, ord, label, {I.SQL_FOLD.replace('post_id', 'CAST(ord AS VARCHAR)')} AS fold FROM audit")
def stratified_folds(spark, sf):
    rows = I.audit_log(spark, sf).select("post_id", "ord", "label", F.col("ord").cast("string").alias("key"))
    return folds.stratified_folds(rows, key="key").drop("key")


@query(
    f"""WITH {I.AUDIT}, counts AS (SELECT label, count(*) AS n FROM audit GROUP BY label)
    SELECT label, n, {I.r6('(SELECT sum(n) FROM counts) / ((SELECT count(*) FROM counts) * n)')} AS weight FROM counts"""
)
def class_weights(spark, sf):
    return folds.class_weights(I.audit_log(spark, sf)).select("label", "n", I.rounded("weight"))


SQL_SPOILED = " UNION ALL ".join(
    f"SELECT {I.sql_text(c)} AS feature FROM spoiled HAVING min({c}) = max({c})" for c in K.FEATURE_NAMES
)


@query(f"WITH {I.FEATURES}, spoiled AS (SELECT * REPLACE (Fvt * 0 AS Fvt) FROM features) {SQL_SPOILED}")
def degenerate_features(spark, sf):
    """One feature is made constant; it must be the only one reported."""
    spoiled = I.features(spark, sf).withColumn("Fvt", F.col("Fvt") * 0.0)
    return degenerate(spoiled)
