"""Admission of raw posts: language, spam, media and duplicates, in source order.

Every row first gets the verdict of its own content, a plain projection. Whether an id is
blocked by an earlier row is then decided by the first *blocking* verdict of that id, which is
an aggregate; no state is carried from row to row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegap.functions import text as T
from tonegap.operators.keyed import anti_seen, first_wins, settled, top_n_per_group

ACCEPTED = "accepted"


@dataclass(frozen=True)
class GateRules:
    """Differences between the three ways posts enter the pool."""

    allow_blank: bool = False
    require_caption: bool = False
    media_first: bool = False
    spam_blocks: bool = False
    sarcasm_only: bool = False


FEED = GateRules()
LOCAL = GateRules(allow_blank=True, media_first=True, spam_blocks=True)
EMBED = GateRules(require_caption=True, spam_blocks=True)


def verdicts(
    posts: DataFrame,
    rules: GateRules,
    *,
    media_ok: Column | None = None,
    face_ok: Column | None = None,
) -> DataFrame:
    """Replace ``caption`` by its clean form and add ``reason``, the row's own verdict.

    ``media_ok`` and ``face_ok`` must be stored columns, not fresh UDF calls: a UDF that is
    filtered on and projected is evaluated twice.

    What several checks of a caption share is a column of its own, or each word of a list would have the caption lower-cased again.
    """
    clean = posts.withColumn(
        "caption", T.preprocess_caption(F.coalesce(F.col("caption"), F.lit("")))
    )
    caption = F.col("caption")
    filled = caption != ""
    enough = T.is_script_enough(caption)
    if rules.allow_blank:
        enough = ~filled | enough
    judged = clean.withColumn("_enough", enough).withColumn("_lower", F.when(F.col("_enough"), F.lower(caption)))
    if rules.sarcasm_only:
        judged = judged.withColumn("_folded", F.when(F.col("_enough"), T.fold_case(caption)))
    no_media = F.lit(False) if media_ok is None else ~F.coalesce(media_ok, F.lit(False))

    steps: list[tuple[Column, str]] = []
    if rules.media_first:
        steps.append((no_media, "no_media"))
    if rules.require_caption:
        steps.append((~filled, "no_caption"))
    steps.append((~F.col("_enough"), "wrong_script"))
    steps.append((T.is_spam_caption(caption, F.col("_lower")), "spam"))
    if rules.sarcasm_only:
        steps.append((~T.is_sarcasm_candidate(caption, preprocessed=True, folded=F.col("_folded")), "not_sarcasm"))
    if not rules.media_first:
        steps.append((no_media, "no_media"))
    if face_ok is not None:
        steps.append((~F.coalesce(face_ok, F.lit(False)), "no_face"))

    reason = F.when(*_step(steps[0]))
    for step in steps[1:]:
        reason = reason.when(*_step(step))
    return settled(judged, "reason", reason.otherwise(ACCEPTED)).select(*[c for c in clean.columns if c != "reason"], "reason")


def _step(step: tuple[Column, str]) -> tuple[Column, Column]:
    return step[0], F.lit(step[1])


def blocking_reasons(rules: GateRules) -> list[str]:
    return [ACCEPTED, "no_face"] + (["spam"] if rules.spam_blocks else [])


def admit(
    judged: DataFrame, rules: GateRules, *, ord_col: str = "ord", key: str = "post_id"
) -> DataFrame:
    """Accepted rows: the first blocking row of an id, when that row itself was accepted."""
    candidates = judged.filter(F.col("reason").isin(*blocking_reasons(rules)))
    return first_wins(candidates, [key], ord_col).filter(F.col("reason") == ACCEPTED)


def gate(
    posts: DataFrame,
    rules: GateRules,
    *,
    seen: DataFrame | None = None,
    ord_col: str = "ord",
    media_ok: Column | None = None,
    face_ok: Column | None = None,
) -> DataFrame:
    """Known ids out first, then the content verdicts, then one row per id."""
    fresh = posts if seen is None else anti_seen(posts, seen)
    judged = verdicts(fresh, rules, media_ok=media_ok, face_ok=face_ok)
    return admit(judged, rules, ord_col=ord_col).drop("reason")


def newly_ignored(judged: DataFrame, key: str = "post_id") -> DataFrame:
    """Ids that go to the ignore list: spam captions and media without a face."""
    return judged.filter(F.col("reason").isin("spam", "no_face")).select(key).distinct()


def gate_counters(
    judged: DataFrame,
    rules: GateRules,
    *,
    seen: DataFrame | None = None,
    ord_col: str = "ord",
    key: str = "post_id",
) -> DataFrame:
    """Rows by final outcome. Only (id, order, reason) is shuffled, never the captions.

    The verdicts are read twice: pass a stored table, as a run that also writes the accepted
    rows and the ignore list has anyway.
    """
    rows = judged.select(key, ord_col, "reason")
    is_blocking = F.col("reason").isin(*blocking_reasons(rules))
    stops = rows.groupBy(key).agg(F.min(F.when(is_blocking, F.col(ord_col))).alias("_stop"))
    outcome = F.when(F.col(ord_col) > F.col("_stop"), "duplicate").otherwise(F.col("reason"))
    final = rows.join(stops, key).withColumn("reason", outcome)
    if seen is not None:
        known = seen.select(key).distinct().withColumn("_known", F.lit(True))
        final = final.join(known, key, "left").withColumn(
            "reason", F.when(F.col("_known"), "duplicate").otherwise(F.col("reason"))
        )
    return final.groupBy("reason").agg(F.count("*").alias("n"))


def limit_accepted(accepted: DataFrame, max_count: int, ord_col: str = "ord") -> DataFrame:
    return accepted.orderBy(ord_col).limit(max_count)


def head_n(df: DataFrame, n: int, ord_col: str = "ord") -> DataFrame:
    return df.orderBy(ord_col).limit(n)


def cap_per_source(
    df: DataFrame,
    source: str,
    *,
    per_source: int,
    max_sources: int | None = None,
    ord_col: str = "ord",
) -> DataFrame:
    """First ``per_source`` rows of each of the first ``max_sources`` sources."""
    if max_sources is not None:
        starts = df.groupBy(source).agg(F.min(ord_col).alias("_start"))
        chosen = starts.orderBy("_start").limit(max_sources).select(source)
        df = df.join(chosen, source, "left_semi")
    return top_n_per_group(df, [source], [F.col(ord_col)], per_source)


def photo_only(df: DataFrame, is_video: str = "is_video") -> DataFrame:
    return df.filter(~F.coalesce(F.col(is_video), F.lit(False)))


def visible_only(
    df: DataFrame,
    is_private: str = "is_private",
    followed: str = "followed",
    media_count: str = "media_count",
) -> DataFrame:
    """Accounts with posts that are public or followed."""
    hidden = F.col(is_private) & ~F.col(followed)
    return df.filter(~F.coalesce(hidden, F.lit(False)) & (F.col(media_count) > 0))


def filter_by_label(df: DataFrame, label: str | None = None) -> DataFrame:
    return df if label is None else df.filter(F.col("label") == label)


def media_type_ok(path: Column, mime: Column | None = None) -> Column:
    """Allowed by file suffix, or by media type when one is given."""
    from tonegap import constants as K

    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    ok = suffix.isin(*K.MEDIA_SUFFIXES)
    return ok if mime is None else ok | F.coalesce(F.lower(mime).isin(*K.MEDIA_MIME_TYPES), F.lit(False))
