"""Token tables ``(post_id, pos, token, score)`` prepared for display."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.functions.text import strip_ws
from tonegap.operators.keyed import group_stats_join, settled


def is_anchor(token: Column) -> Column:
    return token.isin(*K.ANCHOR_TOKENS)


def clean_token(token: Column) -> Column:
    """Token without its sub-word marker; a lone sentence-piece marker is a space."""
    piece = F.substring(token, 2, 2**31 - 1)
    return (
        F.when(token.startswith(K.SENTENCEPIECE_PREFIX), F.when(piece == "", " ").otherwise(piece))
        .when(token.startswith(K.CONTINUATION_PREFIX), F.substring(token, 3, 2**31 - 1))
        .otherwise(token)
    )


def rtl_remap(tokens: DataFrame, key: str = "post_id") -> DataFrame:
    """Reverse the block between leading and trailing anchors; scores move, never change."""
    content = F.when(~is_anchor(F.col("token")), F.col("pos"))
    placed = group_stats_join(tokens, [key], _first=F.min(content), _last=F.max(content))
    inside = F.col("pos").between(F.col("_first"), F.col("_last"))
    flipped = F.when(inside, F.col("_first") + F.col("_last") - F.col("pos")).otherwise(F.col("pos"))
    return placed.withColumn("pos", flipped).drop("_first", "_last").select(*tokens.columns)


def pair_tokens(tokens: Column, scores: Column) -> Column:
    """Array of (token, score); fails when the two arrays differ in length."""
    pairs = F.zip_with(
        tokens, scores, lambda t, s: F.struct(t.alias("tokens"), s.cast("double").alias("scores"))
    )
    differ = F.raise_error(F.lit("tokens and scores differ in number"))
    return F.when(F.size(tokens) == F.size(scores), pairs).otherwise(
        differ.cast("array<struct<tokens:string,scores:double>>")
    )


def strip_anchors(tokens: DataFrame, key: str = "post_id") -> DataFrame:
    """Drop anchor tokens, except in a post that has nothing else.

    Words pass without any shuffle; only the few anchors are matched against the ids of the
    posts that have words.
    """
    anchor = is_anchor(F.col("token"))
    words = tokens.filter(~anchor)
    bare = tokens.filter(anchor).join(words.select(key).distinct(), key, "left_anti")
    return words.unionByName(bare.select(*tokens.columns))


# --- a post as one row: arrays of (pos, token, score) in order of position ------------------------


def token_arrays(tokens: DataFrame, key: str = "post_id") -> DataFrame:
    """(key, items): the tokens of a post in order. A post is as long as its model's sequence."""
    rest = [c for c in tokens.columns if c not in (key, "pos")]
    items = F.array_sort(F.collect_list(F.struct("pos", *rest)))
    return tokens.groupBy(key).agg(items.alias("items"))


def remapped(items: Column) -> Column:
    """The block between leading and trailing anchors reversed."""
    content = F.transform(F.filter(items, lambda t: ~is_anchor(t["token"])), lambda t: t["pos"])
    first, last = F.array_min(content), F.array_max(content)
    flip = lambda t: F.when(t["pos"].between(first, last), first + last - t["pos"]).otherwise(t["pos"])
    return F.array_sort(F.transform(items, lambda t: F.struct(flip(t).alias("pos"), t["token"].alias("token"), t["score"].alias("score"))))


def without_anchors(items: Column) -> Column:
    """Words only; all items where there are no words."""
    words = F.filter(items, lambda t: ~is_anchor(t["token"]))
    return F.when(F.size(words) > 0, words).otherwise(items)


def merged(items: Column) -> Column:
    """Words (start, text, score): pieces are cut where one starts that doesn't continue what is before it.

    One pass: the places of the starts are the bounds of slices. Pieces before the first start form a word too.
    """
    attach = f"^[{re.escape(K.ATTACH_CHARS)}]+$"
    pieces = F.transform(
        items,
        lambda t: F.struct(
            t["pos"].alias("pos"),
            clean_token(t["token"]).alias("piece"),
            t["score"].alias("score"),
            t["token"].startswith(K.CONTINUATION_PREFIX).alias("continues"),
        ),
    )
    shown = F.filter(pieces, lambda p: strip_ws(p["piece"]) != "")
    starts = lambda p: ~(p["continues"] | p["piece"].rlike(attach))

    def words(pieces: Column) -> Column:
        opened = F.filter(F.transform(pieces, lambda p, i: F.when(starts(p) | (i == 0), i)), lambda i: i.isNotNull())
        return _let(
            opened,
            lambda bounds: F.transform(
                bounds,
                lambda b, k: _let(
                    F.slice(pieces, b + 1, F.coalesce(F.get(bounds, k + 1), F.size(pieces)) - b),
                    lambda own: F.struct(
                        F.get(own, F.lit(0))["pos"].alias("start"),
                        F.array_join(F.transform(own, lambda p: p["piece"]), "").alias("text"),
                        F.array_max(F.transform(own, lambda p: p["score"])).alias("score"),
                    ),
                ),
            ),
        )

    return _let(shown, words)


def scaled(words: Column) -> Column:
    """Words with ``normalized``: scores scaled to [0, 1], 0.0 where there is no spread."""
    scores = F.transform(words, lambda w: w["score"])
    return _let(
        F.struct(F.array_min(scores).alias("lo"), F.array_max(scores).alias("hi")),
        lambda s: F.transform(
            words,
            lambda w: w.withField(
                "normalized", F.when(s["hi"] > s["lo"], (w["score"] - s["lo"]) / (s["hi"] - s["lo"])).otherwise(F.lit(0.0))
            ),
        ),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge_tokens(tokens: DataFrame, key: str = "post_id") -> DataFrame:
    """Join continuation pieces and pure punctuation to the word before them; the long form of ``merged``."""
    words = token_arrays(tokens.select(key, "pos", "token", "score"), key).select(key, F.inline(merged(F.col("items"))))
    return words.select(key, "start", "text", "score")


def minmax_normalize(
    df: DataFrame, score: str = "score", keys: tuple[str, ...] = ("post_id",)
) -> DataFrame:
    """Scores scaled to [0, 1] per post; a post without any spread gets 0.0."""
    spread = group_stats_join(df, list(keys), _lo=F.min(score), _hi=F.max(score))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span > 0, (F.col(score) - F.col("_lo")) / span).otherwise(F.lit(0.0))
    return spread.withColumn("normalized", scaled).drop("_lo", "_hi")


def word_heatmap(
    tokens: DataFrame, *, key: str = "post_id", remap: bool = False, hide_anchors: bool = True
) -> DataFrame:
    """Display table: optional remap, anchors hidden, pieces merged, scores scaled. One exchange, which gathers a post."""
    gathered = token_arrays(tokens.select(key, "pos", "token", "score"), key)
    if remap:
        gathered = gathered.withColumn("items", remapped(F.col("items")))
    if hide_anchors:
        gathered = gathered.withColumn("items", without_anchors(F.col("items")))
    words = settled(gathered, "words", merged(F.col("items")))
    return words.select(key, F.inline(scaled(F.col("words"))))
