"""Growing, pruning and repairing the pool and the labelled corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.functions.text import min_text_len, strip_ws
from tonegap.operators.keyed import anti_seen, first_wins, top_n_per_group
from tonegap.session import cut_lineage


def union_sources(feeds: list[DataFrame], ord_col: str = "ord") -> DataFrame:
    """Feeds one after the other: ``feed`` is the position of the feed, then its own order."""
    tagged = [df.withColumn("feed", F.lit(i)) for i, df in enumerate(feeds)]
    return reduce(DataFrame.unionByName, tagged).withColumn(
        "source_ord", F.struct("feed", F.col(ord_col))
    )


def bootstrap_merge(
    existing: DataFrame,
    pool: DataFrame,
    label: Column,
    annotator: str = K.WEAK_KEYWORD_ANNOTATOR,
    ord_col: str = "ord",
) -> DataFrame:
    """Existing records stay; first rows of new ids join with a weak label."""
    fresh = first_wins(anti_seen(pool, existing), ["post_id"], ord_col)
    weak = F.when(label.isin(*K.LABELS), label).otherwise("neutral")
    added = fresh.select(
        "post_id",
        "caption",
        "image_path",
        weak.alias("label"),
        F.array(F.lit(annotator)).alias("annotators"),
        F.lit(None).cast("double").alias("kappa"),
    )
    return existing.select(*added.columns).unionByName(added)


def augment_weak_sarcasm(
    existing: DataFrame,
    pool: DataFrame,
    media: DataFrame,
    p_neg: Column,
    p_pos: Column,
    *,
    collapse: bool = True,
    min_len: int = 4,
    ord_col: str = "ord",
) -> DataFrame:
    """New sarcasm records from pool posts with media and enough text."""
    named = pool.filter(F.coalesce(F.col("post_id"), F.lit("")) != "")
    usable = (
        anti_seen(named, existing)
        .join(media.select(F.col("path").alias("image_path")), "image_path", "left_semi")
        .withColumn("caption", strip_ws(F.coalesce(F.col("caption"), F.lit(""))))
        .filter(min_text_len(F.col("caption"), min_len))
    )
    if collapse:
        usable = first_wins(usable, ["post_id"], ord_col)
    return usable.select(
        "post_id",
        "caption",
        "image_path",
        F.when(p_pos >= p_neg, "positive_sarcasm").otherwise("negative_sarcasm").alias("label"),
        F.array(F.lit(K.WEAK_SARCASM_ANNOTATOR)).alias("annotators"),
        F.lit(None).cast("double").alias("kappa"),
    )


def prune_pool(
    pool: DataFrame,
    log: DataFrame,
    annotator: str,
    *,
    archive_media_dir: str,
    media: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): posts this annotator labelled stay, the rest is archived.

    Archived rows point into the archive folder when their media exists. The ids of the
    archived rows are what joins the ignore list.
    """
    done = log.filter(F.col("annotator_id") == annotator).select("post_id")
    kept = pool.join(done, "post_id", "left_semi")
    archived = pool.join(done, "post_id", "left_anti")
    moved = F.concat(F.lit(archive_media_dir.rstrip("/") + "/"), base_name(F.col("image_path")))
    if media is None:
        return kept, archived.withColumn("image_path", moved)
    present = media.select(F.col("path").alias("image_path")).distinct()
    flagged = archived.join(present.withColumn("_there", F.lit(True)), "image_path", "left")
    return kept, flagged.withColumn(
        "image_path", F.when(F.col("_there"), moved).otherwise(F.col("image_path"))
    ).drop("_there").select(*pool.columns)


def prune_counts(kept: DataFrame, archived: DataFrame) -> DataFrame:
    """The dry run: how many rows would be archived and kept."""
    parts = [(archived, "archived"), (kept, "kept")]
    tagged = [df.select(F.lit(name).alias("part")) for df, name in parts]
    return tagged[0].unionByName(tagged[1]).groupBy("part").agg(F.count("*").alias("n"))


def base_name(path: Column) -> Column:
    """Last path component; back-slashes count as separators, trailing ones are ignored."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", "")
    return F.regexp_extract(plain, "([^/]*)$", 1)


def rewrite_media_paths(records: DataFrame, media_dir: str) -> DataFrame:
    """Point every reference into one folder; ``changed`` tells which rows moved."""
    path = F.col("image_path")
    target = F.concat(F.lit(media_dir.rstrip("/") + "/"), base_name(path))
    new = F.when(path == "", path).otherwise(target)
    return records.withColumn("changed", new != path).withColumn("image_path", new)


def dangling_media(records: DataFrame, media: DataFrame) -> DataFrame:
    """References to files that do not exist."""
    present = media.select(F.col("path").alias("image_path"))
    named = records.filter(F.coalesce(F.col("image_path"), F.lit("")) != "")
    return named.join(present, "image_path", "left_anti")


def usable_records(records: DataFrame, media: DataFrame) -> DataFrame:
    return records.join(media.select(F.col("path").alias("image_path")), "image_path", "left_semi")


#: Letters of the grams that tags are indexed by, and parts into which the tags of one gram are dealt.
GRAM, SALTS = 3, 16


def grams(text: Column, n: Column | int) -> Column:
    """The distinct runs of ``n`` letters; none of a shorter text."""
    n = F.lit(n) if isinstance(n, int) else n
    places = F.sequence(F.lit(1), F.length(text) - n + 1)
    runs = F.array_distinct(F.transform(places, lambda i: F.substr(text, i, n)))
    return F.when(F.length(text) >= n, runs).otherwise(F.array().cast("array<string>"))


def expand_terms(
    specs: DataFrame, catalogue: DataFrame, max_tags: int | None = None, salts: int = SALTS
) -> DataFrame:
    """Concrete tags for term specs ``(ord, term, search)`` from ``catalogue (ord, tag)``.

    A search term becomes every tag that contains it, or the first ``max_tags`` of them if a caller asks for that.

    Tags are indexed by their grams of three letters (of one or two, if there are terms that short), as far as a term has the gram. Each
    term looks up its rarest gram only and what it finds is verified. A tag has about as many grams as letters, whatever
    the terms. Tags of one gram are dealt out over ``salts`` keys and the terms, few, are repeated for each, so a gram that many
    tags hold is no single key. The tags are stored once: counting grams and looking them up are two reads.
    """
    term = F.lower(strip_ws(F.regexp_replace("term", "^#+", "")))
    searches = specs.filter("search").withColumn("_needle", term).filter(F.col("_needle") != "")
    tags = cut_lineage(
        first_wins(catalogue, ["tag"]).select(F.col("ord").alias("tag_ord"), "tag", F.lower("tag").alias("_low"))
    )
    size = F.least(F.length("_needle"), F.lit(GRAM))
    needles = searches.select("_needle", size.alias("_n")).distinct()
    asked = needles.select("_needle", F.explode(grams(F.col("_needle"), F.col("_n"))).alias("_gram"))
    used = needles.agg(F.collect_set("_n")).scalar()  # at most GRAM numbers
    indexed = F.flatten(
        F.array(*[F.when(F.array_contains(used, n), grams(F.col("_low"), n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1)])
    )
    salt = F.pmod(F.xxhash64("tag"), F.lit(salts)).cast("int").alias("_salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    postings = tags.select("tag", "tag_ord", "_low", salt, F.explode(indexed).alias("_gram"))
    counted = postings.join(asked.select("_gram", every).distinct(), ["_gram", "_salt"], "left_semi").groupBy("_gram").agg(F.count("*").alias("_tags"))
    rarest = (
        asked.join(counted, "_gram", "left")
        .groupBy("_needle")
        .agg(F.min(F.struct(F.coalesce("_tags", F.lit(0)).alias("_tags"), "_gram")).alias("_best"))
        .select("_needle", F.col("_best._gram").alias("_gram"))
    )
    probes = rarest.select("_needle", "_gram", every)
    matched = postings.join(probes, ["_gram", "_salt"]).filter(F.contains("_low", "_needle"))
    hits = matched.select("_needle", "tag", "tag_ord").join(searches.select("ord", "_needle"), "_needle").select("ord", "tag", "tag_ord")
    found = hits if max_tags is None else top_n_per_group(hits, ["ord"], [F.col("tag_ord")], max_tags)
    plain = specs.join(found.select("ord"), "ord", "left_anti").select(
        "ord", F.col("term").alias("tag"), F.lit(0).cast("long").alias("tag_ord")
    )
    ordered = found.select("ord", "tag", F.col("tag_ord").cast("long")).unionByName(plain)
    ranked = ordered.withColumn("source_ord", F.struct("ord", "tag_ord"))
    unique = first_wins(ranked.withColumn("_key", F.lower("tag")), ["_key"], "source_ord")
    return unique.select("ord", "tag_ord", "tag")


def tag_catalogue(tagged: DataFrame, tags: Column, ord_col: str = "ord") -> DataFrame:
    """Distinct tags of a corpus with the place of their first use."""
    each = tagged.select(F.col(ord_col).alias("_row"), F.posexplode(tags).alias("_pos", "tag"))
    first = each.groupBy("tag").agg(F.min(F.struct("_row", "_pos")).alias("ord"))
    return first.select("tag", "ord")


def spill_pending(refs: DataFrame, imported: DataFrame, url: Column) -> DataFrame:
    """Links of candidates to retry; empty as soon as anything was imported."""
    n_imported = imported.agg(F.count("*")).scalar()
    return refs.filter(n_imported == 0).select(url.alias("link"))


def first_per_label(records: DataFrame, ord_col: str = "ord") -> DataFrame:
    """First record of every label, in canonical label order."""
    position = F.array_position(F.array(*[F.lit(x) for x in K.LABELS]), F.col("label"))
    return first_wins(records.filter(F.col("label").isin(*K.LABELS)), ["label"], ord_col).orderBy(
        position
    )
