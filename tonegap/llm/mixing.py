"""Mixing sources to target weights, in DataFrame functions only.

Words are added up per source, targets follow from weights, and a source's repetition rate is its target over its
words. A document is emitted floor(rate) times, and once more if a number in [0, 1) drawn from the digest of its id and
text is below the rest of the rate. Nothing but one row per document (id, source, size, draw) is ever stored, and
no document is shuffled: sources are summed map-side, and rates come back by a join whose strategy Spark picks by size.

Targets are shares of all words by weight. A target stops at ``most`` times the words of its source, and what is above
is shared again by weight among the others. Each round is one sum over the table of sources; rounds end when
no target is above, which takes a few, as every round moves to the crossing of a piecewise linear function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegap.llm.common import stored

#: White space between words.
GAP = r"\x20\x09-\x0D"
#: Hexadecimal digits of a draw; 13 of them fit a double exactly.
DIGITS = 13


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not white space; 0 for null. No array of words is built."""
    marks = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"[^{GAP}]+[{GAP}]*", "w")
    return F.length(F.regexp_replace(marks, f"^[{GAP}]+", "")).cast("long")


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on id and text alone."""
    own = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), own).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def source_sizes(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, weight) of a table (source, size): weights are dealt out in turn by code point, null last.

    Ranks are counted inside ranges of sources and shifted by the ranges before, so no task sees all of them.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = totals.repartitionByRange(F.asc_nulls_last("source")).withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "source-sizes")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = (
        ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("range").orderBy(F.asc_nulls_last("source"))
    rank = F.col("offset") + F.row_number().over(inside) - 1
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranged.join(offsets, "range").withColumn("rank", rank)
    return ranked.select("source", "source_size", turn.cast("long").alias("weight"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): the words the mix should take of each source.

    All targets add up to ``share`` of all words, or to ``most`` times all words if that is less. A source
    without words has target 0.
    """
    sources = stored(source_sizes(sized, weights), "source-weights")
    cap = F.col("source_size") * F.lit(float(most))
    whole = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rest, weight = float(share) * (whole.size or 0), whole.weight or 0
    capped = F.lit(False)
    while weight:
        wanted = F.col("weight") * F.lit(rest) / F.lit(float(weight))
        over = capped | (wanted > cap)
        fixed = sources.filter(over).agg(F.sum(cap).alias("size"), F.sum("weight").alias("weight")).first()
        left = float(share) * whole.size - (fixed.size or 0.0)
        now = whole.weight - (fixed.weight or 0)
        if now == weight:
            return sources.select("source", "source_size", F.when(over, cap).otherwise(wanted).alias("target"))
        capped, rest, weight = wanted > cap, left, now
    return sources.select("source", "source_size", cap.alias("target"))


def _copies() -> Column:
    """Times a document is emitted, of its ``rate`` and ``draw``."""
    whole = F.floor("rate")
    return F.coalesce(whole + (F.col("draw") < F.col("rate") - whole).cast("long"), F.lit(0).cast("long"))


def _with_rates(rows: DataFrame, targets: DataFrame) -> DataFrame:
    rated = targets.select(
        F.col("source").alias("rated"), "source_size", "target", F.try_divide("target", F.col("source_size").cast("double")).alias("rate")
    )
    joined = rows.join(rated, rows["source"].eqNullSafe(rated["rated"])).drop("rated")
    return joined.withColumn("copies", _copies())


def _sized(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(text).alias("size"),
        draw(F.col("doc_id"), text).alias("draw"),
    )


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row of ``docs`` (doc_id, text, source, ...).

    ``taken`` is ``copies`` times ``size``. Null and empty texts have size 0 and are taken with no words; rows of one source
    without any words are not emitted. A null source is a source. Rows that repeat both id and text are decided alike;
    a null id is like any other, so such rows are told apart by their text. An empty table gives no rows; further columns are ignored.
    """
    sized = stored(_sized(docs), "sized")
    rated = _with_rates(sized, source_targets(sized, weights, share, most))
    return rated.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix_plan`` says, with their own columns only."""
    targets = source_targets(stored(_sized(docs), "sized"), weights, share, most)
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias("source"), draw(F.col("doc_id"), text).alias("draw"))
    rated = _with_rates(rows, targets).filter("copies > 0")
    return rated.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")
