"""URL rules as a sort-merge range join, in DataFrame functions only.

A rule is the prefix of a canonical key: the labels of its host in reverse order, each with a dot,
then its path. ``block example.org/es/`` is ``org.example./es/``, an interval of keys in byte order.
A url has one key per level of its host (``org.``, ``org.example.``, ...) with its whole path, so a
rule fits exactly if one of these keys lies in its interval. Intervals of prefixes are nested or
apart; a sweep over their ends in key order keeps the stack of open rules (the running depth) and
notes the innermost one, which is the longest. Keys and ends are then sorted together, and every key takes
over the note of the last end before it.

The sweep over keys runs in many parts of evenly dealt urls, each with a copy of the rules' ends, so a host with a
third of all urls is no larger part than any other.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: First "://", then host, then path.
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Parts of the sweep for each shuffle partition.
PARTS_EACH = 4


def url_host(url: Column) -> Column:
    """Host in lower case (A-Z); empty for null or a url without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    """Path from its slash to ``?``, ``#`` or the end; empty where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 2)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, path, verdict, ord) of (verdict, ``host/path``) pairs."""
    rows = [
        F.struct(
            F.lit(text.partition("/")[0]).alias("host"),
            F.lit("".join(text.partition("/")[1:])).alias("path"),
            F.lit(verdict).alias("verdict"),
            F.lit(k).alias("ord"),
        )
        for k, (verdict, text) in enumerate(rules)
    ]
    kind = "array<struct<host:string,path:string,verdict:string,ord:int>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(kind)))


def _key(labels: Column, path: Column) -> Column:
    """Reversed labels, each with a dot, then the path, as bytes."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("."), path).cast("binary")


def rule_ends(rules: DataFrame) -> DataFrame:
    """(key, top): both ends of every rule's interval with the innermost rule open from there on.

    ``top`` is a struct; its fields are null where no rule is open. A rule given twice counts as
    its first (by ``ord``); rules with a null part are none.
    """
    unique = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .groupBy("host", "path")
        .agg(F.min_by("verdict", "ord").alias("verdict"))
    )
    start = unique.select(
        _key(F.split("host", r"\."), F.col("path")).alias("start"),
        F.element_at(F.split("host", r"\."), -1).alias("tld"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        ).alias("own"),
    )
    ends = start.select(
        "tld",
        "own",
        F.inline(
            F.array(
                F.struct(F.col("start").alias("key"), F.lit(1).alias("step")),
                F.struct(F.concat("start", F.lit(b"\xff")).alias("key"), F.lit(-1).alias("step")),
            )
        ),
    )
    deep = ends.withColumn("depth", F.sum("step").over(Window.partitionBy("tld").orderBy("key")))
    opened = F.when(F.col("step") == 1, F.col("own"))
    level = Window.partitionBy("tld", "depth").orderBy("key")
    top = F.when(F.col("depth") > 0, F.last(opened, True).over(level))
    return deep.select("key", F.struct(top.alias("open")).alias("top"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, ...).

    The longest fitting rule decides (host and path counted together, then the longer host);
    ``default`` where none fits, with rule null. A null url, or one without ``://``, has an empty host and path
    and fits no rule. Repeated rows are judged alike, one result each; an empty table gives no rows; no
    rules leave the default. Further columns are ignored.
    """
    spark = pages.sparkSession
    parts = PARTS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = (
        pages.select("page_id", "url")
        .groupBy("page_id", "url")
        .agg(F.count("*").alias("copies"))
        .select("page_id", "url", "copies", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    )
    labels = F.split("host", r"\.")
    keys = urls.select(
        "page_id",
        "url",
        "copies",
        "host",
        "path",
        F.pmod(F.xxhash64("page_id", "url"), F.lit(parts)).cast("int").alias("part"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)),
                lambda n: _key(F.slice(labels, -n, n), F.col("path")),
            )
        ).alias("key"),
    )
    marks = rule_ends(rules).select("key", "top", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    sweep = Window.partitionBy("part").orderBy("key", F.col("copies").isNotNull())
    met = (
        keys.unionByName(marks, allowMissingColumns=True)
        .withColumn("open", F.last("top", True).over(sweep)["open"])
        .filter(F.col("copies").isNotNull())
    )
    best = met.groupBy("page_id", "url", "host", "path", "copies").agg(F.max("open").alias("best"))
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    ).drop("copy")
