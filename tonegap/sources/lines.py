"""Line-oriented files: numbered lines, JSON lines, id and term lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tonegap import constants as K
from tonegap.functions.html import extract_shortcode, link_kind
from tonegap.functions.text import strip_ws
from tonegap.operators.keyed import first_wins, last_wins, overlay, settled

POOL_SCHEMA = ST.StructType(
    [
        ST.StructField("post_id", ST.StringType()),
        ST.StructField("caption", ST.StringType()),
        ST.StructField("image_path", ST.StringType()),
    ]
)
AUDIT_SCHEMA = ST.StructType(
    [
        ST.StructField("post_id", ST.StringType()),
        ST.StructField("label", ST.StringType()),
        ST.StructField("annotator_id", ST.StringType()),
        ST.StructField("timestamp", ST.StringType()),
    ]
)


def natural_order(path: Column) -> Column:
    """A sort key of file names that compares runs of digits as numbers (part-99999 before part-100000)."""
    runs = F.split(path, r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")
    padded = F.transform(
        runs, lambda t: F.when(t.rlike(r"^\d+$"), F.lpad(t, 40, "0")).otherwise(t)
    )
    return F.array_join(padded, "")


def numbered_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``(file, line_no, ord, value)``: 1-based line numbers per file, and over all files in name order.

    A file is read in parallel splits. Lines are numbered inside a split by their row id, and
    each split is shifted by the line counts of the splits before it, a table with one row
    per split, which is broadcast so that no line is exchanged. No file has to pass through a single task.
    """
    raw = (
        spark.read.options(**options)
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_id"),
        )
    )
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    own = earlier(Window.partitionBy("file").orderBy("_split"))
    all_files = earlier(Window.orderBy(natural_order(F.col("file")), "file", "_split"))
    splits = (
        raw.groupBy("file", "_split")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(own), F.lit(0)))
        .withColumn("_all_before", F.coalesce(F.sum("_n").over(all_files), F.lit(0)))
        .drop("_n")
    )
    place = F.col("_id") - F.col("_first") + 1
    return raw.join(F.broadcast(splits), ["file", "_split"]).select(
        "file",
        (F.col("_before") + place).alias("line_no"),
        (F.col("_all_before") + place).alias("ord"),
        "value",
    )


def _filled(lines: DataFrame) -> DataFrame:
    return lines.withColumn("value", strip_ws(F.col("value"))).filter(F.col("value") != "")


def is_json(value: Column) -> Column:
    """Exactly one JSON value and nothing behind it.

    The JSON functions stop after the first value, so the line is read as the only element of
    an array. They also accept single quotes; lines that may hold such get the strict parser.
    """
    wrapped = F.concat(F.lit("["), value, F.lit("]"))
    single = F.coalesce(F.json_array_length(wrapped) == 1, F.lit(False))
    suspicious = value.rlike(r"[{\[,:]\s*'")
    return single & (~suspicious | F.try_parse_json(wrapped).isNotNull())


def strict_json(value: Column) -> Column:
    """The line itself; the job fails on a line that is not JSON."""
    return F.when(is_json(value), value).otherwise(
        F.raise_error(F.concat(F.lit("invalid JSON: "), value)).cast("string")
    )


def parsed_records(lines: DataFrame) -> DataFrame:
    """Append ``record``, the line as a map of texts (null when it is not a JSON object), once.

    Everything about a record, presence of keys included, is then a look-up in that map.
    """
    record = F.when(is_json(F.col("value")), F.from_json("value", "map<string,string>"))
    return settled(_filled(lines), "record", record)


def with_errors(lines: DataFrame) -> DataFrame:
    """Append ``record``, and ``error_field`` and ``error``: what makes a labelled record invalid.

    Checks run in order: JSON syntax, object, required fields in their fixed order, label.
    """
    record = F.col("record")
    label = F.try_element_at(record, F.lit("label"))
    absent = F.when(F.lit(False), F.lit(""))
    for name in K.REQUIRED_FIELDS:
        absent = absent.when(~F.map_contains_key(record, F.lit(name)), F.lit(name))
    known = F.coalesce(label.isin(*K.LABELS), F.lit(False))
    judged = parsed_records(lines).withColumn(
        "error_field",
        F.when(record.isNotNull(), F.coalesce(absent, F.when(~known, "label"))),
    )
    shape = F.when(is_json(F.col("value")), "record must be a JSON object").otherwise("invalid JSON")
    unknown = F.concat(
        F.lit("unknown label "),
        F.coalesce(label, F.lit("null")),
        F.lit(f"; expected one of {', '.join(K.LABELS)}"),
    )
    message = (
        F.when(record.isNull(), shape)
        .when(~F.map_contains_key(record, F.col("error_field")), "missing required field")
        .when(F.col("error_field") == "label", unknown)
    )
    return judged.withColumn("error", message)


def validate_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid lines, error table) of ``(file, line_no, value)``; blank lines are skipped."""
    judged = with_errors(lines)
    valid = judged.filter(F.col("error").isNull()).select(*lines.columns)
    errors = judged.filter(F.col("error").isNotNull()).select(
        "file", "line_no", "error_field", "error"
    )
    return valid, errors


def coerce_record(record: Column) -> dict[str, Column]:
    """Typed columns of one labelled record, given as a map of texts."""
    text = lambda name: F.try_element_at(record, F.lit(name))
    names = F.from_json(text("annotators"), "array<string>")
    return {
        "post_id": text("post_id"),
        "caption": text("caption"),
        "image_path": text("image_path"),
        "label": text("label"),
        "annotators": F.coalesce(names, F.array().cast("array<string>")),
        "kappa": text("kappa").cast("double"),
    }


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Strict reader: the job fails on the first invalid record, naming line and field."""
    judged = with_errors(numbered_lines(spark, path))
    message = F.concat(
        F.lit("[line "),
        F.col("line_no").cast("string"),
        F.coalesce(F.concat(F.lit(", field "), F.col("error_field")), F.lit("")),
        F.lit("] "),
        F.col("error"),
    )
    sound = F.when(F.col("error").isNull(), F.lit(True)).otherwise(
        F.raise_error(message).cast("boolean")
    )
    columns = coerce_record(F.col("record"))
    return judged.filter(sound).select(
        "ord", *[c.alias(name) for name, c in columns.items()]
    )


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """Strict reader of raw posts: a line that is not exactly one JSON value fails the job."""
    return _strict_rows(_filled(spark.read.text(path)), POOL_SCHEMA).select("row.*")


def _strict_rows(lines: DataFrame, schema: ST.StructType) -> DataFrame:
    """Append ``row``, the line parsed strictly."""
    parsed = F.from_json(strict_json(F.col("value")), schema, {"mode": "FAILFAST"})
    return lines.withColumn("row", parsed)


def read_checkpoint(spark: SparkSession, path: str, schema: ST.StructType) -> DataFrame:
    """Tolerant reader: broken lines and rows without id are dropped, the last row of an id wins."""
    lines = _filled(numbered_lines(spark, path)).filter(is_json(F.col("value")))
    parsed = lines.select("ord", F.from_json("value", schema).alias("row")).select("ord", "row.*")
    named = parsed.filter(F.coalesce(F.col("post_id"), F.lit("")) != "")
    return last_wins(named, ["post_id"]).drop("ord")


def read_ignore_list(spark: SparkSession, path: str) -> DataFrame:
    line = strip_ws(F.col("value"))
    return (
        spark.read.text(path)
        .select(line.alias("post_id"))
        .filter((F.col("post_id") != "") & ~F.col("post_id").startswith("#"))
        .distinct()
    )


def seen_ids(pool_lines: DataFrame, ignored: DataFrame) -> DataFrame:
    """Ids of the pool (``value`` holds JSON lines, broken ones are tolerated) and of the ignore list."""
    sound = pool_lines.filter(is_json(strip_ws(F.col("value"))))
    known = sound.select(F.get_json_object("value", "$.post_id").alias("post_id"))
    return known.filter(F.col("post_id").isNotNull()).unionByName(ignored.select("post_id")).distinct()


def read_term_specs(spark: SparkSession, path: str, *, search_all: bool = False) -> DataFrame:
    return parse_term_specs(numbered_lines(spark, path), search_all=search_all)


def parse_term_specs(lines: DataFrame, *, search_all: bool = False) -> DataFrame:
    """``(ord, term, search)``; a leading search marker asks for partial matching."""
    raw = F.col("value")
    rows = _filled(lines).filter(~raw.startswith("#"))
    marked = F.substring(raw, 1, 1).isin(*K.SEARCH_MARKERS)
    bare = F.when(marked, strip_ws(F.substring(raw, 2, 2**31 - 1))).otherwise(raw)
    term = strip_ws(F.regexp_replace(bare, "^#+", ""))
    return rows.select(
        "ord",
        term.alias("term"),
        (marked | F.lit(search_all)).alias("search"),
    ).filter(F.col("term") != "")


def read_account_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_accounts(numbered_lines(spark, path))


def parse_accounts(lines: DataFrame) -> DataFrame:
    rows = _filled(lines).filter(~F.col("value").startswith("#"))
    return rows.select("ord", F.regexp_replace("value", "^@+", "").alias("account"))


def read_link_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_links(numbered_lines(spark, path))


def parse_links(lines: DataFrame) -> DataFrame:
    """``(ord, shortcode, kind)`` of links or bare ids, first occurrence of each id."""
    refs = lines.select(
        "ord",
        extract_shortcode(F.col("value")).alias("shortcode"),
        link_kind(F.col("value")).alias("kind"),
    )
    return first_wins(refs.filter(F.col("shortcode").isNotNull()), ["shortcode"])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows; relative media paths are resolved against the manifest's folder."""
    folder = F.regexp_replace("file", "/[^/]*$", "")
    image = F.col("row.image_path")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return _strict_rows(_filled(lines), POOL_SCHEMA).select(
        strip_ws(F.col("row.post_id")).alias("post_id"),
        F.coalesce("row.caption", F.lit("")).alias("caption"),
        F.when(image.rlike("^([a-z0-9]+:)?/"), image)
        .otherwise(F.concat(folder, F.lit("/"), image))
        .alias("image_path"),
    )


def read_all_pools(spark: SparkSession, folder: str, current: DataFrame | None = None) -> DataFrame:
    """Every pool file but the test ones, later file names win, the current pool above all."""
    name = F.element_at(F.split("file", "/"), -1)
    by_name = natural_order(F.col("name"))
    lines = _filled(numbered_lines(spark, folder, pathGlobFilter="*.jsonl")).withColumn("name", name)
    rows = lines.filter(~F.col("name").startswith("test_")).select(
        F.struct(by_name.alias("key"), "name", "ord").alias("ord"),
        F.from_json(strict_json(F.col("value")), POOL_SCHEMA, {"mode": "FAILFAST"}).alias("row"),
    )
    merged = last_wins(rows.select("ord", "row.*"), ["post_id"]).drop("ord")
    return merged if current is None else overlay(merged, current.select(*merged.columns))


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Annotation events with their place in the log; empty when there is no log yet."""
    try:
        lines = _filled(numbered_lines(spark, path))
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], AUDIT_SCHEMA).withColumn("ord", F.lit(0).cast("long"))
    return _strict_rows(lines, AUDIT_SCHEMA).select("row.*", "ord")
