"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tonegap.session import scratch_path

#: Rows per Arrow batch, so that a batch of long texts stays far below a worker's memory.
BATCH_ROWS = 1000
#: Bytes a memo may hold before it starts afresh, what an entry takes besides its letters, and the longest key it keeps.
MEMO_BYTES, ENTRY_BYTES, MEMO_KEY = 16 << 20, 180, 256

U64 = np.uint64
_M1, _M2, _M3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(
    df: DataFrame,
    columns: list[str],
    schema: str | T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, object] | None]],
) -> DataFrame:
    """Map Arrow batches of the named columns to batches of ``schema``.

    ``make`` runs once per task and returns the function of a batch, which returns its columns
    by name (lists or Arrow arrays), or None for no rows. Batches are kept small.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    target = to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield pa.RecordBatch.from_arrays(
                    [
                        v.cast(field.type) if isinstance(v := out[field.name], pa.Array) else pa.array(v, field.type)
                        for field in target
                    ],
                    schema=target,
                )

    return df.select(*columns).mapInArrow(run, schema)


def with_scores(docs: DataFrame, make: Callable[[], Callable[[str | None], float]]) -> DataFrame:
    """(row, score): each row of ``docs`` whole, as a struct, beside the score of its text."""

    def batches():
        forget()  # what other stages left
        score = make()

        def work(batch):
            texts = pc.struct_field(batch.column("row"), "text").cast(pa.string())
            return {"row": batch.column("row"), "score": [score(t.as_py()) for t in texts]}

        return work

    source = docs.select(F.struct(*docs.columns).alias("row"))
    schema = T.StructType([source.schema["row"], T.StructField("score", T.DoubleType())])
    return arrow_map(source, ["row"], schema, batches)


def predictions(scored: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of rows with scores."""
    doc_id = F.col("row.doc_id").cast("long")
    return scored.select(
        doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def held_out(doc_id: Column | str, fold: int = 2, folds: int = 4) -> Column:
    """True for the rows no model may learn from: crc32 of the id as text, modulo ``folds``, is ``fold``."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit_labels(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label) of the rows a model may learn from.

    Rows without id or label are none; an id that is named more than once takes its largest label.
    """
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max(F.col(name).cast("string")).alias("label"))
    )


def labelled_sample(
    docs: DataFrame, known: DataFrame, per_label: int, max_chars: int
) -> tuple[list[tuple[int, str, str]], dict[str, int]]:
    """At most ``per_label`` (doc_id, text, label) per label, and how often each label occurs.

    Ids are picked in hash order among those of ``known`` (doc_id, label) that have a text, for all labels in one job; their texts are
    fetched with a broadcast of these ids, whose number is bounded by ``per_label`` and the labels. Of a text
    longer than ``max_chars`` one piece of that length is used, picked by the hash of its id; null and missing texts are never picked. Nothing but
    a fit uses the sample.
    """
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return [], counts
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    usable = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = usable.withColumn("place", place).filter(F.col("place") <= per_label).select("doc_id", "label").collect()
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, label string")
    pieces = F.ceil(F.length("text") / max_chars)
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(pieces, F.lit(1))) * max_chars + 1
    piece = F.substr("text", start.cast("int"), F.lit(max_chars))
    rows = texts.select("doc_id", piece.alias("text")).join(F.broadcast(ids), "doc_id").collect()
    return sorted({(r.doc_id, r.text, r.label) for r in rows}), counts


def _letters(x: object) -> int:
    return len(x) if isinstance(x, str | bytes) else 0


class Memo(dict):
    """A dict that computes missing values, keeps those of short keys, and forgets everything when it gets large."""

    def __init__(self, compute: Callable, most: int = MEMO_BYTES) -> None:
        self.compute, self.most, self.bytes = compute, most, 0

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= MEMO_KEY:
            self.bytes += ENTRY_BYTES + _letters(key) + _letters(value)
            if self.bytes > self.most:
                self.clear()
                self.bytes = ENTRY_BYTES + _letters(key) + _letters(value)
            self[key] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


_KEPT: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task, until it needs something of another name."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    _KEPT.clear()


def kept(name: str, compute: Callable) -> Memo:
    """A memo that a worker process keeps; ``compute`` must depend on its argument only."""
    return held(name, lambda: Memo(compute))


def word_hashes() -> Memo:
    return kept("words", xxhash.xxh3_64_intdigest)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def sequence_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` values; of the whole sequence if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.full(n - width + 1, U64(width))
    for j in range(width):
        out = mix(out * _M3 + hashes[j : n - width + 1 + j])
    return out


def shingle_set(text: str | None, width: int, memo: Memo) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words of a whole text."""
    words = words_of(text)
    hashes = np.fromiter(map(memo.__getitem__, words), dtype=U64, count=len(words))
    return np.unique(sequence_hashes(hashes, width))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
