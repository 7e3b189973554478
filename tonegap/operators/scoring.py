"""Pluggable batch scorers and the resumable stages that call them.

A scorer is any ``Iterator[pandas.DataFrame] -> Iterator[pandas.DataFrame]``. Its model is
loaded once per Python worker, outside the batch loop, and each stage is a Spark job of its
own, so only one model is resident at a time.
"""

from __future__ import annotations

import logging
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.pandas.types import to_arrow_schema

from tonegap import constants as K
from tonegap.functions import text as T
from tonegap.functions import vectors as V
from tonegap.operators.keyed import anti_seen, settled

log = logging.getLogger(__name__)

Batches = Iterator[pd.DataFrame]

#: Bytes that the rows of one frame take in Arrow, about; a frame has a row at least.
FRAME_BYTES = 2 << 20


@dataclass(frozen=True)
class Scorer:
    """``fn`` receives ``inputs`` next to the key and must yield key + ``output`` columns."""

    name: str
    inputs: tuple[str, ...]
    output: str
    fn: Callable[[Batches], Batches]


_REGISTRY: dict[str, Scorer] = {}


def register_scorer(scorer: Scorer) -> Scorer:
    _REGISTRY[scorer.name] = scorer
    return scorer


def get_scorer(name: str) -> Scorer:
    return _REGISTRY[name]


def _frames(batches: Iterator[pa.RecordBatch]) -> Batches:
    """Arrow batches as frames of bounded size: a batch is cut without a copy, and only the rows of a frame become Python objects."""
    for batch in batches:
        rows = max(1, batch.num_rows * FRAME_BYTES // max(batch.nbytes, FRAME_BYTES))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).to_pandas()


def map_frames(df: DataFrame, fn: Callable[[Batches], Batches], schema: ST.StructType) -> DataFrame:
    """``mapInPandas`` over frames whose size follows their bytes, whatever the session's rows a batch."""
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(_frames(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=target, preserve_index=False)

    return df.mapInArrow(run, schema)


def run_scorer(df: DataFrame, scorer: Scorer, key: str = "post_id") -> DataFrame:
    """Only the key and the scorer's inputs cross to Python."""
    slim = df.select(key, *scorer.inputs)
    return map_frames(slim, scorer.fn, ST.StructType([slim.schema[key], *ST.StructType.fromDDL(scorer.output)]))


def score_media_text(media: DataFrame, scorer: Scorer, key: str = "post_id") -> DataFrame:
    """Media to description: ``(key, generated)``, cleaned."""
    return run_scorer(media, scorer, key).select(
        key, T.clean_generated_text(F.col("generated")).alias("generated")
    )


def score_text_vector(texts: DataFrame, scorer: Scorer, key: str = "post_id") -> DataFrame:
    """Text to vector: blank text is embedded as a single dot, non-finite entries become 0."""
    text = scorer.inputs[0]
    filled = F.coalesce(F.nullif(T.strip_ws(F.col(text)), F.lit("")), F.lit("."))
    scored = run_scorer(texts.withColumn(text, filled), scorer, key)
    return scored.select(key, V.sanitize_vector(F.col("vector")).alias("vector"))


def score_media_vector(media: DataFrame, scorer: Scorer, key: str = "post_id") -> DataFrame:
    """Media to unit vector."""
    scored = run_scorer(media, scorer, key)
    return scored.select(
        key, V.sanitize_vector(V.l2_normalize(F.col("vector"))).alias("vector")
    )


def polarity_from_logits(logits: Column, id2label: Column) -> Column:
    return V.canonicalize_polarity(V.renormalize_probs(V.softmax(logits)), id2label)


def keyword_polarity(text: Column) -> Column:
    """Native scorer: (p_neg, p_pos) from keyword counts, no Python involved."""
    return V.keyword_polarity(*T.keyword_counts(text))


def score_with_fallback(
    posts: DataFrame, load: Callable[[], Callable[[DataFrame], DataFrame]]
) -> DataFrame:
    """Weak labels by a model, or by keywords when it cannot be loaded.

    ``load`` returns a DataFrame -> DataFrame that adds ``weak_label``. The annotator name
    records which way was taken.
    """
    try:
        scored = load()(posts)
        name = K.WEAK_MODEL_ANNOTATOR
    except Exception as exc:  # any load failure means keywords
        log.warning("model unavailable (%s); using keywords", exc)
        scored = posts.withColumn("weak_label", T.keyword_weak_label(F.col("caption")))
        name = K.WEAK_KEYWORD_ANNOTATOR
    return scored.withColumn("annotator", F.lit(name))


def media_predicate(
    media: DataFrame, detector: Callable[[pd.Series], pd.Series], content: str = "content"
) -> DataFrame:
    """``(path, keep)`` from an injected detector over file contents.

    Write the result before filtering on it, or the detector runs twice.
    """
    detect = F.pandas_udf(detector, ST.BooleanType())
    return media.select("path", detect(F.col(content)).alias("keep"))


def read_stage(spark: SparkSession, path: str) -> DataFrame | None:
    """A stage table, or None before its first run."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def pending_stage(records: DataFrame, done: DataFrame | None, key: str = "post_id") -> DataFrame:
    return records if done is None else anti_seen(records, done, key)


def run_stage(
    records: DataFrame,
    path: str,
    score: Callable[[DataFrame], DataFrame],
    key: str = "post_id",
) -> DataFrame:
    """Score what the stage table lacks, append it, return the whole table.

    An interrupted run leaves only committed tasks behind, and the next run picks up the rest.
    """
    spark = records.sparkSession
    done = read_stage(spark, path)
    score(pending_stage(records, done, key)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def missing_upstream(records: DataFrame, stage: DataFrame, key: str = "post_id") -> DataFrame:
    return anti_seen(records, stage, key).select(key)


def require_complete(
    records: DataFrame, stage: DataFrame, name: str, key: str = "post_id"
) -> DataFrame:
    """Records unchanged, or an error with the count and three ids that lack ``name``."""
    missing = missing_upstream(records, stage, key)
    first = [row[0] for row in missing.orderBy(key).limit(3).collect()]
    if first:
        raise RuntimeError(
            f"{name} stage incomplete: {missing.count()} record(s) missing (e.g. {first})"
        )
    return records


def lookup_text_vectors(images: DataFrame, texts: DataFrame, key: str = "post_id") -> DataFrame:
    """Image stage: similarities of image vectors with the stored text vectors."""
    joined = images.join(texts, key)
    t, h, i = F.col("emb_T"), F.col("emb_T_hat"), F.col("emb_I")
    return joined.select(
        key,
        V.dsem(t, h).alias("Dsem"),
        V.fvt(i, h).alias("Fvt"),
        V.cosine_similarity(t, i).alias("cos_TI"),
    )


def assemble_features(
    records: DataFrame, vectors: DataFrame, polarity: DataFrame, key: str = "post_id"
) -> DataFrame:
    """Records with both stages, as ``(key, label, six features)``."""
    both = records.select(key, "label").join(vectors, key).join(polarity, key)
    return both.select(
        key,
        "label",
        "Dsem",
        V.polarity_l1(F.col("pol_T"), F.col("pol_T_hat")).alias("Dsen"),
        "Fvt",
        "cos_TI",
        V.polarity_scalar(F.col("pol_T")).alias("polarity_T"),
        V.polarity_scalar(F.col("pol_T_hat")).alias("polarity_T_hat"),
    )


#: Bits of the filter of wanted paths (512 KB), and those of one of its rows.
FILTER_BITS, ROW_BITS = 1 << 22, 1 << 15


def _side_by_side(scorers: list[Scorer], batches: Batches) -> Iterator[tuple[pd.DataFrame, list[pd.DataFrame]]]:
    """Batches with what each scorer makes of them; a scorer gives one frame a batch, with a row for each of its keys.

    Every scorer keeps its own loop, and so its model, over all batches.
    """
    fed: list[deque] = [deque() for _ in scorers]

    def drained(queue: deque) -> Batches:
        while True:
            yield queue.popleft()

    runs = [s.fn(drained(queue)) for s, queue in zip(scorers, fed)]
    for batch in batches:
        for s, queue in zip(scorers, fed):
            queue.append(batch[["post_id", *s.inputs]])
        yield batch, [next(run) for run in runs]


def _path_bit(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(FILTER_BITS))


def wanted_paths(records: DataFrame) -> bytes:
    """A bit per hash of the media paths that records name: of fixed size, whatever their number."""
    bit = _path_bit(F.col("image_path"))
    rows = records.select(bit.alias("_bit")).groupBy(F.floor(F.col("_bit") / ROW_BITS).cast("int").alias("row"))
    out = bytearray(FILTER_BITS // 8)
    for r in rows.agg(F.bitmap_construct_agg(F.col("_bit") % ROW_BITS).alias("bits")).collect():
        out[r["row"] * ROW_BITS // 8 : (r["row"] + 1) * ROW_BITS // 8] = r["bits"]
    return bytes(out)


def scan_media(media: DataFrame, describe: Scorer, embed: Scorer, wanted: bytes) -> DataFrame:
    """(path, generated, vector) of the files whose paths pass the filter; their contents are read and sent to Python once.

    The filter lets few paths through that nobody named; a join with the records drops what it made of these.
    """

    def run(batches: Batches) -> Batches:
        bits = np.unpackbits(np.frombuffer(wanted, np.uint8), bitorder="little")
        some = (b[bits[b["_bit"].to_numpy()] > 0] for b in batches)
        for batch, (told, seen) in _side_by_side([describe, embed], (b for b in some if len(b))):
            both = told.set_index("post_id").join(seen.set_index("post_id"))
            kept = both.loc[batch["post_id"]]
            yield pd.DataFrame({"path": batch["post_id"].to_numpy(), "generated": kept["generated"].to_numpy(), "vector": kept["vector"].to_numpy()})

    rows = media.select(F.col("path").alias("post_id"), "content", _path_bit(F.col("path")).alias("_bit"))
    found = map_frames(rows, run, ST.StructType.fromDDL("path string, generated string, vector array<double>"))
    return found.select(
        "path",
        T.clean_generated_text(F.col("generated")).alias("generated"),
        V.sanitize_vector(V.l2_normalize(F.col("vector"))).alias("emb_I"),
    )


def scan_texts(rows: DataFrame, embed: Scorer, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with the vector of each of some text columns, embedded in one call a batch; blank text is a single dot."""
    text = embed.inputs[0]
    filled = {f"_t{i}": F.coalesce(F.nullif(T.strip_ws(F.col(c)), F.lit("")), F.lit(".")) for i, c in enumerate(columns)}
    names, kept = list(filled), rows.columns

    def run(batches: Batches) -> Batches:
        held: deque = deque()

        def stacked() -> Batches:
            for b in batches:
                held.append(b)
                texts = pd.concat([b[n] for n in names], ignore_index=True)
                yield pd.DataFrame({"post_id": range(len(texts)), text: texts})

        for out in embed.fn(stacked()):
            b = held.popleft()
            vectors = out.set_index("post_id")["vector"].loc[range(len(b) * len(names))].to_numpy()
            parts = {f"_v{i}": vectors[i * len(b) : (i + 1) * len(b)] for i in range(len(names))}
            yield b[kept].assign(**parts)

    schema = ST.StructType([*rows.schema, *[ST.StructField(f"_v{i}", ST.ArrayType(ST.DoubleType())) for i in range(len(names))]])
    scored = map_frames(rows.withColumns(filled), run, schema)
    return scored.select(*kept, *[V.sanitize_vector(F.col(f"_v{i}")).alias(f"emb_{c}") for i, c in enumerate(columns)])


def features_one_pass(
    records: DataFrame,
    media: DataFrame,
    describe: Scorer,
    embed_text: Scorer,
    embed_media: Scorer,
    polarity: Callable[[Column], Column] = keyword_polarity,
    skipped: Observation | None = None,
) -> DataFrame:
    """All scorers, then the features; records without media drop out and are counted.

    ``media`` is ``(path, content)``. Files are read once, by both media scorers side by side; what leaves that scan are
    descriptions and vectors, so no content is ever exchanged. A fixed-size filter of the named paths keeps other files from being scored.
    ``skipped`` observes ``kept`` and ``skipped`` records when the result is written.
    """
    named = records.select("post_id", "label", "caption", "image_path")
    scanned = scan_media(media, describe, embed_media, wanted_paths(named))
    joined = named.join(scanned.withColumnRenamed("path", "image_path"), "image_path", "left")
    if skipped is not None:
        lost = F.col("generated").isNull()
        joined = joined.observe(
            skipped, F.sum((~lost).cast("long")).alias("kept"), F.sum(lost.cast("long")).alias("skipped")
        )
    usable = settled(joined, "_usable", F.col("generated").isNotNull()).filter("_usable")
    texts = scan_texts(usable.select("post_id", "label", "caption", "generated", "emb_I"), embed_text, ("caption", "generated"))
    full = texts.select(
        "post_id",
        "label",
        F.col("emb_caption").alias("emb_T"),
        F.col("emb_generated").alias("emb_T_hat"),
        "emb_I",
        polarity(F.col("caption")).alias("pol_T"),
        polarity(F.col("generated")).alias("pol_T_hat"),
    )
    return V.with_features(full).select("post_id", "label", *K.FEATURE_NAMES)


def build_features(records: DataFrame, media: DataFrame, path: str, *scorers: Scorer, **options) -> int:
    """Write the features of all records with media, and say how many had none; an error if that holds for all.

    ``scorers`` are those of ``features_one_pass``, in its order.
    """
    seen = Observation()
    features_one_pass(records, media, *scorers, skipped=seen, **options).write.mode("overwrite").parquet(path)
    counts = seen.get
    if not counts["kept"]:
        raise FileNotFoundError("no usable media found for any record")
    if counts["skipped"]:
        log.warning("skipped %d record(s) without media", counts["skipped"])
    return counts["skipped"]
