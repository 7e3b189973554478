"""From an append-only annotation log to one canonical label per post, and agreement."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tonegap import constants as K
from tonegap.operators.keyed import last_wins
from tonegap.session import cut_lineage


def majority_label(log: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Most frequent label per post over every log row.

    Ties go to the label with the latest timestamp, then to the earliest log row. Two
    aggregations, both combined before their shuffle, so a hot post costs one row per
    label and map task.
    """
    per_label = log.groupBy("post_id", "label").agg(
        F.count("*").alias("votes"),
        F.max(F.struct(F.col("timestamp"), (-F.col(ord_col)).alias("early"))).alias("newest"),
    )
    return per_label.groupBy("post_id").agg(
        F.max_by("label", F.struct("votes", "newest")).alias("label"),
        F.max("votes").alias("votes"),
    )


def annotators_of(log: DataFrame) -> DataFrame:
    """Sorted distinct annotators per post (the array the record format asks for)."""
    distinct = log.select("post_id", "annotator_id").distinct()
    return distinct.groupBy("post_id").agg(
        F.array_sort(F.collect_list("annotator_id")).alias("annotators")
    )


def canonical_records(log: DataFrame, pool: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Voted labels joined to captions and media; posts outside the pool are dropped."""
    voted = majority_label(log, ord_col).select("post_id", "label").join(annotators_of(log), "post_id")
    return voted.join(pool.select("post_id", "caption", "image_path"), "post_id").select(
        "post_id",
        "caption",
        "image_path",
        "label",
        "annotators",
        F.lit(None).cast("double").alias("kappa"),
    )


def latest_annotation(
    log: DataFrame, ord_col: str = "ord", labels: tuple[str, ...] = K.LABELS
) -> DataFrame:
    """Last valid label per (annotator, post); unnamed annotators share one name."""
    name = F.coalesce(F.nullif(F.col("annotator_id"), F.lit("")), F.lit(K.UNKNOWN_ANNOTATOR))
    valid = log.filter(F.col("label").isin(*labels)).withColumn("annotator_id", name)
    return last_wins(valid, ["annotator_id", "post_id"], ord_col).select(
        "annotator_id", "post_id", "label"
    )


def annotator_counts(latest: DataFrame) -> DataFrame:
    return latest.groupBy("annotator_id").agg(F.count("*").alias("n_posts"))


def annotator_pairs(latest: DataFrame, part_size: int = 512) -> DataFrame:
    """Shared posts of every two annotators (a < b).

    The shared posts are the result the agreement statistics are defined on. A post with many
    annotators is cut into parts on both sides of the join, so its pairs are spread over
    (parts x parts) join keys of at most ``part_size`` rows a side. Whether a post needs that
    comes from a count that is broadcast only if the runtime finds it small.
    """
    crowded = (
        latest.groupBy("post_id")
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > part_size)
        .select("post_id", F.ceil(F.col("_n") / part_size).cast("int").alias("_parts"))
    )
    rows = latest.join(crowded, "post_id", "left").withColumn(
        "_parts", F.coalesce("_parts", F.lit(1))
    )
    own = F.pmod(F.xxhash64("annotator_id"), F.col("_parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    left = rows.select(
        "post_id",
        own.alias("_pa"),
        every.alias("_pb"),
        F.col("annotator_id").alias("annotator_a"),
        F.col("label").alias("label_a"),
    )
    right = rows.select(
        "post_id",
        every.alias("_pa"),
        own.alias("_pb"),
        F.col("annotator_id").alias("annotator_b"),
        F.col("label").alias("label_b"),
    )
    return (
        left.join(right, ["post_id", "_pa", "_pb"])
        .filter(F.col("annotator_a") < F.col("annotator_b"))
        .drop("_pa", "_pb")
    )


#: Rows of a part of a post, pairs counted at once inside a task, and pairs that a range of the pair table is made of.
PART_ROWS, AT_ONCE, RANGE_PAIRS = 4096, 1_000_000, 500_000
#: Rows a task reads before it counts their pairs, pairs it returns at once, and rows and pairs drawn for each range to find its bounds.
READ_ROWS, OUT_PAIRS, DRAWN = 120_000, 50_000, 50
#: Counted pairs on their way: labels and names in order, the latter as sizes and letters; of each first annotator its place among the names and
#: its number of cells; of each cell the second annotator's place and both labels as one number, as a step from the cell before, and the posts.
PACKED = pa.schema(
    [("labels", pa.list_(pa.string()))]
    + [(c, pa.list_(pa.int32())) for c in ("first", "cells")]
    + [(c, pa.list_(pa.uint8())) for c in ("step", "n", "sizes", "letters")]
)


def _to_bytes(numbers: np.ndarray) -> np.ndarray:
    """All lowest bytes, then all second ones and so on: most are zeros in a row, which compress to nothing."""
    return numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.ravel()


def _from_bytes(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(8, -1).T).view("<i8").ravel()


def _by_column(sizes: np.ndarray) -> np.ndarray:
    """Order of the bytes of names one behind the other: all first bytes, all second ones. Names in order begin alike, so this compresses well."""
    ends = np.cumsum(sizes)
    return np.argsort(np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes), kind="stable")


def _to_letters(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = pc.binary_length(names).to_numpy().astype(np.int64)
    data = pa.concat_arrays([names]).buffers()[2]
    return sizes, np.frombuffer(data or b"", np.uint8, sizes.sum())[_by_column(sizes)]


def _from_letters(sizes: np.ndarray, letters: np.ndarray) -> pa.Array:
    data = np.empty(len(letters), np.uint8)
    data[_by_column(sizes)] = letters
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(data))


def _ranked(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in order (of bytes, as Spark has it; a null is the last), and the place of each row's value among them."""
    coded = values.cast(pa.string()).dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def _units(rows: pa.Table) -> np.ndarray:
    """First rows of the units: runs of rows of one post and one two of its parts."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in ("post_id", "_first", "_second"):
        column = rows.column(c).combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by unit, about ``READ_ROWS`` at a time, no unit in two of them."""
    held, full = [], READ_ROWS
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= full:
            rows = pa.Table.from_batches(held).combine_chunks()
            cut = int(_units(rows)[-1])
            if cut:
                yield rows.slice(0, cut)
            held, full = rows.slice(cut).to_batches(), READ_ROWS if cut else 2 * full
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _counted(rows: pa.Table, at_once: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """(names, labels, codes, posts): pairs of annotators and labels that meet in whole units, as sorted numbers, some at a time."""
    names, who = _ranked(rows.column("annotator_id").combine_chunks())
    labels, label = _ranked(rows.column("label").combine_chunks())
    own, one, two = (rows.column(c).to_numpy() for c in ("_own", "_first", "_second"))
    starts = _units(rows)
    sizes = np.diff(np.append(starts, rows.num_rows))
    unit = np.repeat(np.arange(len(starts)), sizes)
    right = (one != two) & (own == two)
    order = np.lexsort((who, right, unit))
    who, label, right, within = who[order], label[order], right[order], (one == two)[order]
    again = bool(((who[1:] == who[:-1]) & (unit[1:] == unit[:-1])).any())
    # a row meets those behind it in its unit or, between two parts, those of the other part
    other = starts + np.bincount(unit, ~right, len(starts)).astype(np.int64)
    met = np.where(within, np.arange(len(order)) + 1, other[unit])
    counts = np.where(right, 0, (starts + sizes)[unit] - met)
    before, met = np.append(0, np.cumsum(counts)), met.astype(np.int32)
    at = 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(before, before[at] + at_once, "right")) - 1)
        i = np.repeat(np.arange(at, end, dtype=np.int32), counts[at:end])
        j = np.arange(len(i), dtype=np.int32) - np.repeat((before[at:end] - before[at]).astype(np.int32), counts[at:end])
        j += met[i]
        if again:
            differ = who[i] != who[j]
            i, j = i[differ], j[differ]
        if not within[at:end].all():
            i, j = np.where(who[i] < who[j], i, j), np.where(who[i] < who[j], j, i)
        code = who[i]
        for size, value, of in ((len(names), who, j), (len(labels), label, i), (len(labels), label, j)):
            code *= size
            code += value[of]
        del i, j
        code.sort()
        first = np.flatnonzero(np.diff(code, prepend=-1))
        if len(first):
            yield names, labels, code[first], np.diff(np.append(first, len(code)))
        at = end


def _packed(names: pa.Array, labels: pa.Array, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    pair, label = np.divmod(code, len(labels) ** 2)
    used, place = np.unique(np.concatenate(np.divmod(pair, len(names))), return_inverse=True)
    a, cell = place[: len(code)], place[len(code) :] * len(labels) ** 2 + label
    starts = np.flatnonzero(np.diff(a, prepend=-1))
    step = np.diff(cell, prepend=0)
    step[starts] = cell[starts]
    runs = [pa.array(c.astype(np.int32)) for c in (a[starts], np.diff(np.append(starts, len(a))))]
    sizes, letters = _to_letters(names.take(pa.array(used)))
    values = [labels, *runs, *[pa.array(c) for c in (_to_bytes(step), _to_bytes(n), _to_bytes(sizes), letters)]]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values], schema=PACKED)


def _pack_pairs(bounds: list[tuple[str, str]], at_once: int):
    """Pairs that meet in the rows of a task, counted and packed by the range of the pair table they belong to."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_units(batches):
            for names, labels, code, n in _counted(rows, at_once):
                texts = names.to_pylist()
                edges = [0]
                for a, b in bounds:
                    at = bisect_left(texts, a)
                    second = bisect_left(texts, b) if texts[at : at + 1] == [a] else 0
                    edges.append((at * len(texts) + second) * len(labels) ** 2)
                cuts = pairwise([*np.searchsorted(code, edges), len(code)])
                own = [(k, _packed(names, labels, code[lo:hi], n[lo:hi]).serialize()) for k, (lo, hi) in enumerate(cuts) if lo < hi]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in own], pa.int32()), pa.array([x.size for _, x in own], pa.int64()), pa.array([pa.compress(x, "zstd", asbytes=True) for _, x in own])],
                    ["_range", "_bytes", "_packed"],
                )

    return packed


def _unpack_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per pair of a range, in order, with its cells."""
    every = [
        [c.values for c in pa.ipc.read_record_batch(pa.py_buffer(pa.decompress(data, size, "zstd")), PACKED).columns]
        for batch in batches
        for size, data in zip(batch.column("_bytes").to_pylist(), batch.column("_packed").to_pylist())
    ]
    if not every:
        return
    own = [_from_letters(_from_bytes(sizes.to_numpy()), letters.to_numpy()) for *_, sizes, letters in every]
    names, who = _ranked(pa.concat_arrays(own))
    labels, which = _ranked(pa.concat_arrays([kinds for kinds, *_ in every]))
    n = np.concatenate([_from_bytes(row[4].to_numpy()) for row in every])
    code = np.empty(len(n), np.int64)
    at, of, done = 0, 0, 0
    for texts, (kinds, *numbers) in zip(own, every):
        first, cells, step = [c.to_numpy() for c in numbers[:3]]
        step = _from_bytes(step)
        cell = np.cumsum(step)
        starts = np.cumsum(cells) - cells
        cell -= np.repeat(cell[starts] - step[starts], cells)
        second, label = np.divmod(cell, len(kinds) ** 2)
        label_a, label_b = np.divmod(label, len(kinds))
        pair = np.repeat(who[at + first], cells) * len(names) + who[at + second]
        code[done : done + len(pair)] = (pair * len(labels) + which[of + label_a]) * len(labels) + which[of + label_b]
        at, of, done = at + len(texts), of + len(kinds), done + len(pair)
    del every, own
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    code, n = code[starts], np.add.reduceat(n[order], starts)
    pair, label = np.divmod(code, len(labels) ** 2)
    starts = np.append(np.flatnonzero(np.diff(pair, prepend=-1)), len(pair))
    for at in range(0, len(starts) - 1, OUT_PAIRS):
        own = starts[at : at + OUT_PAIRS + 1]
        a, b = np.divmod(pair[own[:-1]], len(names))
        cell = slice(own[0], own[-1])
        label_a, label_b = np.divmod(label[cell], len(labels))
        cells = pa.StructArray.from_arrays([labels.take(pa.array(label_a)), labels.take(pa.array(label_b)), pa.array(n[cell])], ["label_a", "label_b", "n"])
        tables = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), cells)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), tables], ["annotator_a", "annotator_b", "cells"])


def meetings(latest: DataFrame) -> Row:
    """(annotations, pairs, most): how many there are, how often two annotators met on a post, and the annotations of the fullest post."""
    sizes = latest.filter("annotator_id IS NOT NULL").groupBy("post_id").agg(F.count("post_id").alias("_n"))
    return sizes.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("annotations"),
        F.coalesce(F.sum(F.expr("_n * (_n - 1) div 2")), F.lit(0)).alias("pairs"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("most"),
    ).first()


def _bounds(latest: DataFrame, size: Row, range_pairs: int) -> list[tuple[str, str]]:
    """Pairs at which the ranges of the pair table begin, all but the first: quantiles of some pairs, drawn by the hash of their rows.

    They only say which task a pair is counted in. About ``DRAWN`` rows a range are broadcast, and as many pairs come back.
    """
    ranges = -(-size["pairs"] // range_pairs)
    if ranges < 2:
        return []
    every = max(1, size["annotations"] // (DRAWN * ranges))
    thin = max(1, 2 * size["pairs"] // (every * DRAWN * ranges))
    one_of = lambda n, *columns: F.pmod(F.xxhash64(*columns, F.lit("drawn")), F.lit(n)) == 0
    some = latest.filter(one_of(every, "annotator_id", "post_id")).select("post_id", F.col("annotator_id").alias("_met"))
    pairs = latest.join(F.broadcast(some), "post_id").filter((F.col("annotator_id") != F.col("_met")) & one_of(thin, "annotator_id", "_met", "post_id"))
    drawn = sorted(map(tuple, pairs.select(F.least("annotator_id", "_met"), F.greatest("annotator_id", "_met")).collect()))
    return sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []


def label_pairs(
    latest: DataFrame, part_rows: int = PART_ROWS, range_pairs: int = RANGE_PAIRS, by_pair: bool = False, size: Row | None = None
) -> DataFrame:
    """(annotator_a, annotator_b, label_a, label_b, n): how many posts both labelled so (a < b), in order of the pairs.

    A task counts the pairs of its posts. What is exchanged is a packed table for each range of pairs, about ``range_pairs`` of them, and a
    range is a partition of the result: neither adding up a pair's counts nor sorting takes another exchange. A post with more than
    ``part_rows`` annotations is cut by annotator, and each two of its parts are counted on their own. With ``by_pair`` there is one row per
    pair, with its label pairs as ``cells``. ``latest`` is read several times: give a stored frame, and its ``meetings`` if they are known.
    """
    size = size or meetings(latest)
    bounds = _bounds(latest, size, range_pairs)
    rows = latest.filter("annotator_id IS NOT NULL AND post_id IS NOT NULL").select("annotator_id", "post_id", "label")
    parts = F.lit(1)
    if size["most"] > part_rows:
        large = rows.groupBy("post_id").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("_parts")).filter("_parts > 1")
        rows, parts = rows.join(large, "post_id", "left"), F.coalesce("_parts", F.lit(1))
    own = F.pmod(F.xxhash64("annotator_id", F.lit("part")), parts).cast("int").alias("_own")
    other = F.explode(F.sequence(F.lit(0), parts - 1)).alias("_other")
    dealt = rows.select("annotator_id", "post_id", "label", own, other).select(
        "annotator_id", "post_id", "label", "_own", F.least("_own", "_other").alias("_first"), F.greatest("_own", "_other").alias("_second")
    )
    unit = ["post_id", "_first", "_second"]
    packed = dealt.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_pack_pairs(bounds, AT_ONCE), "_range int, _bytes long, _packed binary")
    tables = packed.repartitionById(len(bounds) + 1, "_range").mapInArrow(
        _unpack_pairs, "annotator_a string, annotator_b string, cells array<struct<label_a: string, label_b: string, n: bigint>>"
    )
    return tables if by_pair else tables.select("annotator_a", "annotator_b", F.inline("cells"))


def pair_overlap(pairs: DataFrame) -> DataFrame:
    """Shared posts per pair, of rows per post or of counts ``n``."""
    size = F.sum("n") if "n" in pairs.columns else F.count("*")
    return pairs.groupBy("annotator_a", "annotator_b").agg(size.alias("overlap"))


def cohens_kappa(
    pairs: DataFrame,
    keys: tuple[str, ...] = ("annotator_a", "annotator_b"),
    labels: tuple[str, ...] = K.LABELS,
) -> DataFrame:
    """Kappa per pair of label columns, in whole numbers up to the last division.

    One aggregation over the pairs, combined in the stage of the pair join. Rows may carry a
    count ``n``; without it every row counts once. Rows of whole pairs, with their label pairs
    as ``cells``, stay where they are.
    """
    if "cells" in pairs.columns:
        grouped = pairs.select(*keys, *_cell_sums(F.col("cells"), labels))
    else:
        grouped = _pair_sums(pairs, keys, labels)
    n, chance = F.col("overlap"), F.col("chance")
    value = (F.col("agreed") * n - chance).cast("double") / (n * n - chance)
    kappa = F.when((n == 0) | (chance >= n * n), F.lit(0.0)).otherwise(value)
    return grouped.select(*keys, "overlap", kappa.alias("kappa"))


def _pair_sums(pairs: DataFrame, keys: tuple[str, ...], labels: tuple[str, ...]) -> DataFrame:
    """(overlap, agreed, chance) per pair, of rows per label pair."""
    counts = pairs if "n" in pairs.columns else pairs.withColumn("n", F.lit(1).cast("long"))

    def marginal(side: str, label: str) -> Column:
        return F.sum(F.when(F.col(side) == label, F.col("n")).otherwise(0))

    sums = {f"_{s}{i}": marginal(f"label_{s}", lab) for i, lab in enumerate(labels) for s in "ab"}
    grouped = counts.groupBy(*keys).agg(
        F.sum("n").alias("overlap"),
        F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)).alias("agreed"),
        *[expr.alias(name) for name, expr in sums.items()],
    )
    chance = reduce(
        lambda a, b: a + b, [F.col(f"_a{i}") * F.col(f"_b{i}") for i in range(len(labels))]
    )
    return grouped.select(*keys, "overlap", "agreed", chance.alias("chance"))


def _cell_sums(cells: Column, labels: tuple[str, ...]) -> list[Column]:
    """The same sums, of one row's cells."""

    def total(value) -> Column:
        return F.aggregate(cells, F.lit(0).cast("long"), lambda s, cell: s + value(cell))

    def chance(cell: Column) -> Column:
        met = total(lambda other: F.when(other["label_b"] == cell["label_a"], other["n"]).otherwise(0))
        return F.when(cell["label_a"].isin(*labels), cell["n"] * met).otherwise(0)

    agreed = total(lambda cell: F.when(cell["label_a"] == cell["label_b"], cell["n"]).otherwise(0))
    return [total(lambda cell: cell["n"]).alias("overlap"), agreed.alias("agreed"), total(chance).alias("chance")]


def agreement_report(log: DataFrame, ord_col: str = "ord", range_pairs: int = RANGE_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Pair table and per-annotator counts, both in order over their partitions; the pair table is empty without overlap.

    The log is read once: its latest annotations are stored. The pair table is many times as large and computed wherever it is used.
    """
    latest = cut_lineage(latest_annotation(log, ord_col))
    return _agreement(latest, meetings(latest), range_pairs)


def _agreement(latest: DataFrame, size: Row, range_pairs: int) -> tuple[DataFrame, DataFrame]:
    pairs = label_pairs(latest, range_pairs=range_pairs, by_pair=True, size=size)
    return cohens_kappa(pairs), annotator_counts(latest).orderBy("annotator_id")


def report_lines(kappas: DataFrame, counts: DataFrame, met: bool | None = None) -> DataFrame:
    """(section, a, b, line) of the report on both tables; its order is that of the first three.

    Tables that are in order over their partitions give lines that are. ``met``, whether there is a pair, is looked up unless it is known.
    """

    def fixed(section: int, lines: Column) -> DataFrame:
        placed = kappas.sparkSession.range(1).select(F.posexplode(lines).alias("at", "line"))
        return placed.select(F.lit(section).alias("section"), F.format_string("%04d", "at").alias("a"), F.lit("").alias("b"), "line")

    text = lambda lines: F.array(*[F.lit(x) for x in lines])
    if met is None:
        met = not kappas.isEmpty()
    head = text((*K.REPORT_TITLE, *(K.REPORT_PAIRS_HEAD if met else (K.REPORT_NO_PAIRS,))))
    pairs = kappas.select(
        F.lit(1).alias("section"),
        F.col("annotator_a").alias("a"),
        F.col("annotator_b").alias("b"),
        F.format_string("| %s | %s | %d | %.4f |", "annotator_a", "annotator_b", "overlap", F.bround("kappa", 4)).alias("line"),  # ties to even
    )
    people = counts.select(
        F.lit(3).alias("section"),
        F.col("annotator_id").alias("a"),
        F.lit("").alias("b"),
        F.format_string("| %s | %d |", "annotator_id", "n_posts").alias("line"),
    )
    return fixed(0, head).unionByName(pairs).unionByName(fixed(2, text(K.REPORT_COUNTS_HEAD))).unionByName(people)


def write_agreement_report(log: DataFrame, path: str, ord_col: str = "ord", range_pairs: int = RANGE_PAIRS) -> None:
    """The report on a log as lines of text: one sorted file or, if its pairs make several ranges, files in order, written as the ranges lie."""
    latest = cut_lineage(latest_annotation(log, ord_col))
    size = meetings(latest)
    lines = report_lines(*_agreement(latest, size, range_pairs), met=size["pairs"] > 0)
    if size["pairs"] <= range_pairs:
        lines = lines.orderBy("section", "a", "b")
    lines.select("line").write.mode("overwrite").text(path)


def pending_for_annotator(pool: DataFrame, log: DataFrame, annotator: str) -> DataFrame:
    done = log.filter(F.col("annotator_id") == annotator).select("post_id")
    return pool.join(done, "post_id", "left_anti")


def label_support(records: DataFrame, by: str = "label") -> DataFrame:
    return records.groupBy(by).agg(F.count("*").alias("n"))
