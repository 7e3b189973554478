"""A keyed table of files that takes upserts without rewriting what they don't touch.

Rows lie in hash buckets of their key. An upsert appends one delta folder with files in the buckets of its own keys only,
and becomes visible by the next manifest, a small file that lists the deltas of every bucket. A manifest is
written aside and renamed to its version's name, which fails if that version exists; the loser reads the winner's manifest and
takes the next version, without writing its rows again. The exclusion is as strong as the file system's rename. A
reader keeps the version it opened. A row counts if no later delta holds its key; rows of one batch don't
replace each other, and rows without a key are never replaced. Buckets with many deltas are compacted into one, and ``vacuum`` deletes what no kept version lists.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table, and deltas of a bucket from which it is compacted.
BUCKETS, MOST_DELTAS = 64, 8
_DELTA, _BUCKET, _SEQ = "_delta", "_bucket", "_seq"


@dataclass
class Manifest:
    """One version: per bucket the deltas that hold rows of it, oldest first, each with its sequence number."""

    version: int
    key: str
    buckets: int
    schema: str
    deltas: dict[str, list[list]] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


class Files:
    """The few file operations a table needs, through Hadoop's interface, so any store Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a whole file under a name that must be new; False if it isn't."""
        target = self.path(name)
        aside = self.path(f"{target.getParent()}/.{uuid.uuid4().hex}")
        stream = self.fs.create(aside)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(self.fs.makeQualified(aside), self.fs.makeQualified(target), options)
        except Py4JJavaError as e:
            self.fs.delete(aside, False)
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class KeyedStore:
    """The table below ``path``. ``key`` and ``buckets`` hold for a new table; an existing one has its own."""

    def __init__(self, spark: SparkSession, path: str, key: str = "post_id", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.files = Files(spark, self.path)

    # --- versions -----------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n[2:10]) for n in self.files.names(f"{self.path}/manifests") if n.startswith("v-") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The manifest of a version, by default the newest; None before the first upsert."""
        known = self.versions()
        if not known:
            return None
        return Manifest(**json.loads(self.files.read(self._name(known[-1] if version is None else version))))

    def _name(self, version: int) -> str:
        return f"{self.path}/manifests/v-{version:08d}.json"

    def _commit(self, change: Callable[[Manifest | None], Manifest | None]) -> int:
        """Add the version that ``change`` makes of the newest one, again and again until no other writer is first."""
        while True:
            last = self.manifest()
            new = change(last)
            if new is None:
                return last.version if last else 0
            new.version = last.version + 1 if last else 1
            if self.files.create(self._name(new.version), json.dumps(asdict(new))):
                return new.version

    # --- rows ---------------------------------------------------------------

    def _open(self, m: Manifest, parts: list[tuple[str, str]]) -> DataFrame:
        """The files of (bucket, delta) pairs, with the columns of both."""
        rows = T.StructType.fromJson(json.loads(m.schema))
        schema = T.StructType([*rows, T.StructField(_DELTA, T.StringType()), T.StructField(_BUCKET, T.IntegerType())])
        root = f"{self.path}/data"
        where = [f"{root}/{_DELTA}={delta}/{_BUCKET}={bucket}" for bucket, delta in parts]
        return self.spark.read.schema(schema).option("basePath", root).parquet(*where)

    def _rows(self, m: Manifest, buckets: list[str]) -> DataFrame:
        """What counts of the given buckets: those with one delta as they lie, the others without replaced rows."""
        columns = [f.name for f in T.StructType.fromJson(json.loads(m.schema))]
        found = self.spark.createDataFrame([], T.StructType.fromJson(json.loads(m.schema)))
        single = [(b, m.deltas[b][0][0]) for b in buckets if len(m.deltas[b]) == 1]
        if single:
            found = self._open(m, single).select(*columns)
        several = [(b, delta) for b in buckets if len(m.deltas[b]) > 1 for delta, _ in m.deltas[b]]
        if several:
            order = {delta: seq for own in m.deltas.values() for delta, seq in own}
            seq = F.create_map(*[F.lit(x) for pair in sorted(order.items()) for x in pair])[F.col(_DELTA)]
            newest = Window.partitionBy(_BUCKET, m.key).orderBy(F.desc(_SEQ))
            ranked = self._open(m, several).withColumn(_SEQ, seq).withColumn("_rank", F.rank().over(newest))
            late = ranked.filter((F.col("_rank") == 1) | F.col(m.key).isNull()).select(*columns)  # null is no key
            found = found.unionByName(late) if single else late
        return found

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version, by default the newest; None before the first upsert."""
        m = self.manifest(version)
        return None if m is None else self._rows(m, sorted(m.deltas, key=int))

    def _write(self, rows: DataFrame, key: str, buckets: int, name: str) -> list[str]:
        """Write a delta and name the buckets it has files in."""
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        folder = f"{self.path}/data/{_DELTA}={name}"
        rows.withColumn(_BUCKET, bucket).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(folder)
        return [n.partition("=")[2] for n in self.files.names(folder) if n.startswith(f"{_BUCKET}=")]

    def upsert(self, batch: DataFrame, writer: str | None = None, number: int = 0) -> int:
        """Rows whose key is in ``batch`` are replaced by all its rows; returns the version that shows them.

        A ``writer`` that numbers its batches may send one again: what it has applied already changes nothing.
        """
        last = self.manifest()
        if last and writer is not None and last.applied.get(writer, -1) >= number:
            return last.version
        key, buckets = (last.key, last.buckets) if last else (self.key, self.buckets)
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in batch.schema]).json()
        if last:
            kept = [f.name for f in T.StructType.fromJson(json.loads(last.schema))]
            if set(kept) != set(batch.columns):
                raise ValueError(f"the table has the columns {kept}, the batch {batch.columns}")
        name = uuid.uuid4().hex[:16]
        touched = self._write(batch, key, buckets, name)

        def change(m: Manifest | None) -> Manifest | None:
            m = m or Manifest(0, key, buckets, schema)
            if m.buckets != buckets or m.key != key:
                raise ValueError(f"{self.path} was created with other buckets at the same time")
            if writer is not None:
                if m.applied.get(writer, -1) >= number:
                    return None
                m.applied[writer] = number
            for b in touched:
                m.deltas.setdefault(b, []).append([name, m.version + 1])
            return m

        version = self._commit(change)
        return self.compact() or version

    def compact(self, most: int = MOST_DELTAS) -> int | None:
        """Merge the deltas of buckets that have more than ``most``; the version that shows it, None if there is none."""
        m = self.manifest()
        full = [b for b in m.deltas if len(m.deltas[b]) > most] if m else []
        if not full:
            return None
        name = uuid.uuid4().hex[:16]
        written = set(self._write(self._rows(m, full), m.key, m.buckets, name))

        def change(now: Manifest) -> Manifest:
            for b in full:
                old = m.deltas[b]
                if now.deltas[b][: len(old)] == old:  # else another compaction was first
                    now.deltas[b] = [[name, old[-1][1]]] * (b in written) + now.deltas[b][len(old) :]
            return now

        return self._commit(change)

    def vacuum(self, versions: int = 2) -> int:
        """Delete all but the newest ``versions`` manifests, and the files that only these listed; the number of folders deleted.

        Readers of a deleted version fail. Deltas that were never committed are left alone: they may be in the making.
        """
        known = self.versions()
        listed = {v: {(b, d) for b, own in self.manifest(v).deltas.items() for d, _ in own} for v in known}
        kept = set().union(*[listed[v] for v in known[-versions:]])
        gone = set().union(*[listed[v] for v in known[:-versions]]) - kept
        for bucket, delta in gone:
            self.files.delete(f"{self.path}/data/{_DELTA}={delta}/{_BUCKET}={bucket}")
        for v in known[:-versions]:
            self.files.delete(self._name(v))
        return len(gone)
