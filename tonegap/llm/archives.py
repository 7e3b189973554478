"""WARC archives: writing, normalising whole-file gzip streams, an offset index, reading by offset.

Archives first come as one gzip stream per file. The normaliser inflates such a stream once, in pieces, follows the records by
their lengths, and writes every record as a gzip member of its own, with a sidecar of JSON lines that
name each member's offset and length. Readers then fetch single records without inflating what is before them.
All files lie in the shared folder. A task writes under a name of its own attempt, and the names
count only once Spark has committed them in a manifest, so lost executors and repeated tasks leave nothing that is read.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegap.llm.common import stored
from tonegap.session import scratch_path

#: Payloads from this size on are stored once and revisited.
REVISIT_BYTES = 1000
#: Bytes of records in an archive before the next one is begun, and bytes handled at once.
ARCHIVE_BYTES, CHUNK = 128 << 20, 1 << 20
MOST_HEADER = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 16 + zlib.MAX_WBITS

INDEX = "file string, offset long, length long, record_id string, record_type string, page_id long"


def _open(path: str):
    filesystem, at = pyarrow.fs.FileSystem.from_uri(path)
    return filesystem, at


def record_id(page_id: int | None) -> str:
    """The same for the same page, a new one for a page without id."""
    own = uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")
    return f"<urn:uuid:{own}>"


def record_bytes(page_id, url, payload: bytes, size: int, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One WARC record; a revisit holds the http header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the version line has none."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def planned_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) per page.

    Of equal payloads of ``REVISIT_BYTES`` and more, the one with the largest page_id is the
    response. Rows that repeat this id are responses too; rows without id revisit it; without any id all
    are responses.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")
    )
    shared = (
        rows.filter(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
        .filter((F.col("copies") > 1) & F.col("first").isNotNull())
        .drop("copies")
    )
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, ["payload_digest", "payload_bytes"], "left").select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def write_monolithic(records: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write records as archives of one gzip stream each; the committed manifest (file, records)."""
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _open(folder)
        sink = squeeze = None
        name, count, size = "", 0, 0

        def finish() -> pa.RecordBatch:
            sink.write(squeeze.flush())
            sink.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([count], pa.int64())})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if sink is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    filesystem.create_dir(base, recursive=True)
                    sink = filesystem.open_output_stream(f"{base}/{name}", compression=None)
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                raw = record_bytes(*row, date)
                for at in range(0, len(raw), CHUNK):
                    sink.write(squeeze.compress(raw[at : at + CHUNK]))
                count, size = count + 1, size + len(raw)
                if size >= ARCHIVE_BYTES:
                    yield finish()
                    sink = None
        if sink is not None:
            yield finish()

    return stored(records.select(*columns).mapInArrow(run, "file string, records long"), "manifest")


def inflated(source) -> Iterator[bytes]:
    """Pieces of a gzip file of one or more members; a stream that breaks off is an error."""
    machine, fed = zlib.decompressobj(GZIP), False
    while chunk := source.read(CHUNK):
        while chunk:
            fed = True
            if piece := machine.decompress(chunk, CHUNK):
                yield piece
            while machine.unconsumed_tail:
                if piece := machine.decompress(machine.unconsumed_tail, CHUNK):
                    yield piece
            chunk = b""
            if machine.eof:
                chunk = machine.unused_data
                machine, fed = zlib.decompressobj(GZIP), False
    if fed:
        raise ValueError("gzip stream ends early")


def record_pieces(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """(piece, first) of record after record; ``first`` marks the piece that holds a whole header."""
    held = b""
    pieces = iter(pieces)
    while True:
        while held[:2] == b"\r\n":
            held = held[2:]
        while (end := held.find(b"\r\n\r\n")) < 0:
            more = next(pieces, None)
            if more is None:
                if held.strip():
                    raise ValueError("record header ends early")
                return
            held += more
            if len(held) > MOST_HEADER + CHUNK and held.find(b"\r\n\r\n") < 0:
                raise ValueError("record header too long")
            while held[:2] == b"\r\n":
                held = held[2:]
        head = held[: end + 4]
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        left = int(headers_of(head)["content-length"]) + 4
        yield head, True
        held = held[end + 4 :]
        while left:
            if not held:
                held = next(pieces, b"")
                if not held:
                    raise ValueError("record ends early")
            part, held = held[:left], held[left:]
            left -= len(part)
            yield part, False


def normalise(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite the archives of a manifest record by record and index them: the index rows.

    Sidecars (``.idx``, JSON lines) lie beside the new archives; the rows are read back from them, and only
    those of committed files count.
    """
    spark = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _open(source)
        out_system, out_base = _open(target)
        out_system.create_dir(out_base, recursive=True)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                own = f"{uuid.uuid4().hex}.warc.gz"
                rows, offset, at, entry, squeeze = 0, 0, 0, None, None
                with (
                    filesystem.open_input_stream(f"{base}/{name}", compression=None) as raw,
                    out_system.open_output_stream(f"{out_base}/{own}", compression=None) as sink,
                    out_system.open_output_stream(f"{out_base}/{own}.idx", compression=None) as index,
                ):

                    def put(data: bytes):
                        nonlocal at
                        sink.write(data)
                        at += len(data)

                    def finish():
                        if entry:
                            put(squeeze.flush())
                            index.write((json.dumps(entry | {"offset": offset, "length": at - offset}) + "\n").encode())

                    for piece, first in record_pieces(inflated(raw)):
                        if first:
                            finish()
                            head = headers_of(piece)
                            page = head.get("x-page-id")
                            entry = {"file": own, "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type")}
                            entry |= {"page_id": int(page)} if page else {}
                            offset, rows, squeeze = at, rows + 1, zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        put(squeeze.compress(piece))
                    finish()
                yield pa.RecordBatch.from_pydict({"file": [own], "records": pa.array([rows], pa.int64())})

    files = max(1, min(manifest.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    done = stored(manifest.select("file").repartition(files, "file").mapInArrow(run, "file string, records long"), "normalised")
    if not done.head(1):
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).json(f"{target}/*.idx").join(done.select("file"), "file", "left_semi")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, record_id, payload, payload_bytes, payload_digest, record_type, refers_to_id) by offset.

    A revisit has no payload; its size and digest are those its headers give. A response whose
    payload doesn't have its digest is an error.
    """
    schema = "page_id long, record_id string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to_id string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        filesystem, base = _open(folder)
        name, source = None, None
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    name, source = file, filesystem.open_input_file(f"{base}/{file}")
                source.seek(offset)
                raw = zlib.decompress(source.read(length), GZIP)
                head, _, rest = raw.partition(b"\r\n\r\n")
                fields = headers_of(head)
                http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
                digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                kind = fields["warc-type"]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
                page = fields.get("x-page-id")
                row = (int(page) if page else None, fields["warc-record-id"], payload if kind == "response" else None)
                row += (int(headers_of(http)["content-length"]), digest, kind, fields.get("warc-refers-to"))
                for c, v in zip(out, row):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                names=list(out),
            )

    return index.select("file", "offset", "length").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from its archive.

    ``pages`` has page_id, url, html, of which all may be null: null html is an empty payload, a null url leaves its header
    out, a null id is a record of its own. Repeated rows are records each. An empty table gives no rows;
    further columns are ignored. The folder is the session's shared one; pyarrow must be able to open it.
    """
    folder = scratch_path(spark, "archives")
    manifest = write_monolithic(planned_records(pages), f"{folder}/whole")
    index = normalise(manifest, f"{folder}/whole", f"{folder}/members")
    read = read_records(index, f"{folder}/members").drop("payload")
    targets = index.filter("record_type = 'response' AND page_id IS NOT NULL").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")
    ).distinct()
    return read.join(targets, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
