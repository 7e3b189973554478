from __future__ import annotations

import gzip
import hashlib
import io
import os
import zlib

import pytest

from tonegap.llm import archives
from tonegap.session import scratch_path

BIG = "<p>" + "tea " * 400 + "</p>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/x", BIG), (2, "http://a/y", BIG), (2, "http://a/y", BIG), (3, None, None), (4, "u\r\nX: y", ""), (None, "n", BIG), (5, "s", "short"), (6, "t", "short"), (7, "é", "é" * 600), (None, None, "é" * 700), (8, "l", "x" * 3_000_000)]
    return spark.createDataFrame([(*r, "k", "p") for r in rows], "page_id long, url string, html string, record_type string, payload string")


def test_round_trip(spark, pages):
    rows = sorted((tuple(r) for r in archives.archive_round_trip(pages, spark).collect()), key=str)
    want = []
    for r in pages.collect():
        raw = (r.html or "").encode()
        again = r.html == BIG and r.page_id != 2
        want.append((r.page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert rows == sorted(want, key=str)
    assert archives.archive_round_trip(pages.limit(0), spark).count() == 0


def test_members_and_index(spark, pages):
    folder = scratch_path(spark, "t").removeprefix("file://")
    manifest = archives.write_monolithic(archives.planned_records(pages), f"{folder}/whole")
    assert sum(r.records for r in manifest.collect()) == 11
    index = archives.normalise(manifest, f"{folder}/whole", f"{folder}/members")
    with open(f"{folder}/whole/{manifest.first().file}", "rb") as f:
        machine = zlib.decompressobj(archives.GZIP)
        machine.decompress(f.read())
        assert machine.eof and not machine.unused_data  # one member for the whole file
    for r in index.collect():
        with open(f"{folder}/members/{r.file}", "rb") as f:
            f.seek(r.offset)
            member = f.read(r.length)
        machine = zlib.decompressobj(archives.GZIP)
        raw = machine.decompress(member)
        assert machine.eof and not machine.unused_data and raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    whole = {r.file for r in index.collect()}
    assert all(gzip.open(f"{folder}/members/{f}").read().startswith(b"WARC/1.1") for f in whole)
    stray = f"{folder}/members/left-behind.warc.gz.idx"  # of an attempt that was lost
    with open(stray, "w") as f:
        f.write('{"file": "left-behind.warc.gz", "offset": 0, "length": 1}\n')
    assert os.path.exists(stray) and index.filter("file LIKE 'left%'").count() == 0
    payloads = {r.page_id: bytes(r.payload) for r in archives.read_records(index, f"{folder}/members").collect() if r.record_type == "response" and r.page_id}
    assert payloads[7] == ("é" * 600).encode() and payloads[3] == b""


def test_pieces_of_any_size_give_the_same_records():
    raw = b"".join(archives.record_bytes(k, "u", b"x" * k * 7, k * 7, hashlib.sha1(b"x" * k * 7).hexdigest(), "response", None, "d") for k in range(5))
    for size in (1, 7, 100, 10_000):
        pieces = (raw[i : i + size] for i in range(0, len(raw), size))
        records, out = 0, b""
        for piece, first in archives.record_pieces(pieces):
            records, out = records + first, out + piece
        assert records == 5 and out == raw


def test_broken_streams_are_errors():
    good = gzip.compress(archives.record_bytes(1, "u", b"abc", 3, "00" * 20, "response", None, "d"))
    with pytest.raises(ValueError):
        list(archives.record_pieces(archives.inflated(io.BytesIO(good[:-9]))))
    with pytest.raises(ValueError):
        list(archives.record_pieces(iter([b"no record\r\n\r\n"])))
    assert len([1 for _, first in archives.record_pieces(archives.inflated(io.BytesIO(good + good))) if first]) == 2
