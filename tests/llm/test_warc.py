"""Archives of one stream, their normal form and the index, also read by gzip alone; faulty files; odd pages."""

import gzip
import hashlib
import io
import random
import zlib

import pytest

from lastrum.llm import warc

SCHEMA = "page_id long, url string, html string, archive string, sha string"
LONG = "é<p>text</p>" * 100


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://a.example/x", LONG), (2, None, LONG), (9, "https://a.example/\r\nWARC-Type: x y", LONG), (9, "again", LONG), (None, "https://n.example", LONG)]
    rows += [(10, "u", None), (11, "u", ""), (12, "u", "short"), (13, "u", "short"), (None, None, None), (None, "u", "x" * 1000), (14, "u", "y" * 999), (15, "u", "y" * 999), (16, "u", "z" * 1000), (17, "u", "z" * 1000)]
    rows += [(20, "u", "WARC/1.1\r\n\r\n" * 200_000), (21, "u", "\r\n\r\nHTTP/1.1 " * 100)]
    return spark.createDataFrame([(*r, "c", "c") for r in rows], SCHEMA).repartition(3)


def plain(pages):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    keep = {}
    for page_id, html in rows:
        if page_id is not None and len(html) >= 1000:
            keep[html] = max(page_id, keep.get(html, page_id))
    out = []
    for page_id, html in rows:
        again = html in keep and keep[html] != page_id
        out.append((page_id, len(html), hashlib.sha1(html).hexdigest(), "revisit" if again else "response", keep[html] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("roll", [1, warc.ROLL])
def test_round_trip(pages, roll, monkeypatch):
    monkeypatch.setattr(warc, "ROLL", roll)
    monkeypatch.setattr(warc, "SPAN", 5000)
    assert sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str) == plain(pages)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "HEAVY", 5)
    rows = spark.createDataFrame([(k, "u", "h" * 1000 if k % 3 else f"{k % 40}" * 700 if k % 2 else None) for k in range(400)], "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.round_trip(rows).collect()), key=str) == plain(rows)


def test_files_are_archives(spark, pages):
    """One stream before; afterwards a member at each offset of the sidecar, and together the same bytes."""
    streams = warc.archive(pages)
    done = warc.normalise(streams).collect()
    assert sum(r["records"] for r in done) == pages.count() and {r["source"] for r in done} == {r["archive"] for r in streams.collect()}
    for r in done:
        before, after = (open(r[k].removeprefix("file://"), "rb").read() for k in ("source", "archive"))
        one = zlib.decompressobj(31)
        assert one.decompress(before) == gzip.decompress(after) and one.eof and not one.unused_data
        assert len(after) == r["bytes"]
        upto = 0
        for line in open(r["sidecar"].removeprefix("file://"), encoding="utf-8"):
            archive, offset, length, kind, record_id, _ = line.rstrip("\n").split("\t")
            member = gzip.decompress(after[int(offset) : int(offset) + int(length)])
            assert (archive, int(offset)) == (r["archive"], upto)
            assert f"WARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\n".encode() in member and member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")
            upto += int(length)
        assert upto == len(after)


def listed(data):
    sink = io.BytesIO()
    found, error = [], None
    try:
        for offset, length, fields in warc.members(io.BytesIO(data), sink):
            found.append((offset, length, fields))
    except ValueError as fault:
        error = str(fault)
    return found, error, sink.getvalue()


RECORDS = [warc.record(k, f"u{k}", random.Random(k).randbytes(10**k), None) for k in range(6)]


def test_several_streams_and_padding():
    found, error, out = listed(gzip.compress(RECORDS[0] + RECORDS[1][:50]) + gzip.compress(RECORDS[1][50:]) + b"\0" * 20 + gzip.compress(b"\r\n" + RECORDS[5]))
    assert (len(found), error) == (3, None) and gzip.decompress(out) == RECORDS[0] + RECORDS[1] + RECORDS[5]


@pytest.mark.parametrize(("cut", "whole"), [(1, 5), (9, 5), (400, 4), (11_000, 3)])
def test_cut_files_keep_whole_records(cut, whole):
    found, error, out = listed(gzip.compress(b"".join(RECORDS[:5]))[:-cut])
    assert (len(found), error) == (whole, "a gzip stream breaks off")
    for offset, length, _ in found:
        assert gzip.decompress(out[offset : offset + length]) in RECORDS
    found, error, _ = listed(gzip.compress(b"".join(RECORDS[:whole]) + RECORDS[5][:-cut]))
    assert (len(found), error) == ((whole, "the file ends in a record") if cut > 4 else (whole + 1, None))


@pytest.mark.parametrize("data", [b"no gzip at all", gzip.compress(b"GET / HTTP/1.1\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: x\r\n\r\n"), gzip.compress(b"a" * 3_000_000)])
def test_what_is_no_archive_is_said(data):
    found, error, _ = listed(data)
    assert found == [] and error


def test_faults_are_rows(spark, tmp_path):
    (tmp_path / "bad.gz").write_bytes(gzip.compress(RECORDS[0]) + b"junk")
    (tmp_path / "good.gz").write_bytes(gzip.compress(RECORDS[1] + RECORDS[2]))
    done = warc.normalise(spark.createDataFrame([(f"file://{tmp_path}/{x}.gz",) for x in ("bad", "good")], "archive string"))
    assert sorted((r["source"].rsplit("/")[-1], r["records"], r["error"] is None) for r in done.collect()) == [("bad.gz", 1, False), ("good.gz", 2, True)]
    assert sorted(r["page_id"] for r in warc.read(spark, done).collect()) == [0, 1, 2]


def test_damaged_payload_is_found():
    packed = gzip.compress(RECORDS[3][:-20] + b"q" * 16 + b"\r\n\r\n")
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(packed)


def test_continued_header_lines():
    assert warc.headers(b"WARC/1.0\r\nA: b\r\n c\r\nContent-LENGTH: 3\r\n\r\n") == {"a": "b c", "content-length": "3"}
