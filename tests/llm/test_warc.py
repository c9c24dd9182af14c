"""Archives written, read and assembled."""

import base64
import gzip
import hashlib

import pytest

from assayer.llm import warc
from assayer.session import scratch_path

PAGES = [(1, "http://a.example/x?y", "<p>same</p>"), (2, "http://b.example", "<p>same</p>"), (3, None, None), (4, "http://c.example/", ""),
         (5, "http://d.example/\r\nX: y", "a\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\n\r\n\r\n"), (None, "http://e.example/", "<p>same</p>"),
         (6, "http://f.example/", "é" * 200_000), (7, "http://g.example/", "twice"), (7, "http://g.example/", "twice")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "v", "d") for r in rows], "page_id long, url string, html string, value string, digest string")


@pytest.fixture(scope="module")
def records(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(warc.page_records(frame(spark, PAGES)), path, records_per_file=6)
    return warc.read_archives(spark, path)


def test_records(records):
    rows = records.collect()
    assert len(rows) == 3 * len(PAGES)
    main = {(r.target_uri, r.record_type): r for r in rows if r.record_type in warc.ANCHORS}
    for page, url, html in PAGES:
        body = (html or "").encode()
        kind = "revisit" if page in (2, 4, None) else "response"
        r = main[(url or "").replace("\r\n", ""), kind]
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.declared_digest == f"sha1:{digest}"
        assert bytes(r.payload) == (b"" if kind == "revisit" else body)
        if kind == "revisit":
            assert r.refers_to == next(x.record_id for x in rows if x.record_type == "response" and x.declared_digest == r.declared_digest)


def test_captures(records):
    rows = warc.assemble(records).collect()
    assert len(rows) == len(PAGES) and all(r.part == 0 and len(r.requests) == 1 and len(r.metadata) == 1 for r in rows)
    pages = sorted(bytes(r.metadata[0].block).decode() for r in rows)
    assert pages == sorted("" if p is None else f"page-id: {p}\r\n" for p, _, _ in PAGES)


def test_links_of_all_kinds(spark):
    def record(i, kind, to=()):
        return (i, kind, list(to), None, "u", None, bytearray(b"b"), bytearray(b"p"))
    rows = [record("r1", "response"), record("q1", "request", ["r1"]), record("m1", "metadata", ["q1"]),
            record("r2", "response", ["q2"]), record("q2", "request"), record("m9", "metadata", ["absent"]), record(None, "metadata", ["r1"]),
            record("r3", "resource"), record("q1", "request", ["r1"])] + [record(f"n{i:03}", "metadata", ["r3"]) for i in range(50)]
    df = spark.createDataFrame(rows, warc.SCHEMA)
    got = warc.assemble(df, part_size=10).collect()
    by = {}
    for r in got:
        by.setdefault(r.capture_id, []).append(r)
    assert [x.record_id for x in by["r1"][0].requests] == ["q1"] and [x.record_id for x in by["r1"][0].metadata] == ["m1"]
    assert [x.record_id for x in by["r2"][0].requests] == ["q2"] and not by["r2"][0].metadata
    assert len(by["r3"]) > 1 and sorted(x.record_id for r in by["r3"] for x in r.metadata) == [f"n{i:03}" for i in range(50)]
    assert warc.assemble(df.limit(0)).count() == 0


def test_members_and_cut_files():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = one.replace(b"<a>", b"<b>").replace(b"abc", b"\r\n\r")
    for whole in (one + two, gzip.compress(one) + gzip.compress(two), gzip.compress(one + two)):
        assert [(r[0], r[6]) for r in warc.parse_archive(whole)] == [("<a>", b"abc"), ("<b>", b"\r\n\r")]
    assert [r[0] for r in warc.parse_archive(one + two[:-6])] == ["<a>"]
    assert not list(warc.parse_archive(b"")) and not list(warc.parse_archive(b"no archive\r\n\r\nat all"))


def test_small_payloads_are_all_responses(spark):
    kinds = [r.value for r in warc.page_records(frame(spark, PAGES[:2]), min_bytes=100).collect()]
    assert sum("WARC-Type: response" in k for k in kinds) == 2
    assert warc.page_records(frame(spark, [])).count() == 0
