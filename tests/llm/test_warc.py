"""Round trips through archives, records of other writers, and the SQL text."""

import base64
import gzip
import hashlib

import pytest

from tuneloom.llm import warc
from tuneloom.session import stage_path

PAGES = "page_id bigint, url string, html string, payload string, digest int, of string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], PAGES)


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [(3, "http://a/x", "<p>é</p>"), (1, "http://a/y", "<p>é</p>"), (2, None, None),
        (5, "http://b/", ""), (7, "bad url\r\nX: y", TRICKY), (9, "http://c/?q=1", "long " * 200000),
        (8, "http://d", "\r\n\r\n"), (None, "http://e", "no id"), (11, "http://e", "no id"),
        (4, "http://a/x", "<p>é</p>")]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    got = warc.round_trip(make(spark, ROWS + [ROWS[0]]).repartition(3)).collect()
    want = []
    for i, _, html in ROWS + [ROWS[0]]:
        same = [j for j, _, h in ROWS if (h or "") == (html or "") and j is not None]
        first = min(same)
        want.append((str(i), len((html or "").encode()), b32(html),
                     "response" if i == first else "revisit", None if i == first else first))
    assert sorted(map(str, [(str(r.page_id), *tuple(r)[1:]) for r in got])) == sorted(map(str, want))


def test_small_payloads_are_all_responses(spark):
    path = stage_path(spark, "warc")
    warc.write_captures(make(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]),
                        path, least=3)
    got = warc.page_captures(warc.assemble(warc.read_records(spark, path))).collect()
    assert {r.page_id: r.record_type for r in got} == {
        1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_nested_captures(spark):
    path = stage_path(spark, "warc")
    warc.write_captures(make(spark, ROWS), path)
    rows = {r.metadata.fields["page-id"]: r for r in
            warc.assemble(warc.read_records(spark, path)).collect()}
    assert bytes(rows["7"].response.payload) == TRICKY.encode()
    assert bytes(rows["9"].response.payload) == b"long " * 200000
    assert rows["7"].request.fields["host"] == "" and rows["9"].request.fields["host"] == "c"
    assert rows["3"].response.record_type == "revisit" and rows["2"].response.target_uri is None
    assert all((r.requests, r.metadata_records) == (1, 1) for r in rows.values())


def test_nothing(spark):
    assert warc.round_trip(make(spark, [])).count() == 0


def record(kind, block=b"", **headers):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind.encode()]
    lines += [f"{k.replace('_', '-')}: {v}".encode() for k, vs in headers.items()
              for v in (vs if isinstance(vs, list) else [vs])]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block]) + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nX-A: b:c\r\n\r\n\x00\xff\r\n"
    data = (record("warcinfo", b"software: x\r\n", WARC_Record_ID="<i>")
            + record("response", http, WARC_Record_ID="<r1>", Content_Type="application/http",
                     WARC_Concurrent_To="<q1>")
            + record("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<q1>",
                     Content_Type="application/http")
            + record("metadata", b"k: v\r\n", WARC_Record_ID="<m2>", WARC_Concurrent_To=["<r2>", "<r1>"],
                     Content_Type="application/warc-fields")
            + record("metadata", b"k: w\r\n", WARC_Record_ID="<m1>", WARC_Concurrent_To="<r1>",
                     Content_Type="application/warc-fields")
            + record("request", WARC_Record_ID="<q9>", WARC_Concurrent_To="<none>"))
    (tmp_path / "a.warc").write_bytes(data)
    lone = record("response", http, WARC_Record_ID="<r2>", Content_Type="application/http")
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(lone) + gzip.compress(record("request")))
    rows = {r.record_id: r for r in warc.assemble(
        warc.read_records(spark, str(tmp_path))).collect()}
    assert set(rows) == {"<r1>", "<r2>"}
    assert bytes(rows["<r1>"].response.payload) == b"\x00\xff\r\n"
    assert rows["<r1>"].request.record_id == "<q1>"
    assert (rows["<r1>"].metadata.record_id, rows["<r1>"].metadata_records) == ("<m1>", 2)
    assert rows["<r2>"].request is None and rows["<r2>"].metadata.fields == {"k": "v"}


@pytest.mark.parametrize("data", [b"junk", record("response", b"abc")[:-6], b"WARC/1.0\r\nContent-"])
def test_broken_archives_raise(data):
    with pytest.raises((ValueError, KeyError)):
        list(warc.parse_archive(data))
