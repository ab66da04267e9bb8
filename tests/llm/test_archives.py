import base64
import gzip
import hashlib
import uuid
from collections import defaultdict

import pytest

from lodestone.llm import archives as A

from ..compare import of_duckdb, of_spark

SCHEMA = "page_id bigint, url string, html string"


def brute(rows, least=0):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[html or ""].append(i)
    out = []
    for text, ids in groups.items():
        raw = text.encode()
        ids.sort(key=lambda i: (i is not None, i or 0))
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        for k, i in enumerate(ids):
            again = len(raw) >= least and k < len(ids) - 1
            out.append((i, len(raw), digest, "revisit" if again else "response", ids[-1] if again else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


ROWS = [
    (1, "http://a.example/", "<p>one</p>"),
    (2, "http://a.example/ with space\n", "<p>one</p>"),
    (3, None, None),
    (4, " ", ""),
    (5, "http://b.example/é", "é" * 50_000),
    (6, "http://c.example/", "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello\n\nhttp://x/ 0.0.0.0 20240101000000 text/html 4\nabcd"),
    (7, "http://d.example/", "HTTP/1.1 200 OK\r\nX-Row: 99\r\n\r\nHTTP"),
    (None, "http://e.example/", "<p>one</p>"),
    (9, "filedesc://odd", "<p>two</p>"),
    (9, "http://f.example/", "<p>two</p>"),
    (9, "http://f.example/", "<p>two</p>"),
    (10, "http://g.example/", "\n\n\r\n"),
]


@pytest.mark.parametrize("least", [0, 1, 11])
@pytest.mark.parametrize("size", [1, 400, A.ARCHIVE])
def test_pages_come_back(spark, least, size):
    pages = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'c' as kind", "'c' as archive", "'c' as n", "'c' as value", "'c' as key")
    assert rows_of(A.warc_pages(pages, least, size)) == brute(ROWS, least)


def test_many_groups_are_joined_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(A, "SENT", 0)
    rows = [(k, f"http://a/{k}", f"text {k % 7}" if k % 3 else "hot") for k in range(200)]
    assert rows_of(A.warc_pages(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_table(spark):
    assert rows_of(A.warc_pages(spark.createDataFrame([], SCHEMA))) == []


def test_header_lines_of_both_versions():
    docs = [("http://a/", b"plain"), ("http://b/x", A.page_document(7, b"<p>")), ("dns:a", b"1.2.3.4")]
    for version in (1, 2):
        found = list(A.arc_records(A.arc_file("n.arc", docs, version, "19970102030405")))
        assert [f["URL"] for _, f, _, _ in found] == ["filedesc://n.arc", "http://a/", "http://b/x", "dns:a"]
        assert [d for _, _, d, _ in found[1:]] == [d for _, d in docs] and not any(p for *_, p in found)
        assert len(found[0][1]) == len(A.ARC_FIELDS[version])
        kinds = [A.converted("n.arc", *x)["kind"] for x in found]
        assert kinds == ["warcinfo", "resource", "response", "response"]
        assert A.converted("n.arc", *found[2])["payload"] == b"<p>" and A.converted("n.arc", *found[2])["date"] == "1997-01-02T03:04:05Z"


def test_legacy_oddities():
    said = b"filedesc://x 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
    body = said + b"http://a/with space 1.2.3.4 19960923142103 text/html 4\nabcd\nnot a header\nhttp://b/ 1.2.3.4 199609231421 text/html 3\r\nxyz\n\n\nhttp://c/ 1.2.3.4 19960923 text/html 99\ncut"
    found = list(A.arc_records(body))
    assert [f["URL"] for _, f, _, _ in found] == ["filedesc://x", "http://a/with space", "http://b/", "http://c/"]
    assert [d for _, _, d, _ in found[1:]] == [b"abcd", b"xyz", b"cut"]
    assert found[2][3].startswith("no header line") and found[3][3] == "3 of 99 bytes"
    assert list(A.arc_records(b"")) == [] and list(A.arc_records(b"rubbish"))[0][3] == "no header line at 0"
    assert A.warc_date("199609231421") == "1996-09-23T14:21:00Z" and A.warc_date("19969999") == "1970-01-01T00:00:00Z"


def test_gzip_members():
    parts = [b"one", b"two" * 1000]
    assert A.unpacked(b"".join(map(gzip.compress, parts))) == b"".join(parts)
    assert A.unpacked(gzip.compress(parts[1] * 50)[:-9])[:9] == b"twotwotwo"
    assert A.unpacked(b"plain") == b"plain"
    assert A.unpacked(gzip.compress(b"one") + b"\x1f\x8bbroken")[:3] == b"one"


def test_conversion_of_files_keeps_bytes(spark, tmp_path):
    """Documents that are no text, one archive plain and one in members; repeated payloads are told once."""
    odd = bytes(range(256)) * 3
    docs = [("http://a/", b"HTTP/1.0 200 OK\r\n\r\n" + odd), ("http://b/", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" + odd), ("http://c/", odd)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.arc").write_bytes(A.arc_file("a.arc", docs, 1) + b"\n")
    (tmp_path / "in/b.arc.gz").write_bytes(b"".join(gzip.compress(x) for x in (A.arc_file("b.arc", [], 2) + b"\n", A.arc_file("b.arc", docs[:1], 2).split(b"\n", 3)[3] + b"\n")))
    A.convert(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    got = A.read_warc(A.archives(spark, f"file://{tmp_path}/out")).collect()
    by = defaultdict(list)
    for r in got:
        assert r.problem is None and int(r.fields["content-length"]) == len(r.block)
        assert r.fields["warc-block-digest"] == "sha1:" + A.sha1_of(r.block)
        uuid.UUID(r.fields["warc-record-id"][10:-1])
        by[r.fields["warc-type"]].append(r)
    assert {k: len(v) for k, v in by.items()} == {"warcinfo": 2, "response": 1, "revisit": 2, "resource": 1}
    first = by["response"][0]
    assert first.block.endswith(odd) and by["resource"][0].block == odd
    assert {r.fields["warc-refers-to"] for r in by["revisit"]} == {first.fields["warc-record-id"]}
    assert {r.fields["warc-payload-digest"] for r in by["revisit"]} == {"sha1:" + A.sha1_of(odd)}
    again = A.read_arc(A.archives(spark, f"file://{tmp_path}/in"))
    assert {r.record_id for r in again.collect()} == {r.fields["warc-record-id"] for r in got}


def test_broken_warc():
    whole = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [x[2] for x in A.warc_records(whole * 2)] == [b"abc", b"abc"]
    assert [(x[2], x[3]) for x in A.warc_records(b"junk\r\n" + whole + whole[:-5])] == [(b"", "no record at 0"), (b"abc", None), (b"ab", "2 of 3 bytes")]


def test_op12_equals_sql(spark, data):
    assert of_spark(A.op12_warc(spark, data)) == of_duckdb(A.OP12_SQL, data)
