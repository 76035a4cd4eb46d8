import base64
import gzip
import hashlib

import pytest

from readloom.llm import warc


def _id(n):
    return f"urn:record:{'' if n is None else n}"


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_round_trip_and_pushdown(spark, tmp_path):
    long = "é<p>" * 200_000
    rows = [(1, "http://a/é x\r\ny", "same", "z"), (2, "http://b", "same", "z"), (3, None, None, "z"), (4, "u", "", "z"), (5, "u", long, "z"), (5, "u", long, "z"), (None, "u", "same", None)]
    path = str(tmp_path / "w")
    warc.write_archive(warc.deduplicated(_pages(spark, rows).repartition(2)), path)
    found = sorted(((r.record_id, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None, r.payload_length) for r in warc.read_archive(spark, path, verify="true").collect()), key=str)
    assert found == sorted([(_id(i), k, r and _id(r), *x) for i, k, r, *x in (
        (1, "revisit", 2, None, 4), (2, "response", None, b"same", 4), (3, "revisit", 4, None, 0), (4, "response", None, b"", 0),
        (5, "response", None, long.encode(), len(long.encode())), (5, "response", None, long.encode(), len(long.encode())), (None, "revisit", 2, None, 4),
    )], key=str)
    only = warc.read_archive(spark, path).where("record_type = 'revisit' and payload_digest is not null")
    assert sorted(r.record_id for r in only.collect()) == sorted(map(_id, (None, 1, 3)))
    reader = warc.WarcReader({"path": path}, only.schema)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload",), b"x")]))
    assert len(left) == 1 and sum(b.num_rows for s in reader.partitions() for b in reader.read(s)) == 4
    assert warc.read_archive(spark, path).where("payload_length > 4").count() == 2


def test_files_are_plain_warc(spark, tmp_path):
    path = tmp_path / "w"
    warc.write_archive(warc.deduplicated(_pages(spark, [(1, "http://a", "x", None)])), str(path))
    raw = gzip.decompress(next(path.glob("*.warc.gz")).read_bytes())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\nx\r\n\r\n")


def _heads(path, packed=True):
    with open(path, "rb") as stream:
        return [fields["warc-record-id"] for fields, _ in warc._Source(stream, 0, path.stat().st_size, packed).records()]


def test_members_of_all_kinds(tmp_path):
    raw = [warc.record(f"r{i}", "response", "u", b"p" * i * 70_000, warc.base32_digest(b"p" * i * 70_000), None) for i in range(4)]
    want = [f"<r{i}>" for i in range(4)]
    for data, packed in ((b"".join(map(gzip.compress, raw)), True), (gzip.compress(b"".join(raw)), True), (b"".join(map(warc.member, raw)), True), (gzip.compress(raw[0] + raw[1]) + b"\0" * 9 + warc.member(raw[2]) + gzip.compress(raw[3]), True), (b"".join(raw), False), (b"", True)):
        (tmp_path / "f").write_bytes(data)
        assert _heads(tmp_path / "f", packed) == (want if data else [])
    (tmp_path / "f").write_bytes(b"".join(raw)[:-100])
    with pytest.raises(ValueError, match="cut off"):
        _heads(tmp_path / "f", False)


def test_archives_of_others(spark, tmp_path):
    """Plain and packed files without a manifest: other ids, header names in any case, folded lines, no payload length."""
    page = b"<p>caf\xc3\xa9</p>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page
    sha = base64.b32encode(hashlib.sha1(page).digest())
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1111>\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\nsoftware:\r\n\r\n"
    head = b"WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID:<urn:uuid:2222>\r\nWARC-Target-URI: <http://a/\xff>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nX-Note: one\r\n  two\r\n"
    response = head + b"WARC-Payload-Digest: sha1:" + sha + b"\r\nContent-Type: application/http; msgtype=response\r\ncontent-length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    revisit = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:3333>\r\nWARC-Refers-To: <urn:uuid:2222>\r\nContent-Type: application/http\r\nContent-Length: 19\r\n\r\nHTTP/1.1 200 OK\r\n\r\n\r\n\r\n"
    resource = b"WARC/1.0\nWARC-Type: resource\nWARC-Record-ID: <urn:uuid:4444>\nContent-Type: text/plain\nContent-Length: 4\n\nab\n\n\n\n"
    folder = tmp_path / "crawl" / "part"
    folder.mkdir(parents=True)
    (folder / "a.warc").write_bytes(info + response + revisit)
    (folder / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(response + resource))
    (folder / "notes.txt").write_text("not an archive")
    found = sorted((r.record_id[-4:], r.record_type, r.target_uri, r.payload_length, bytes(r.payload) if r.payload is not None else None, r.refers_to, r.date) for r in warc.read_archive(spark, str(tmp_path / "crawl"), verify="true").collect())
    one = ("2222", "response", "http://a/\ufffd", len(page), page, None, "2020-01-01T00:00:00Z")
    assert found == [("1111", "warcinfo", None, 9, b"software:", None, None)] * 2 + [one] * 2 + [("3333", "revisit", None, None, None, "urn:uuid:2222", None), ("4444", "resource", None, 4, b"ab\n\n", None, None)]
    heads = warc.read_archive(spark, str(folder / "a.warc"), payload="false").where("record_type = 'response'").collect()
    assert [(r.payload_length, r.payload_digest) for r in heads] == [(len(page), sha.decode())]
    (folder / "a.warc").write_bytes(response.replace(page, page[::-1]))
    with pytest.raises(Exception, match="differ"):
        warc.read_archive(spark, str(folder / "a.warc"), verify="true").collect()


def test_empty_table_and_threshold(spark, tmp_path):
    warc.write_archive(warc.deduplicated(_pages(spark, [])), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0
    rows = _pages(spark, [(1, "u", "ab", None), (2, "u", "ab", None), (3, "u", "abc", None), (4, "u", "abc", None)])
    kinds = {r.record_id: r.record_type for r in warc.deduplicated(rows, min_payload=3).collect()}
    assert kinds == {_id(1): "response", _id(2): "response", _id(3): "revisit", _id(4): "response"}
