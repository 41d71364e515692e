import hashlib

import duckdb
import pytest

from helixframe.llm import queries, warc


def _digest(b):
    return hashlib.sha256(b).hexdigest()


def _archive(rows):
    return b"".join(f + warc.SEPARATOR.encode() for f in warc.frames(warc.record(k, u, p, _digest(p), r) for k, u, p, r in rows))


ROWS = [(i, f"http://h/{i} x", b"<html>" + b"common words " * 40 + str(i).encode() * 30, None) for i in range(300)]


def test_round_trip_with_dictionary():
    rows = [*ROWS, (300, None, ROWS[0][2], 0), (None, "u", b"", None)]
    data = _archive(rows)
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    got = [warc.parse(r) for r in warc.records(data)]
    assert [g["key"] for g in got] == [r[0] for r in rows]
    assert all(g["payload"] == r[2] for g, r in zip(got[:300], rows, strict=False))
    assert got[300]["record_type"] == "revisit" and got[300]["refers_to"] == 0 and got[300]["payload"] is None
    assert got[300]["payload_bytes"] == len(ROWS[0][2]) and got[300]["payload_digest"] == _digest(ROWS[0][2])
    assert got[0]["uri"] == "http://h/0%20x" and got[301]["key"] is None


def test_few_records_need_no_dictionary():
    assert [warc.parse(r)["payload"] for r in warc.records(_archive(ROWS[:2]))] == [r[2] for r in ROWS[:2]]
    assert list(warc.records(b"")) == []


@pytest.mark.parametrize("cut", [1, 9, 200])
def test_cut_archives_fail(cut):
    with pytest.raises(warc.WarcError):
        list(warc.records(_archive(ROWS)[:-8][:-cut]))


def test_a_changed_byte_never_passes():
    data = bytearray(_archive(ROWS[:3]))
    good = [warc.parse(r) for r in warc.records(bytes(data))]
    for at in range(0, len(data), 7):
        bad = bytearray(data)
        bad[at] ^= 0x55
        try:
            got = [warc.parse(r) for r in warc.records(bytes(bad))]
        except (warc.WarcError, UnicodeDecodeError):
            continue
        assert [g["payload"] for g in got] == [g["payload"] for g in good]


@pytest.mark.parametrize(
    "old,new",
    [
        (b"WARC/1.1", b"WARX/1.1"),
        (b"WARC-Type: response", b"WARC-Type: resource"),
        (b"WARC-Date: 1970", b"WARC-Date: 197x"),
        (b"WARC-Record-ID", b"WARC-Recordx-ID"),
        (b"Content-Type: application/http; msgtype=response\r\nContent-Length: ", b"Content-Type: application/http; msgtype=response\r\nContent-Length: 1"),
        (b"200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", b"200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 1"),
        (b"sha256:", b"sha256:0"),
        (b"common", b"commom"),
        (b"\r\n\r\n", b"\r\nWARC-Type: response\r\n\r\n"),
    ],
)
def test_wrong_headers_fail(old, new):
    raw = warc.record(1, "u", ROWS[0][2], _digest(ROWS[0][2]), None)
    warc.parse(raw)
    with pytest.raises(warc.WarcError):
        warc.parse(raw.replace(old, new, 1))


def test_tables(spark, tmp_path):
    big = "long " * 50_000
    rows = [(5, "u5", "x" * 200), (3, "u3", "x" * 200), (9, None, "x" * 200), (9, None, "x" * 200), (1, "a", "short"), (2, "b", "short"), (4, "c", None), (None, "d", big), (7, "e", ""), (8, "é\r\nX: y", "é" * 60)]
    df = spark.createDataFrame(rows, "key long, uri string, html string").withColumn("payload", warc.payload_of("html"))
    warc.write(df.repartition(3), f"file://{tmp_path}/w")
    got = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert sorted((r.key or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got) == sorted(
        [(5, "revisit", 3, 200), (3, "response", None, 200), (9, "revisit", 3, 200), (9, "revisit", 3, 200), (1, "response", None, 5), (2, "response", None, 5), (4, "response", None, 0), (0, "response", None, 250_000), (7, "response", None, 0), (8, "response", None, 120)], key=lambda x: (x[0], x[1], x[2] or 0, x[3]))
    warc.write(df.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_archives_are_bounded(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i}", bytes([i % 251]) * 3000) for i in range(400)], "key long, uri string, payload binary").repartition(2)
    warc.write(rows, f"file://{tmp_path}/w", archive_bytes=100_000)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{tmp_path}/w").collect()
    assert len(files) > 8
    assert all(sum(map(len, warc.records(bytes(f.content)))) <= 100_000 for f in files)
    assert sorted((r.key, r.payload_bytes) for r in warc.read(spark, f"file://{tmp_path}/w").collect()) == [(i, 3000) for i in range(400)]
    plan = warc.with_revisits(rows.selectExpr("*", "'x' as digest", "1 as least", "2 as own", "3 as refers_to"))
    assert plan.columns == ["key", "uri", "payload", "least", "own", "digest", "refers_to"]
    assert {r.key: r.refers_to for r in plan.collect()} == {i: None if i < 251 else i - 251 for i in range(400)}


def _foreign(kind, block, *more):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:12345678-1234-1234-1234-123456789abc>", "WARC-Date: 2024-02-29T12:00:00Z", *more, f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    import base64

    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    http = b"HTTP/1.0 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\xe9\r\n\r\nbody"
    raw = [
        _foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        _foreign("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "WARC-Target-URI: http://h/", "Content-Type: application/http; msgtype=request"),
        _foreign("response", http, "WARC-Target-URI: http://h/", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {sha1(b'body')}", f"WARC-Block-Digest: {sha1(http)}"),
        _foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 9\r\n\r\n4\r\nbody\r\n0\r\n\r\n", f"WARC-Payload-Digest: {sha1(b'body')}"),
        _foreign("metadata", b"k: v", "Content-Type: application/warc-fields"),
        _foreign("conversion", "é".encode(), "Content-Type: text/plain", "WARC-Refers-To: <urn:uuid:0>"),
        _foreign("revisit", b"", f"WARC-Profile: {warc.PROFILE}", f"WARC-Payload-Digest: {sha1(b'body')}", "WARC-Refers-To-Target-URI: http://h/"),
    ]
    got = [warc.parse(r) for r in raw]
    assert [g["record_type"] for g in got] == ["warcinfo", "request", "response", "response", "metadata", "conversion", "revisit"]
    assert [g["payload"] for g in got] == [b"software: x\r\n", b"", b"body", b"4\r\nbody\r\n0\r\n\r\n", b"k: v", "é".encode(), None]
    assert got[2]["payload_digest"] == _digest(b"body") and {g["key"] for g in got} == {None} and got[6]["payload_digest"] == sha1(b"body")
    for old, new in ((b"200 OK", b"201 OK"), (b"body", b"bodi"), (b"urn:uuid:", b"urn uuid "), (b"sha1:", b"sha1:A")):
        with pytest.raises(warc.WarcError):
            warc.parse(raw[2].replace(old, new, 1))
    with pytest.raises(warc.WarcError):
        warc.parse(raw[6].replace(b"WARC-Profile", b"WARC-Profil2"))
    (tmp_path / "a.warc.zst").write_bytes(b"".join(warc.frames(iter(raw))))
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted(r.record_type for r in rows) == sorted(g["record_type"] for g in got)
    assert {r.record_id for r in rows} == {"<urn:uuid:12345678-1234-1234-1234-123456789abc>"}


def test_query(spark, sf_dir):
    got = sorted(tuple(r) for r in queries.QUERIES["op2_warc"](spark, sf_dir).collect())
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    assert got == sorted(c.sql(queries.ORACLE_SQL["op2_warc"]).fetchall())
