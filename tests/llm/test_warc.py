import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from quarry.llm import warc
from quarry.llm.common import shared_dir
from quarry.llm.files import open_fs

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    best, count = {}, {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000:
            count[raw] = count.get(raw, 0) + 1
            if i is not None:
                best[raw] = max(i, best.get(raw, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        refers = best[raw] if count.get(raw, 0) > 1 and raw in best and i != best[raw] else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROWS = [
    (1, "http://a", "x" * 1000),
    (2, "http://b", "x" * 1000),
    (3, None, "x" * 1000),
    (3, "http://c", "x" * 1000),
    (4, "http://d\r\nEvil: 1", "x" * 999),
    (5, "", "x" * 999),
    (6, "u", None),
    (7, "u", ""),
    (None, "u", "é" * 700),
    (8, "u", "é" * 700),
    (None, "u", "null pages only" * 100),
    (None, "u", "null pages only" * 100),
    (9, "u", "WARC/1.1\r\n\r\n" * 300),
    (-4, "é☃", "".join(chr(33 + i % 5000) for i in range(300_000))),
]


@pytest.mark.parametrize("chunk", [100, 1 << 16])
def test_odd_rows(spark, chunk):
    df = pages(spark, ROWS).withColumn("chunk", F.lit("clash")).withColumn("PAYLOAD", F.lit(1)).withColumn("digest", F.lit("d")).repartition(3)
    rows = warc.round_trip(df, chunk=chunk, with_data=True).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows if r.last), key=str)
    assert got == expected(ROWS)
    assert all(len(r.data) <= chunk for r in rows)
    assert len({r.record_id for r in rows}) == len(ROWS) and len({(r.record_id, r.chunk) for r in rows}) == len(rows)
    by = {r.record_id: r for r in rows if r.last}
    for r in rows:
        assert r.record_type != "revisit" or (by[r.refers_to_record].page_id, by[r.refers_to_record].record_type) == (r.refers_to, "response")
    body = b"".join(r.data for r in sorted((r for r in rows if r.page_id == -4), key=lambda r: r.chunk))
    assert body == ROWS[-1][2].encode()
    for r in rows:
        if r.page_id == -4:
            assert r.payload_digest == hashlib.sha1(body[: r.payload_bytes]).hexdigest()


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_members_are_whole_records(spark):
    folder = shared_dir(spark, "warc")
    parts = warc.write(warc.chunk_table(pages(spark, ROWS[:3]).coalesce(1)), folder)
    fs, path = open_fs(folder)
    raw = b"".join(fs.open_input_stream(f"{path}/part-{p:06d}.warc.gz", compression=None).read() for p in parts)
    assert gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type: ") == 3
    assert gzip.decompress(raw).count(b"x" * 1000) == 1


def archive(payload=b"y" * 300, digest=None, chunk=100):
    out = io.BytesIO()
    writer = warc.RecordWriter(out)
    n = -(-len(payload) // chunk)
    for i in range(n):
        writer.add("urn:uuid:1", i, n, 1, "u", len(payload), digest or hashlib.sha1(payload).hexdigest(), None, None, payload[i * chunk : (i + 1) * chunk])
    return out.getvalue()


def test_damage_is_found():
    assert len(list(warc.read_chunks(io.BytesIO(archive()), 50))) == 6
    for bad in (archive(digest="0" * 40), archive()[:-9], gzip.compress(b"junk\r\n"), gzip.compress(gzip.decompress(archive())[:-100])):
        with pytest.raises(ValueError):
            list(warc.read_chunks(io.BytesIO(bad)))
    writer = warc.RecordWriter(io.BytesIO())
    writer.add("a", 0, 3, 1, "u", 9, "dd", None, None, b"abc")
    for record, at in (("a", 2), ("b", 1)):
        with pytest.raises(ValueError):
            writer.add(record, at, 3, 1, "u", 9, "dd", None, None, b"ghi")


def test_query(spark, sf_dir):
    from quarry.llm.queries import op1_warc

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in op1_warc(spark, sf_dir).collect()), key=str) == expected(rows)


def foreign(gap=b"\r\n\r\n", zipped=True):
    """An archive of another writer: all types, base 32, folded and missing headers."""
    http = b"HTTP/1.0 200 OK\nServer: x\n\n"
    sha = base64.b32encode(hashlib.sha1(b"body").digest())
    records = [
        (b"Warcinfo", [b"Content-Type: application/warc-fields"], b"software: x\r\n"),
        (b"request", [b"Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.0\r\n\r\n"),
        (b"response", [b"Content-Type: application/http;msgtype=response", b"WARC-Payload-Digest: sha1:" + sha, b"WARC-Target-URI:", b" http://a"], http + b"body"),
        (b"response", [b"Content-Type: application/http", b"warc-payload-digest: md5:" + hashlib.md5(b"").hexdigest().encode()], http),
        (b"response", [b"Content-Type: application/http"], b"HTTP/1.0 200 OK\r\n"),
        (b"response", [b"Content-Type: application/http", b"WARC-Payload-Digest: sha1:" + sha], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n0\r\n\r\n"),
        (b"resource", [b"Content-Type: text/dns", b"WARC-Payload-Digest: blake3:xx"], b"a.b\r\n"),
        (b"metadata", [], b""),
        (b"revisit", [b"Content-Type: application/http", b"WARC-Payload-Digest: sha1:" + sha, b"WARC-Refers-To: <urn:uuid:2>"], http),
        (b"revisit", [], b""),
        (b"response", [b"Content-Type: application/http"], b"HTTP/1.0 200"),
    ]
    out = b""
    for i, (kind, lines, block) in enumerate(records):
        raw = b"\r\n".join([b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:%d>" % i, *lines, b"Content-Length: %d" % len(block), b"", block]) + gap
        out += gzip.compress(raw) if zipped else raw
    return out


@pytest.mark.parametrize("zipped", [True, False])
def test_archives_of_other_writers(spark, tmp_path, zipped):
    rows = list(warc.read_chunks(io.BytesIO(foreign(zipped=zipped)), 3))
    whole = {r[0]: r for r in rows if r[2]}
    data = {i: b"".join(r[-1] for r in rows if r[0] == i) for i in whole}
    assert data == {f"urn:uuid:{i}": d for i, d in ((2, b"body"), (3, b""), (4, b""), (5, b"4\r\nbody\r\n0\r\n\r\n"), (6, b"a.b\r\n"), (8, b""), (9, b""), (10, b""))}
    assert all(r[3] is None and r[7] is None for r in rows)
    assert whole["urn:uuid:2"][4:7] == (4, hashlib.sha1(b"body").hexdigest(), "response") and whole["urn:uuid:2"][9] == "http://a"
    assert whole["urn:uuid:8"][4:9] == (None, hashlib.sha1(b"body").hexdigest(), "revisit", None, "urn:uuid:2")
    assert whole["urn:uuid:9"][4:9] == (None, None, "revisit", None, None)
    (tmp_path / "a.warc").write_bytes(foreign(zipped=zipped))
    assert warc.read(spark, [(tmp_path / "a.warc").as_uri()], chunk=3).count() == len(rows)
    for bad in (foreign(zipped=zipped)[:-3], foreign(b"xxxx", zipped)):
        with pytest.raises(ValueError):
            list(warc.read_chunks(io.BytesIO(bad)))


def test_a_line_without_end_is_damage(monkeypatch):
    monkeypatch.setattr(warc, "MOST_LINE", 1000)
    with pytest.raises(ValueError):
        list(warc.read_chunks(io.BytesIO(b"WARC/1.0 " + b"x" * 10**6)))


def test_identifiers_repeat(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ids = [{(r.record_id, r.page_id) for r in warc.chunk_table(df).select("record_id", "page_id").collect()} for df in (pages, pages.filter("page_id >= 0"))]
    assert ids[0] == ids[1] and len({i for i, _ in ids[0]}) == pages.count()
