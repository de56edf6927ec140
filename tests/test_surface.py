import json
import re
import socket
import threading
import urllib.error
import urllib.request

import pytest

from quarry import cli
from quarry.benchmark import cases, percentile, report, summary
from quarry.engine import Engine, Options
from quarry.errors import TimedOut
from quarry.server import Settings, row_cap, serve


@pytest.fixture(scope="module")
def call(spark, sf_dir):
    def run(*argv, code=0):
        assert cli.main([*argv], spark) == code

    return run


def test_cli(call, capsys, sf_dir, tmp_path):
    call("version")
    call("help")
    call("tables", "--data-dir", sf_dir)
    assert "nation           files=1 rows=25" in capsys.readouterr().out
    call("describe", "events", "--data-dir", sf_dir)
    out = capsys.readouterr().out
    assert "ts clustering: single row group" in out and "event_type       utf8" in out
    call("describe", "events", "--json", "--data-dir", sf_dir)
    assert json.loads(capsys.readouterr().out)["min_ts_ms"] > 1.7e12
    call("inspect", "--file", f"{sf_dir}/nation.parquet")
    assert "row group 0  rows=25" in capsys.readouterr().out
    call("scan", "--table", "nation", "--columns", "n_name", "--where", "n_nationkey < 2", "--data-dir", sf_dir)
    assert len(capsys.readouterr().out.strip().split("\n")) == 3
    call("scan", "--file", f"{sf_dir}/region.parquet", "--limit", "2")
    assert len(capsys.readouterr().out.strip().split("\n")) == 3
    call("agg", "--table", "nation", "--group", "n_regionkey", "--agg", "count,min(n_name)", "--order", "n_regionkey:desc", "--limit", "2", "--data-dir", sf_dir)
    assert capsys.readouterr().out.split("\n")[0].split() == ["n_regionkey", "count", "min_n_name"]
    sql = "SELECT r_name FROM region ORDER BY r_name LIMIT 1"
    call("sql", sql, "--data-dir", sf_dir)
    captured = capsys.readouterr()
    assert "AFRICA" in captured.out and "row groups 1/1" in captured.err
    call("sql", "--ast", sql)
    assert capsys.readouterr().out.strip() == "SELECT r_name FROM region ORDER BY r_name ASC LIMIT 1"
    (tmp_path / "q.sql").write_text(sql + ";")
    call("sql", "--file", str(tmp_path / "q.sql"), "--json", "--engine=row", "--data-dir", sf_dir)
    assert json.loads(capsys.readouterr().out)["rows"] == [["AFRICA"]]
    call("explain", sql, "--data-dir", sf_dir)
    assert "ParquetScan table=region" in capsys.readouterr().out
    call("explain", sql, "--analyze", "--json", "--data-dir", sf_dir)
    assert json.loads(capsys.readouterr().out)["op"] == "Limit"
    call("sql", "--bind-only", sql, "--data-dir", sf_dir)
    call("sql", "SELECT zz FROM region", "--data-dir", sf_dir, code=1)
    assert 'error: unknown column "zz"' in capsys.readouterr().err
    call("sql", "--data-dir", sf_dir, code=1)
    call("tables", "--data-dir", str(tmp_path / "none"))
    assert "no tables in" in capsys.readouterr().out
    assert cli.main(["nonsense"]) == 2


@pytest.fixture(scope="module")
def http(spark, sf_dir, tmp_path_factory):
    bench = tmp_path_factory.mktemp("bench") / "b.json"
    bench.write_text('{"schema": "x"}')
    server = serve(Engine(spark, sf_dir), "127.0.0.1", 0, Settings(timeout=60, bench_file=str(bench)))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None, method=None):
        data = body if isinstance(body, (bytes, type(None))) else json.dumps(body).encode()
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data, method=method)
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                raw = r.read()
                return r.status, json.loads(raw) if raw else None, r.headers
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read()), e.headers

    ask.port = server.server_port
    yield ask
    server.shutdown()
    server.server_close()


def test_http_reads(http):
    status, body, headers = http("/health")
    assert status == 200 and body["ok"] and headers["Access-Control-Allow-Origin"] == "*"
    assert "nation" in [t["name"] for t in http("/tables")[1]["tables"]]
    assert http("/tables/nation")[1]["rows"] == 25
    assert http("/tables/none")[0] == 404
    assert http("/bench")[1] == {"schema": "x"}
    assert http("/elsewhere")[0] == 404
    assert http("/query", method="OPTIONS")[0] == 204


def test_http_queries(http):
    status, body, _ = http("/query", {"sql": "SELECT event_id FROM events ORDER BY event_id"})
    assert status == 200 and len(body["rows"]) == 100 and body["truncated"] and "plan" not in body["profile"]
    body = http("/query", {"sql": "SELECT user_id, COUNT(*) FROM events GROUP BY user_id", "explain": True, "engine": "row", "jobs": 1})[1]
    assert not body["truncated"] and body["profile"]["plan"]["op"] == "HashAggregate"
    assert len(http("/query", {"sql": "SELECT event_id FROM events", "limit": 7})[1]["rows"]) == 7
    assert http("/explain", {"sql": "SELECT COUNT(*) FROM events"})[1]["text"].startswith("HashAggregate")
    assert "rows_in=1000" in http("/explain", {"sql": "SELECT COUNT(value) FROM events", "analyze": True})[1]["text"]


@pytest.mark.parametrize(
    "body,status,error",
    [
        (b"", 400, "sql is required"),
        ({"sql": " "}, 400, "sql is required"),
        (b"{", 400, "invalid JSON"),
        (b"[]", 400, "invalid JSON"),
        ({"sql": "SELECT 1", "limit": "x"}, 400, "invalid JSON"),
        ({"sql": "SELECT a FROM"}, 400, "parse error at column 14"),
        ({"sql": "SELECT zz FROM events"}, 400, "unknown column"),
        ({"sql": "SELECT a FROM zz"}, 404, "not found"),
        ({"sql": "SELECT COUNT(*) FROM events", "engine": "gpu"}, 400, "unknown engine"),
        (b" " * ((1 << 20) + 1), 400, "too large"),
    ],
)
def test_http_errors(http, body, status, error):
    got, answer, _ = http("/query", body, method="POST")
    assert got == status and error in answer["error"]
    if "column 14" in error:
        assert answer["pos"] == 14


def test_caps():
    assert [row_cap(*x) for x in ((None, False), (None, True), (0, False), (5, True), (10**9, False))] == [100, 100_000, 100_000, 5, 100_000]


def test_bench_protocol(spark, sf_dir):
    assert summary(9.0, [5.0, 1.0, 3.0]) == {"warmup_ms": 9.0, "runs_ms": [5.0, 1.0, 3.0], "first_run_ms": 5.0, "hot_median_ms": 2.0, "hot_p95_ms": 3.0}
    assert summary(1.0, [4.0])["hot_median_ms"] == 4.0
    assert percentile([1, 2, 3, 4], 0.5) == 2 and percentile([7], 0.95) == 7
    assert [c.id for c in cases()] == ["Q1", "Q2", "Q3", "Q4", "Q5", "Q6", "Q7", "Q8", "Q8-wide"]
    out = report(Engine(spark, sf_dir), "test", 1, only={"Q2"})
    assert [r["variant"] for r in out["results"]] == ["row-naive", "row-opt", "vectorized"]
    assert out["results"][0]["columns_read"] == 6 and out["results"][2]["columns_read"] == 2
    assert out["speedups"][0]["id"] == "Q2"


@pytest.fixture
def raw(http):
    """Send bytes on one connection and return all that comes back until the server ends it or is silent."""

    def send(*parts, wait=3.0):
        with socket.create_connection(("127.0.0.1", http.port), timeout=wait) as s:
            got = b""
            try:
                for p in parts:
                    s.sendall(p)
                while piece := s.recv(65536):
                    got += piece
            except TimeoutError:
                pass
            return got.decode()

    return send


def post(path, body, *more):
    return f"POST {path} HTTP/1.1\r\nHost: x\r\nContent-Length: {len(body)}\r\n".encode() + b"".join(m + b"\r\n" for m in more) + b"\r\n" + body


LAST = b"GET /health HTTP/1.1\r\nHost: x\r\nConnection: close\r\n\r\n"


def statuses(answer):
    return re.findall(r"(?m)^HTTP/1.1 (\d+)", answer)


def test_a_body_is_never_the_next_request(raw):
    inner = b"GET /tables HTTP/1.1\r\nHost: x\r\n\r\n"
    assert statuses(raw(post("/nowhere", inner), LAST)) == ["404", "200"]
    assert statuses(raw(post("/health", inner), LAST)) == ["405", "200"]
    assert statuses(raw(post("/query", inner), LAST)) == ["400", "200"]
    assert statuses(raw(post("/query", b" " * ((1 << 20) + 1)), LAST)) == ["400", "200"]
    assert statuses(raw(b"DELETE /tables HTTP/1.1\r\nHost: x\r\nContent-Length: 3\r\n\r\nabc", LAST)) == ["405", "200"]
    head = raw(b"HEAD /health HTTP/1.1\r\nHost: x\r\n\r\n", LAST)
    assert statuses(head) == ["200", "200"] and head.count('"ok"') == 1


def test_chunked_bodies(raw):
    head = b"POST /query HTTP/1.1\r\nHost: x\r\nTransfer-Encoding: chunked\r\n\r\n"
    body = b'{"sql": "SELECT r_name FROM region"}'
    good = head + b"%x;x=y\r\n%s\r\n1\r\n \r\n0\r\nTrailer: t\r\n\r\n" % (len(body), body)
    assert statuses(raw(good, LAST, wait=60)) == ["200", "200"]
    for bad in (b"zz\r\n", b"-1\r\n", b"2\r\nabc\r\n"):
        assert statuses(raw(head + bad, LAST)) == ["400"]


@pytest.mark.parametrize("length", [b"-5", b"x", b"1e3", b"3, 4", b"+2", "\u00b2".encode()])
def test_bad_lengths_end_the_connection(raw, length):
    answer = raw(b"POST /query HTTP/1.1\r\nHost: x\r\nContent-Length: " + length + b"\r\n\r\n", LAST)
    assert statuses(answer) == ["400"] and "Connection: close" in answer
    both = raw(post("/query", b"{}", b"Content-Length: 7"), LAST)
    assert statuses(both) == ["400"]


def test_large_bodies_are_answered(http):
    for size in [(1 << 20) + 1] * 30 + [8 << 20] * 8 + [(1 << 20) + 1000]:
        status, answer, _ = http("/query", b" " * size, method="POST")
        assert status == 400 and "too large" in answer["error"]


def test_stop_waits_for_open_requests(spark, sf_dir):
    server = serve(Engine(spark, sf_dir), "127.0.0.1", 0, Settings())
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with server.busy():
        assert not server.stop(0.1)
    assert server.stop(0.1)
    assert Settings().timeout == 60


def test_a_request_has_its_time(spark, sf_dir, monkeypatch):
    """The limit covers what comes before the query too, as reading footers."""
    import time

    engine = Engine(spark, sf_dir)
    monkeypatch.setattr(type(engine.catalog["region"]), "check", lambda self: time.sleep(1.0))
    with pytest.raises(TimedOut):
        engine.run("SELECT r_name FROM region", Options(timeout=0.3))
    server = serve(engine, "127.0.0.1", 0, Settings(timeout=0.3))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/query", b'{"sql": "SELECT r_name FROM region"}')
    assert e.value.code == 504
    assert server.stop()


def test_profiles_bring_no_rows_to_the_driver(spark, sf_dir, monkeypatch):
    engine = Engine(spark, sf_dir)
    statements = ["SELECT event_id, ts FROM events", "SELECT COUNT(value) FROM events", "SELECT user_id FROM events ORDER BY user_id LIMIT 7", "SELECT event_type, COUNT(*) FROM events GROUP BY event_type", "SELECT event_id FROM events WHERE FALSE"]
    want = [engine.run(sql, Options(cap=cap)).profile for sql in statements for cap in (None, 3)]
    monkeypatch.setattr(type(spark.range(1)), "collect", None)
    got = [engine.profile(sql, Options(cap=cap)) for sql in statements for cap in (None, 3)]
    assert [p | {"elapsed_ms": 0} for p in got] == [p | {"elapsed_ms": 0} for p in want]
