"""JSON over HTTP: health, tables, query, explain and benchmark results.

One Spark session serves all requests, each in a thread of its own under the
fair scheduler; a request past its time is cancelled. A request's body is always
read to its end before the answer, so a connection can be used again.
"""

from __future__ import annotations

import argparse
import json
import logging
import signal
import socket
import threading
import time
from contextlib import contextmanager
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import unquote, urlsplit

from . import __version__
from .engine import Engine, Options, deadline
from .errors import QueryError
from .session import session

SCAN_ROWS = 100
MOST_ROWS = 100_000
MOST_BODY = 1 << 20
#: Of a body that is too large, so much is read and left aside before the answer.
MOST_DRAINED = 64 << 20
PIECE = 1 << 16
#: Seconds: for a request's header, for each piece of its body, between requests, for writing beyond a query's own time, and for open requests when the server stops.
HEADER_TIME, BODY_TIME, IDLE_TIME, WRITE_TIME, GRACE_TIME = 10.0, 30.0, 60.0, 15.0, 5.0
PATHS = {"/health": "GET", "/tables": "GET", "/bench": "GET", "/query": "POST", "/explain": "POST"}


class BadRequest(Exception):
    """A request whose body cannot be told from what follows it; the connection ends with the answer."""


@dataclass
class Settings:
    timeout: float = 60.0
    origin: str = "*"
    jobs: int = 0
    bench_file: str | None = None


def row_cap(limit: int | None, grouped: bool) -> int:
    """Rows answered at most: the request's limit within MOST_ROWS, else MOST_ROWS for groups and SCAN_ROWS for rows."""
    if limit is None:
        return MOST_ROWS if grouped else SCAN_ROWS
    return MOST_ROWS if limit <= 0 else min(limit, MOST_ROWS)


def handler(engine: Engine, settings: Settings) -> type[BaseHTTPRequestHandler]:
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"
        timeout = IDLE_TIME

        def log_message(self, form: str, *args) -> None:
            logging.getLogger("quarry.server").info(form, *args)

        def parse_request(self) -> bool:
            self.connection.settimeout(HEADER_TIME)
            try:
                return super().parse_request()
            finally:
                self.connection.settimeout(BODY_TIME)

        def answer(self, status: int, payload: object = None) -> None:
            body = b"" if payload is None else json.dumps(payload).encode() + b"\n"
            self.send_response(status)
            for name, value in (
                ("Access-Control-Allow-Origin", settings.origin),
                ("Access-Control-Allow-Methods", "GET, POST, OPTIONS"),
                ("Access-Control-Allow-Headers", "Content-Type"),
                ("Access-Control-Max-Age", "86400"),
                ("Content-Type", "application/json; charset=utf-8"),
                ("Content-Length", str(len(body))),
            ):
                self.send_header(name, value)
            if self.close_connection:
                self.send_header("Connection", "close")
            self.connection.settimeout(settings.timeout + WRITE_TIME)
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)
            self.wfile.flush()
            self.connection.settimeout(IDLE_TIME)

        def guarded(self, work) -> None:
            try:
                self.answer(200, work())
            except QueryError as e:
                self.answer(e.status, {"error": str(e)} | ({} if e.position is None else {"pos": e.position}))
            except Exception as e:
                logging.getLogger("quarry.server").exception("request failed")
                self.answer(500, {"error": str(e).split("\n")[0]})

        def serve(self) -> None:
            """Read the body, then answer by path and method."""
            with self.server.busy():
                try:
                    raw = self.body()
                except BadRequest as e:
                    self.close_connection = True
                    self.answer(400, {"error": str(e)})
                    self.linger()
                    return
                except (TimeoutError, ConnectionError):
                    self.close_connection = True
                    return
                path = urlsplit(self.path).path.rstrip("/")
                wanted = "GET" if path.startswith("/tables/") else PATHS.get(path)
                if self.command == "OPTIONS":
                    self.answer(204)
                elif wanted is None:
                    self.answer(404, {"error": "not found"})
                elif wanted != ("GET" if self.command == "HEAD" else self.command):
                    self.answer(405, {"error": "method not allowed"})
                elif wanted == "GET":
                    self.read(path)
                else:
                    self.guarded(lambda: (query if path == "/query" else plan)(self.parsed(raw)))

        do_GET = do_HEAD = do_POST = do_PUT = do_PATCH = do_DELETE = do_OPTIONS = serve

        def read(self, path: str) -> None:
            if path == "/health":
                self.answer(200, {"ok": True, "version": __version__, "data_dir": engine.catalog.path})
            elif path == "/tables":
                self.guarded(lambda: {"data_dir": engine.catalog.path, "tables": [t.item() for t in fresh().tables.values()]})
            elif path == "/bench":
                file = Path(settings.bench_file) if settings.bench_file else None
                if file is None or not file.is_file():
                    self.answer(404, {"error": "no benchmark results"})
                else:
                    self.guarded(lambda: json.loads(file.read_text()))
            else:
                self.guarded(lambda: fresh()[unquote(path.removeprefix("/tables/"))].info())

        def body(self) -> bytes:
            """The whole body, or one byte more than MOST_BODY of a longer one, whose rest is read and left aside."""
            lengths = set(self.headers.get_all("Content-Length") or [])
            coding = self.headers.get("Transfer-Encoding")
            if coding is not None:
                if lengths or coding.strip().lower() != "chunked":
                    raise BadRequest("unsupported transfer coding")
                pieces = self.chunks()
            else:
                text = lengths.pop() if lengths else "0"
                if lengths or not (text.isascii() and text.isdigit()):
                    raise BadRequest("bad Content-Length")
                pieces = self.pieces(int(text))
            kept, size = b"", 0
            for piece in pieces:
                size += len(piece)
                if len(kept) <= MOST_BODY:
                    kept += piece[: MOST_BODY + 1 - len(kept)]
                if size > MOST_DRAINED:
                    raise BadRequest("invalid JSON: request body too large")
            return kept

        def pieces(self, size: int):
            while size:
                piece = self.rfile.read(min(PIECE, size))
                if not piece:
                    raise ConnectionError("the body ends early")
                size -= len(piece)
                yield piece

        def chunks(self):
            while True:
                size = self.rfile.readline(1024).split(b";")[0].strip()
                try:
                    n = int(size, 16) if size[:1] not in (b"+", b"-") else -1
                except ValueError:
                    n = -1
                if n < 0:
                    raise BadRequest("bad chunk size")
                if not n:
                    break
                yield from self.pieces(n)
                if self.rfile.readline(3) != b"\r\n":
                    raise BadRequest("bad chunk")
            while self.rfile.readline(PIECE).strip():
                pass

        def linger(self) -> None:
            """Let a client that is still writing get the answer: end our side, then read on for a while."""
            try:
                self.connection.shutdown(socket.SHUT_WR)
                self.connection.settimeout(1.0)
                until = time.monotonic() + GRACE_TIME
                while time.monotonic() < until and self.connection.recv(PIECE):
                    pass
            except OSError:
                pass

        def parsed(self, raw: bytes) -> dict:
            if len(raw) > MOST_BODY:
                raise QueryError("invalid JSON: request body too large")
            try:
                body = json.loads(raw) if raw.strip() else {}
            except (ValueError, RecursionError) as e:
                raise QueryError(f"invalid JSON: {e}") from None
            if not isinstance(body, dict):
                raise QueryError("invalid JSON: an object is expected")
            if not isinstance(body.get("sql"), str) or not body["sql"].strip():
                raise QueryError("sql is required")
            for name, kind in (("limit", int), ("jobs", int), ("engine", str), ("explain", bool), ("analyze", bool)):
                value = body.get(name)
                if value is not None and (not isinstance(value, kind) or kind is int and isinstance(value, bool)):
                    raise QueryError(f"invalid JSON: bad value for {name}")
            return body

    def fresh():
        with lock:
            return engine.catalog.reload()

    def choices(body: dict, grouped: bool) -> Options:
        jobs = body.get("jobs")
        return Options(engine=body.get("engine") or "", cap=row_cap(body.get("limit"), grouped), jobs=settings.jobs if jobs is None else jobs)

    def query(body: dict) -> dict:
        with deadline(engine.spark, settings.timeout):
            fresh()
            q = engine.bind(body["sql"])
            return engine.run(q, choices(body, q.grouped)).json(0, with_plan=bool(body.get("explain")))

    def plan(body: dict) -> dict:
        with deadline(engine.spark, settings.timeout):
            fresh()
            q = engine.bind(body["sql"])
            picked = choices(body, q.grouped)
            found = engine.run(q, picked).plan if body.get("analyze") else engine.explain(q, picked)
            return {"plan": found.json(), "text": found.text()}

    return Handler


class Server(ThreadingHTTPServer):
    """Counts the requests that are being answered, so that stopping can wait for them."""

    def __init__(self, *args):
        self._open, self._change = 0, threading.Condition()
        super().__init__(*args)

    @contextmanager
    def busy(self):
        with self._change:
            self._open += 1
        try:
            yield
        finally:
            with self._change:
                self._open -= 1
                self._change.notify_all()

    def stop(self, grace: float = GRACE_TIME) -> bool:
        """Take no more connections and wait for open requests; False if some are still open after `grace` seconds."""
        self.shutdown()
        self.server_close()
        with self._change:
            return self._change.wait_for(lambda: not self._open, grace)


def serve(engine: Engine, host: str, port: int, settings: Settings) -> Server:
    """A server bound to the address; the caller runs serve_forever()."""
    return Server((host, port), handler(engine, settings))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quarry-server")
    p.add_argument("--listen", default="127.0.0.1:8080")
    p.add_argument("--data-dir")
    p.add_argument("--timeout", type=float, default=60.0)
    p.add_argument("--cors-origin", default="*")
    p.add_argument("--jobs", type=int, default=0)
    p.add_argument("--bench-file")
    args = p.parse_args(argv)
    host, _, port = args.listen.rpartition(":")
    spark = session(**{"spark.scheduler.mode": "FAIR"})
    server = serve(Engine(spark, args.data_dir), host or "127.0.0.1", int(port), Settings(args.timeout, args.cors_origin, args.jobs, args.bench_file))
    over = threading.Event()
    for sig in (signal.SIGINT, signal.SIGTERM):
        signal.signal(sig, lambda *_: over.set())
    threading.Thread(target=server.serve_forever, daemon=True).start()
    over.wait()
    if not server.stop():
        spark.sparkContext.cancelAllJobs()
    spark.stop()


if __name__ == "__main__":
    main()
