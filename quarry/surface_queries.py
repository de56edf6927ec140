"""Registered queries over what is beside the statements: engines and switches, footers, result
forms, messages of the grammar, the command line and HTTP.

Each returns a small table of what the part answers; the checking SQL counts the same from the
tables, or lists what the dialect lays down (texts under EXPECTED are fixed values).
"""

from __future__ import annotations

import contextlib
import io
import json
import threading
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cli
from .engine import Engine, Options
from .errors import QueryError
from .plans.parser import parse
from .plans.words import REJECTED
from .sources.footer import size_text

TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()
INSPECTED = [("events", "event_id"), ("events", "user_id"), ("lineitem", "l_orderkey"), ("lineitem", "l_linenumber"), ("documents", "doc_id"), ("documents", "n_chars")]
GROUPED = "SELECT event_type, COUNT(*), SUM(user_id), MIN(value) FROM events WHERE user_id > 100 AND NOT event_type = 'view' GROUP BY event_type"
GROUPED_SQL = "SELECT event_type, COUNT(*) AS count, SUM(user_id)::BIGINT AS sum_user_id, MIN(value) AS min_value FROM events WHERE user_id > 100 AND NOT event_type = 'view' GROUP BY event_type"
FILTERED = "SELECT event_id, ts FROM events WHERE (user_id < 50 OR value > 90) AND event_type IN ('click', 'view')"
WINDOW = "SELECT COUNT(*), SUM(user_id) FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08'"
WINDOW_SQL = "SELECT COUNT(*) AS count, SUM(user_id)::BIGINT AS sum_user_id FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08'"

Query = Callable[[SparkSession, str], DataFrame]


def _through(sql: str, options: Options) -> Query:
    """A statement with engine options, in a session of its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, sf_dir)
        return engine.frame(engine.bind(sql), options, engine.session_for(options))

    return run


def _bound(bind: Callable[[Engine], object]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark, sf_dir)
        return engine.frame(bind(engine))

    return run


def _report(schema: str, work: Callable[[Engine], list[tuple]]) -> Query:
    """A small table of what `work` finds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame(work(Engine(spark, sf_dir)), schema)

    return run


def _text(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)}) t({columns})"


def single_file(engine: Engine) -> object:
    """The file of a table by its path, beside the catalog."""
    path = engine.catalog["events"].files[0][0]
    engine.catalog.tables["file"] = cli.single(engine, path, engine.spark.read.parquet(path))
    return engine.bind_scan("file", ["event_id", "user_id"], "event_type = 'click' AND user_id BETWEEN 5 AND 60", None)


def tables(engine: Engine) -> list[tuple]:
    return [(t["name"], t["files"], t["rows"], t["row_groups"] >= 1, t["compressed_bytes"] > 0) for t in (x.item() for x in engine.catalog.tables.values())]


def described(engine: Engine) -> list[tuple]:
    return [(t, f["name"], f["type"]) for t in ("events", "lineitem", "customer", "documents") for f in engine.catalog[t].info()["schema"]]


def inspected(engine: Engine) -> list[tuple]:
    """Values, nulls and bounds of whole-number columns from the footers."""
    out = []
    for table, column in INSPECTED:
        stats = [g.columns[column] for g in engine.catalog[table].groups]
        out.append((table, column, sum(s.values for s in stats), sum(s.nulls for s in stats), min(s.low for s in stats), max(s.high for s in stats)))
    return out


def profile(engine: Engine) -> list[tuple]:
    out = []
    for sql in ("SELECT COUNT(value) FROM events", "SELECT event_id, ts FROM events", "SELECT * FROM region", "SELECT COUNT(*) FROM events WHERE FALSE"):
        p = engine.profile(sql)
        out.append((sql, p["rows_read"], p["rows_emitted"], p["columns_read"], p["row_groups_read"] == p["row_groups_total"]))
    return out


def different_files(engine: Engine) -> list[tuple]:
    """What a table of two files with other columns says."""
    from .session import scratch

    folder = scratch(engine.spark, "schemas")
    engine.catalog["region"].read().coalesce(1).write.parquet(f"{folder}/odd")
    engine.catalog["nation"].read().coalesce(1).write.mode("append").parquet(f"{folder}/odd")
    try:
        Engine(engine.spark, folder).run("SELECT COUNT(*) FROM odd")
    except QueryError as e:
        return [(e.status, "schema of" in str(e) and "differs" in str(e))]
    return [(200, False)]


def text_table(engine: Engine) -> list[tuple]:
    lines = engine.run("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey").table().split("\n")
    return [(i, line) for i, line in enumerate(lines)]


def json_result(engine: Engine) -> list[tuple]:
    out = engine.run("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey", Options(cap=3)).json()
    return [("columns", json.dumps(out["columns"])), ("types", json.dumps(out["types"])), ("truncated", json.dumps(out["truncated"])), *[("row", json.dumps(r)) for r in out["rows"]]]


def fingerprint(engine: Engine) -> list[tuple]:
    return [(line,) for line in engine.run("SELECT event_type, COUNT(*) FROM events GROUP BY event_type").fingerprint(ordered=False)]


def capped(engine: Engine) -> list[tuple]:
    sql = "SELECT r_name FROM region"
    found = [(cap, engine.run(sql, Options(cap=cap))) for cap in (0, 2, 5, 9)]
    return [(cap, len(r.rows), r.truncated) for cap, r in found]


def timed_out(engine: Engine) -> list[tuple]:
    try:
        engine.run("SELECT l_orderkey, COUNT(*) FROM lineitem GROUP BY l_orderkey", Options(timeout=0.001))
    except QueryError as e:
        return [(e.status, str(e))]
    return [(200, "")]


def _failures(statements: list[str]) -> Callable[[Engine], list[tuple]]:
    def work(engine: Engine) -> list[tuple]:
        out = []
        for sql in statements:
            try:
                engine.bind(sql)
                out.append((sql, "ok", None))
            except QueryError as e:
                out.append((sql, str(e), e.position))
        return out

    return work


def rejected_words(engine: Engine) -> list[tuple]:
    return [(word, _failures([f"SELECT {word} a FROM events"])(engine)[0][1]) for word in REJECTED]


def printed(engine: Engine) -> list[tuple]:
    trees = [(sql, str(parse(sql))) for sql, _ in EXPECTED_TREES]
    return [(sql, text, parse(text) == parse(sql)) for sql, text in trees]


def engine_names(engine: Engine) -> list[tuple]:
    out = []
    for name, _ in EXPECTED_ENGINES:
        try:
            out.append((name, engine.run("SELECT COUNT(*) FROM region", Options(engine=name)).profile["engine"]))
        except QueryError as e:
            out.append((name, str(e)))
    return out


def explained(engine: Engine) -> list[tuple]:
    return [(sql, i, line) for sql, _ in EXPECTED_PLANS for i, line in enumerate(engine.explain(engine.bind(sql)).text().split("\n"))]


def explained_json(engine: Engine) -> list[tuple]:
    out = []
    for sql, _ in EXPECTED_PLANS:
        node, depth = engine.explain(engine.bind(sql)).json(), 0
        while node:
            out.append((sql, depth, node["op"]))
            node, depth = node.get("child"), depth + 1
    return out


def command_line(engine: Engine) -> list[tuple]:
    out = []
    for argv, _, _ in EXPECTED_COMMANDS:
        said, failed = io.StringIO(), io.StringIO()
        more = [] if argv in ("version", "nonsense") else ["--data-dir", engine.catalog.path]
        with contextlib.redirect_stdout(said), contextlib.redirect_stderr(failed):
            code = cli.main([*argv.split("|"), *more], engine.spark)
        lines = (said.getvalue() or failed.getvalue()).rstrip("\n").split("\n")
        out.append((argv, code, lines[0].rstrip() if code < 2 else ""))
    return out


def http(engine: Engine) -> list[tuple]:
    from .server import Settings, serve

    server = serve(engine, "127.0.0.1", 0, Settings())
    threading.Thread(target=server.serve_forever, daemon=True).start()
    out = []
    try:
        for method, path, body, _, _ in EXPECTED_ANSWERS:
            request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", body.encode() if body else None, method=method)
            try:
                with urllib.request.urlopen(request) as r:
                    status, raw = r.status, r.read()
            except urllib.error.HTTPError as e:
                status, raw = e.code, e.read()
            answer = json.loads(raw) if raw else {}
            if "error" in answer:
                said = answer["error"]
            elif "rows" in answer and "columns" in answer:
                said = json.dumps(answer["rows"])
            elif "text" in answer:
                said = answer["text"].split("\n")[0]
            elif "tables" in answer:
                said = " ".join(t["name"] for t in answer["tables"])
            else:
                said = str(answer.get("ok", answer.get("table", "")))
            out.append((method, path, body, status, said))
    finally:
        server.stop()
    return out


EXPECTED_FAILURES = [
    ("SELECT FROM events", 'parse error at column 8: expected expression, got "FROM"', 8),
    ("SELECT event_id", 'parse error at column 16: expected FROM, got "end of input"', 16),
    ("SELECT event_id FROM events LIMIT -1", 'parse error at column 35: expected integer LIMIT, got "-"', 35),
    ("SELECT event_id FROM events LIMIT 1.5", "parse error at column 35: LIMIT must be an integer", 35),
    ("SELECT event_id FROM events WHERE event_id IN ()", 'parse error at column 48: empty IN list, got ")"', 48),
    ("SELECT event_id % 2 FROM events", "parse error at column 17: unexpected '%'", 17),
    ("SELECT event_id FROM events, region", 'parse error at column 28: expected end of statement, got ","', 28),
]
EXPECTED_GATES = [
    ("SELECT event_id + 1 FROM events", "SELECT arithmetic not implemented in v1", None),
    ("SELECT 1 FROM events", "bare literals in SELECT are not executed in v1", None),
    ("SELECT event_id = 1 FROM events", "unsupported select expression (event_id = 1)", None),
    ("SELECT event_id FROM events WHERE event_id + 1 = 2", "arithmetic in WHERE not supported in v1", None),
    ("SELECT event_id FROM events WHERE COUNT(*) > 1", "aggregates are not allowed in WHERE", None),
    ("SELECT event_id FROM events WHERE event_id IN (user_id)", "IN list must contain literals", None),
    ("SELECT event_id FROM events WHERE event_id BETWEEN user_id AND 2", "BETWEEN bounds must be literals", None),
    ("SELECT event_id FROM events WHERE event_type = 1", "cannot compare utf8 column to int", None),
    ("SELECT event_id FROM events WHERE event_id", "event_id is not a predicate", None),
    ("SELECT SUM(event_type) FROM events", "SUM requires a numeric column, got utf8", None),
    ("SELECT user_id FROM events GROUP BY user_id, user_id", 'duplicate group key "user_id"', None),
    ("SELECT user_id FROM events GROUP BY 1", "GROUP BY must be a column name in v1", None),
    ("SELECT user_id FROM events GROUP BY user_id ORDER BY event_id", "ORDER BY event_id is not in SELECT/GROUP BY", None),
    ("SELECT event_id FROM events ORDER BY 1", "ORDER BY expression not supported in v1", None),
    ("SELECT COUNT(*) FROM events", "ok", None),
]
EXPECTED_TREES = [
    ("select event_id from events where not user_id = 1 or value > 2 and event_type <> 'it''s' -- why", "SELECT event_id FROM events WHERE ((NOT (user_id = 1)) OR ((value > 2) AND (event_type <> 'it''s')))"),
    ("SELECT COUNT(*) AS n, \"a b\" FROM t GROUP BY \"a b\" ORDER BY n DESC, \"a b\" LIMIT 3;", 'SELECT COUNT(*) AS n, "a b" FROM t GROUP BY "a b" ORDER BY n DESC, "a b" ASC LIMIT 3'),
]
EXPECTED_ENGINES = [("", "vectorized"), ("vec", "vectorized"), ("row-at-a-time", "row"), ("naive", "row"), ("gpu", 'unknown engine "gpu" (want vectorized or row)')]
EXPECTED_PLANS = [
    (
        "SELECT event_type, COUNT(*) FROM events WHERE user_id > 5 GROUP BY event_type ORDER BY event_type LIMIT 3",
        ["Limit 3", "  Sort event_type ASC", "    HashAggregate keys=[event_type] aggs=[count(*)]", "      ParquetScan table=events", "        files=1  row_groups=1  kept_row_groups=1  skipped=0", "        columns=[user_id, event_type]   -- pruned 4 cols", "        pushed=(user_id > 5)"],
    ),
    ("SELECT r_name FROM region WHERE FALSE", ["Project columns=[r_name]", "  Empty (constant false / all row groups skipped)", "    ParquetScan table=region", "      files=1  row_groups=1  kept_row_groups=0  skipped=1", "      columns=[r_name]   -- pruned 1 cols", "      pushed=(none)"]),
]
EXPECTED_COMMANDS = [
    ("version", 0, "quarry 0.1.0"),
    ("nonsense", 2, ""),
    ("sql|--bind-only|SELECT r_name FROM region", 0, "ok"),
    ("sql|SELECT zz FROM region", 1, 'error: unknown column "zz"'),
    ("sql|SELECT COUNT(*) FROM region|--engine|row", 0, "count"),
    ("sql|--ast|select r_name from region", 0, "SELECT r_name FROM region"),
    ("explain|SELECT COUNT(*) FROM region|--no-skip", 0, "HashAggregate keys=[(scalar)] aggs=[count(*)]"),
    ("agg|--table|region|--agg|count,min(r_name)|--order|count:desc", 0, "count  min_r_name"),
    ("scan|--table|region|--columns|r_name|--where|r_regionkey >= 3", 0, "r_name"),
    ("describe|region", 0, "table: region"),
]
EXPECTED_ANSWERS = [
    ("GET", "/health", "", 200, "True"),
    ("GET", "/tables", "", 200, " ".join(TABLES)),
    ("GET", "/tables/nation", "", 200, "nation"),
    ("GET", "/tables/none", "", 404, f'table "none" not found (have {", ".join(TABLES)})'),
    ("GET", "/bench", "", 404, "no benchmark results"),
    ("GET", "/elsewhere", "", 404, "not found"),
    ("POST", "/health", "{}", 405, "method not allowed"),
    ("POST", "/query", '{"sql": "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 1"}', 200, '[[0, "AFRICA"]]'),
    ("POST", "/query", '{"sql": " "}', 400, "sql is required"),
    ("POST", "/query", '{"sql": "SELECT r_name FROM"}', 400, 'parse error at column 19: expected table name, got "end of input"'),
    ("POST", "/explain", '{"sql": "SELECT r_name FROM region LIMIT 2"}', 200, "Limit 2"),
]

QUERIES: dict[str, Query] = {
    "e_row_engine": _through(GROUPED, Options(engine="row")),
    "e_row_filter": _through(FILTERED, Options(engine="naive")),
    "e_no_skip_no_prune": _through(WINDOW, Options(skip=False, prune=False)),
    "e_jobs": _through(GROUPED, Options(jobs=2)),
    "s_batch_size": _through(FILTERED, Options(batch_size=100)),
    "u_agg_parts": _bound(lambda e: e.bind_aggregate("events", ["event_type"], "count_star,sum(user_id),avg(value)", "user_id >= 10 AND event_type <> 'view'")),
    "u_scan_parts": _bound(lambda e: e.bind_scan("events", ["event_id", " ts", "event_id"], "value < 5 OR event_type = 'signup'")),
    "s_single_file": _bound(single_file),
    "c_tables": _report("name string, files long, rows long, has_groups boolean, has_bytes boolean", tables),
    "c_describe": _report("table_name string, column_name string, kind string", described),
    "c_inspect": _report("table_name string, column_name string, n long, nulls long, low long, high long", inspected),
    "s_scan_stats": _report("statement string, rows_read long, rows_emitted long, columns_read long, all_groups boolean", profile),
    "s_schema_check": _report("status long, says_so boolean", different_files),
    "s_text_table": _report("line long, text string", text_table),
    "s_json": _report("part string, text string", json_result),
    "s_fingerprint": _report("text string", fingerprint),
    "c_byte_text": _report("n long, text string", lambda e: [(n, size_text(n)) for n, _ in EXPECTED_SIZES]),
    "o_cap": _report("cap long, rows long, truncated boolean", capped),
    "e_timeout": _report("status long, text string", timed_out),
    "l_rejected_words": _report("word string, message string", rejected_words),
    "l_positions": _report("statement string, message string, pos long", _failures([x[0] for x in EXPECTED_FAILURES])),
    "l_gates": _report("statement string, message string, pos long", _failures([x[0] for x in EXPECTED_GATES])),
    "l_printing": _report("statement string, text string, same boolean", printed),
    "e_engine_names": _report("name string, found string", engine_names),
    "e_explain_text": _report("statement string, line long, text string", explained),
    "e_explain_json": _report("statement string, depth long, op string", explained_json),
    "u_command_line": _report("argv string, code long, first_line string", command_line),
    "h_http": _report("method string, path string, body string, status long, said string", http),
}
EXPECTED_SIZES = [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (1536, "1.5 KiB"), (204800, "200 KiB"), (5 << 20, "5.0 MiB"), (3 << 30, "3.0 GiB"), (150 << 40, "150 TiB")]
_KINDS = "CASE column_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'VARCHAR' THEN 'utf8' WHEN 'DOUBLE' THEN 'float64' ELSE 'timestamp[us]' END"


def oracle_sql() -> dict[str, str]:
    counted = " UNION ALL ".join(f"SELECT '{t}' AS name, 1 AS files, COUNT(*) AS rows, TRUE AS has_groups, TRUE AS has_bytes FROM {t}" for t in TABLES)
    kinds = " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, {_KINDS} AS kind FROM (DESCRIBE {t})" for t in ("events", "lineitem", "customer", "documents"))
    bounds = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) AS n, COUNT(*) - COUNT({c}) AS nulls, MIN({c})::BIGINT AS low, MAX({c})::BIGINT AS high FROM {t}" for t, c in INSPECTED)
    words = ", ".join(f"('{w}')" for w in REJECTED)
    return {
        "e_row_engine": GROUPED_SQL,
        "e_row_filter": FILTERED,
        "e_no_skip_no_prune": WINDOW_SQL,
        "e_jobs": GROUPED_SQL,
        "s_batch_size": FILTERED,
        "u_agg_parts": "SELECT event_type, COUNT(*) AS count, SUM(user_id)::BIGINT AS sum_user_id, AVG(value) AS avg_value FROM events WHERE user_id >= 10 AND event_type <> 'view' GROUP BY event_type",
        "u_scan_parts": "SELECT event_id, ts FROM events WHERE value < 5 OR event_type = 'signup'",
        "s_single_file": "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id BETWEEN 5 AND 60",
        "c_tables": counted,
        "c_describe": kinds,
        "c_inspect": bounds,
        "s_scan_stats": "SELECT 'SELECT COUNT(value) FROM events' AS statement, COUNT(*) AS rows_read, 1 AS rows_emitted, 1 AS columns_read, TRUE AS all_groups FROM events"
        " UNION ALL SELECT 'SELECT event_id, ts FROM events', COUNT(*), COUNT(*), 2, TRUE FROM events UNION ALL SELECT 'SELECT * FROM region', COUNT(*), COUNT(*), 2, TRUE FROM region"
        " UNION ALL SELECT 'SELECT COUNT(*) FROM events WHERE FALSE', 0, 1, 0, FALSE",
        "s_schema_check": "SELECT 500 AS status, TRUE AS says_so",
        "s_text_table": "SELECT 0 AS line, 'r_regionkey  r_name' AS text UNION ALL SELECT row_number() OVER (ORDER BY r_regionkey), rpad(r_regionkey::VARCHAR, 13, ' ') || r_name FROM region",
        "s_json": """SELECT 'columns' AS part, '["r_regionkey", "r_name"]' AS text UNION ALL SELECT 'types', '["int32", "utf8"]' UNION ALL SELECT 'truncated', 'true'
            UNION ALL SELECT 'row', '[' || r_regionkey || ', "' || r_name || '"]' FROM (SELECT * FROM region ORDER BY r_regionkey LIMIT 3)""",
        "s_fingerprint": "SELECT 'event_type=' || event_type || ' count=' || COUNT(*) AS text FROM events GROUP BY event_type",
        "c_byte_text": _values("n, text", EXPECTED_SIZES),
        "o_cap": "SELECT cap, LEAST(cap, n) AS rows, n > cap AS truncated FROM (VALUES (0), (2), (5), (9)) c(cap), (SELECT COUNT(*) AS n FROM region)",
        "e_timeout": "SELECT 504 AS status, 'query timeout' AS text",
        "l_rejected_words": f"SELECT word, word || ' not supported in v1' AS message FROM (VALUES {words}) t(word)",
        "l_positions": _values("statement, message, pos", EXPECTED_FAILURES),
        "l_gates": _values("statement, message, pos", EXPECTED_GATES),
        "l_printing": _values("statement, text, same", [(*x, True) for x in EXPECTED_TREES]),
        "e_engine_names": _values("name, found", EXPECTED_ENGINES),
        "e_explain_text": _values("statement, line, text", [(sql, i, line) for sql, lines in EXPECTED_PLANS for i, line in enumerate(lines)]),
        "e_explain_json": _values("statement, depth, op", [(EXPECTED_PLANS[0][0], i, op) for i, op in enumerate(("Limit", "Sort", "HashAggregate", "ParquetScan"))] + [(EXPECTED_PLANS[1][0], i, op) for i, op in enumerate(("Project", "Empty", "ParquetScan"))]),
        "u_command_line": _values("argv, code, first_line", EXPECTED_COMMANDS),
        "h_http": _values("method, path, body, status, said", EXPECTED_ANSWERS),
    }
