"""Command line: version, tables, describe, inspect, scan, agg, sql, explain, bench, help."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import __version__
from .engine import Engine, Options
from .errors import QueryError
from .plans.parser import parse
from .session import session
from .sources.catalog import DIR_VARIABLE, describe_text, inspect_text
from .sources.footer import read_footer, size_text

JOBS_VARIABLE = "QUARRY_PARALLELISM"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry", description="Analytics over directories of Parquet files.")
    verbs = top.add_subparsers(dest="verb", metavar="command")

    def verb(name: str, text: str, data: bool = True) -> argparse.ArgumentParser:
        p = verbs.add_parser(name, help=text)
        if data:
            p.add_argument("--data-dir", help=f"root of the tables (else ${DIR_VARIABLE}, else ./data/tables)")
        return p

    def running(p: argparse.ArgumentParser) -> None:
        p.add_argument("--engine", default="", help="vectorized or row")
        p.add_argument("--jobs", type=int, default=None, help=f"scan tasks (else ${JOBS_VARIABLE})")
        p.add_argument("--no-skip", action="store_true", help="read all row groups")
        p.add_argument("--no-prune", action="store_true", help="read all columns")
        p.add_argument("--batch-size", type=int, help="rows of a decoded batch")

    verb("version", "print the version", data=False)
    verb("help", "print this text", data=False)
    verb("tables", "list the tables")
    p = verb("describe", "schema, sizes and clustering of a table")
    p.add_argument("table")
    p.add_argument("--json", action="store_true")
    p = verb("inspect", "footers of a table or file")
    p.add_argument("table", nargs="?")
    p.add_argument("--file")
    p = verb("scan", "print rows")
    p.add_argument("--table")
    p.add_argument("--file")
    p.add_argument("--columns", default="")
    p.add_argument("--where", default="")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--batch-size", type=int)
    p = verb("agg", "aggregate without SQL")
    p.add_argument("--table", required=True)
    p.add_argument("--group", default="")
    p.add_argument("--agg", default="count")
    p.add_argument("--where", default="")
    p.add_argument("--order", default="", help="name[:desc]")
    p.add_argument("--desc", action="store_true")
    p.add_argument("--limit", type=int, default=20)
    running(p)
    for name, text in (("sql", "run a statement"), ("explain", "show a statement's plan")):
        p = verb(name, text)
        p.add_argument("text", nargs="?")
        p.add_argument("--file", help="read the statement from a file")
        p.add_argument("--ast", action="store_true", help="print the parsed statement and stop")
        p.add_argument("--bind-only", action="store_true", help="check names and types and stop")
        p.add_argument("--explain", action="store_true", default=name == "explain")
        p.add_argument("--analyze", action="store_true", help="run, and show what was read")
        p.add_argument("--json", action="store_true")
        p.add_argument("--json-limit", type=int, default=1000, help="rows in JSON; 0 for all")
        running(p)
    p = verb("bench", "run the benchmark protocol")
    p.add_argument("--scale", default="testdata")
    p.add_argument("--repeat", type=int, default=3)
    p.add_argument("--jobs", type=int, default=0)
    p.add_argument("--query", action="append", help="only this query id")
    p.add_argument("--out", help="write the report here")
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    top = parser()
    try:
        args = top.parse_args(sys.argv[1:] if argv is None else argv)
    except SystemExit as e:
        return int(e.code or 0)
    if args.verb in (None, "help"):
        top.print_help()
        return 0
    if args.verb == "version":
        print(f"quarry {__version__}")
        return 0
    try:
        return run(args, spark)
    except QueryError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except OSError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def options(args) -> Options:
    import os

    jobs = args.jobs if args.jobs is not None else int(os.environ.get(JOBS_VARIABLE) or 0)
    return Options(engine=args.engine, skip=not args.no_skip, prune=not args.no_prune, jobs=jobs, batch_size=args.batch_size)


def run(args, spark=None) -> int:
    if args.verb == "inspect" and args.file:
        print(inspect_text([read_footer(args.file)]))
        return 0
    if args.verb == "sql" and args.ast:
        print(parse(statement(args)))
        return 0
    engine = Engine(spark or session(), args.data_dir)
    if args.verb == "tables":
        tables = list(engine.catalog.tables.values())
        print(f"data dir: {engine.catalog.path}" if tables else f"no tables in {engine.catalog.path}")
        for t in tables:
            print(f"{t.name:<16} files={len(t.files)} rows={t.rows} row_groups={t.group_count} compressed={size_text(t.bytes)}")
    elif args.verb == "describe":
        table = engine.catalog[args.table]
        table.check()
        print(json.dumps(table.info(), indent=2) if args.json else describe_text(table))
    elif args.verb == "inspect":
        if not args.table:
            raise QueryError("a table or --file is needed")
        print(inspect_text(engine.catalog[args.table].footers))
    elif args.verb == "scan":
        scan(engine, args)
    elif args.verb == "agg":
        keys = [k.strip() for k in args.group.split(",") if k.strip()]
        q = engine.bind_aggregate(args.table, keys, args.agg, args.where, args.order, args.desc, args.limit or None)
        show(engine.run(q, options(args)))
    elif args.verb == "bench":
        bench(engine, args)
    else:
        query(engine, args)
    return 0


def statement(args) -> str:
    text = Path(args.file).read_text() if args.file else args.text
    if not text or not text.strip():
        raise QueryError("a statement or --file is needed")
    return text


def show(result) -> None:
    print(result.table())
    p = result.profile
    print(f"{p['rows_emitted']} rows  {p['elapsed_ms']} ms  read {p['rows_read']} rows, {size_text(p['bytes_read'])}, row groups {p['row_groups_read']}/{p['row_groups_total']} (skipped {p['row_groups_skipped']}), {p['columns_read']} columns", file=sys.stderr)


def scan(engine: Engine, args) -> None:
    columns = args.columns.split(",")
    if args.file:
        df = engine.spark.read.parquet(args.file)
        engine.catalog.tables["file"] = single(engine, args.file, df)
    elif not args.table:
        raise QueryError("--table or --file is needed")
    q = engine.bind_scan("file" if args.file else args.table, columns, args.where, args.limit or None)
    show(engine.run(q, Options(batch_size=args.batch_size)))


def single(engine: Engine, path: str, df):
    from .sources.catalog import Table, uri

    table = Table("file", uri(path), [(uri(path), 0, 0)], engine.spark)
    table.__dict__["schema"] = df.schema
    return table


def query(engine: Engine, args) -> None:
    text = statement(args)
    if args.ast:
        print(parse(text))
        return
    q = engine.bind(text)
    if args.bind_only:
        print("ok")
        return
    if args.explain and not args.analyze:
        plan = engine.explain(q, options(args))
        print(json.dumps(plan.json(), indent=2) if args.json else plan.text())
        return
    result = engine.run(q, options(args))
    if args.explain or args.analyze:
        print(json.dumps(result.plan.json(), indent=2) if args.json else result.plan.text())
    elif args.json:
        print(json.dumps(result.json(args.json_limit), indent=2))
    else:
        show(result)


def bench(engine: Engine, args) -> None:
    from .benchmark import report

    text = json.dumps(report(engine, args.scale, args.repeat, args.jobs, set(args.query or []) or None), indent=2)
    if args.out:
        Path(args.out).write_text(text + "\n")
    else:
        print(text)


if __name__ == "__main__":
    sys.exit(main())
