"""Run statements: parse, bind, scan, build, execute, and report."""

from __future__ import annotations

import math
import threading
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession

from .errors import BindFailure, QueryError, TimedOut, quoted
from .operators.query import build
from .plans.binder import Bound, Output, SortKey, bind, bind_predicate, parse_aggregates, type_name
from .plans.explain import Step, explain
from .plans.parser import parse, parse_predicate
from .sources.catalog import Catalog, Kept, Table
from .sources.scan import rowgroup_scan, skipping_scan
from .sources.zonemap import fold

ENGINES = {"": "vectorized", "vectorized": "vectorized", "vec": "vectorized", "row": "row", "row-at-a-time": "row", "naive": "row"}
JSON_ROWS = 1000


@dataclass(frozen=True)
class Options:
    """`engine` row turns off vectorised decoding and code generation; `skip` and `prune` are
    switches for comparisons; `scan` is auto or rowgroup; `cap` bounds the rows returned after
    SQL's LIMIT; `timeout` is in seconds; `jobs` coalesces the scan to that many tasks."""

    engine: str = ""
    skip: bool = True
    prune: bool = True
    scan: str = "auto"
    cap: int | None = None
    timeout: float | None = None
    jobs: int = 0
    batch_size: int | None = None


@dataclass
class Result:
    columns: list[str]
    types: list[str]
    rows: list[Row]
    truncated: bool
    profile: dict
    plan: Step
    frame: DataFrame = field(repr=False)

    def json(self, cap: int = JSON_ROWS, with_plan: bool = True) -> dict:
        """The payload of the HTTP and command-line surfaces; cap 0 means all rows."""
        rows = self.rows[:cap] if cap else self.rows
        profile = dict(self.profile) | ({"plan": self.plan.json()} if with_plan else {})
        return {
            "columns": self.columns,
            "types": self.types,
            "rows": [[json_value(v) for v in r] for r in rows],
            "truncated": self.truncated or len(rows) < len(self.rows),
            "profile": profile,
        }

    def fingerprint(self, ordered: bool) -> list[str]:
        """Rows as text, sorted where order means nothing."""
        out = [" ".join(f"{c}={text_value(v)}" for c, v in zip(self.columns, r)) for r in self.rows]
        return out if ordered else sorted(out)

    def table(self) -> str:
        """Columns aligned with blanks; NULL is spelled out."""
        cells = [self.columns, *[[text_value(v) for v in r] for r in self.rows]]
        widths = [max(len(r[i]) for r in cells) for i in range(len(self.columns))]
        return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells)


def json_value(v: object) -> object:
    if isinstance(v, datetime):
        v = v if v.tzinfo is None else v.astimezone(timezone.utc).replace(tzinfo=None)
        return v.isoformat() + "Z"
    if isinstance(v, float) and not math.isfinite(v):
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).decode("utf-8", "replace")
    return v if v is None or isinstance(v, (bool, int, float, str)) else v.isoformat() if isinstance(v, date) else str(v)


def text_value(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%dT%H:%M:%S.") + f"{v.microsecond // 1000:03d}Z"
    if isinstance(v, bool):
        return str(v).lower()
    return str(json_value(v))


class Engine:
    """Statements over the tables of one directory."""

    def __init__(self, spark: SparkSession, data_dir: str | None = None):
        self.spark = spark
        self.catalog = Catalog(spark, data_dir)

    # From text to a bound query.

    def bind(self, sql: str) -> Bound:
        query = parse(sql)
        return bind(query, self.catalog[query.table].schema)

    def bind_aggregate(self, table: str, group: list[str], aggs: str, where: str = "", order: str = "", desc: bool = False, limit: int | None = None) -> Bound:
        """A grouped query from the parts that the `agg` command takes; keys come first in the result."""
        schema = self.catalog[table].schema
        types = {f.name: f.dataType for f in schema.fields}
        for key in group:
            if key not in types:
                raise BindFailure(f"unknown column {quoted(key)} in GROUP BY")
        if len(set(group)) < len(group):
            raise BindFailure("duplicate group key")
        found = parse_aggregates(aggs, types)
        outputs = tuple([Output(k, k) for k in group] + [Output(a.default_name, a) for a in found])
        if len({o.name for o in outputs}) < len(outputs):
            raise BindFailure("duplicate output column")
        node = parse_predicate(where)
        keys = []
        if order:
            name, _, way = order.partition(":")
            source = next((o.source for o in outputs if o.name == name), None)
            if source is None:
                raise BindFailure(f"unknown column {quoted(name)} in ORDER BY")
            keys.append(SortKey(source, desc or way.lower() == "desc", name))
        return Bound(table, schema, outputs, None if node is None else bind_predicate(node, types), tuple(group), tuple(keys), limit, True)

    def bind_scan(self, table: str, columns: list[str], where: str = "", limit: int | None = None) -> Bound:
        schema = self.catalog[table].schema
        types = {f.name: f.dataType for f in schema.fields}
        names = list(dict.fromkeys(c.strip() for c in columns if c.strip())) or list(types)
        for c in names:
            if c not in types:
                raise BindFailure(f"unknown column {quoted(c)} (have {', '.join(types)})")
        node = parse_predicate(where)
        return Bound(table, schema, tuple(Output(c, c) for c in names), None if node is None else bind_predicate(node, types), (), (), limit, False)

    # From a bound query to a DataFrame.

    def kept(self, q: Bound, table: Table, skip: bool = True) -> Kept:
        """What zone maps leave of the table, and the compressed bytes of the query's columns there."""
        return table.kept(fold(q.where) if skip else None, q.columns)

    def frame(self, q: Bound, options: Options = Options(), session: SparkSession | None = None) -> DataFrame:
        """The result as a DataFrame of `session`, or of the engine's; nothing runs. With skipping off, no footer is read."""
        table = self.catalog[q.table]
        session = session or self.spark
        if options.scan == "rowgroup":
            df = rowgroup_scan(table, self.kept(q, table, options.skip), q.columns if options.prune else q.schema.fieldNames(), session)
        elif options.skip and q.where is not None and table.inspectable:
            df = skipping_scan(table, self.kept(q, table), session)
        else:
            df = table.read(session=session)
        if options.jobs > 0:
            df = df.coalesce(options.jobs)
        return build(df, q)

    def sql(self, sql: str) -> DataFrame:
        """A statement as a DataFrame without reading footers: for use inside larger Spark programs."""
        q = self.bind(sql)
        return build(self.catalog[q.table].read(), q)

    def explain(self, q: Bound, options: Options = Options()) -> Step:
        return self._explained(q, self.kept(q, self.catalog[q.table], options.skip), options)

    def _explained(self, q: Bound, kept: Kept, options: Options) -> Step:
        return explain(q, files=len(self.catalog[q.table].files), groups=kept.total, kept=kept.count, jobs=options.jobs, prune=options.prune)

    # Execution.

    def session_for(self, options: Options) -> SparkSession:
        """The engine's session, or one of its own for options that need settings."""
        if options.engine.lower() not in ENGINES:
            raise QueryError(f"unknown engine {quoted(options.engine)} (want vectorized or row)")
        confs = {}
        if ENGINES[options.engine.lower()] == "row":
            confs |= {"spark.sql.parquet.enableVectorizedReader": "false", "spark.sql.codegen.wholeStage": "false"}
        if not options.skip:
            confs["spark.sql.parquet.filterPushdown"] = "false"
        if not options.prune:
            confs["spark.sql.optimizer.excludedRules"] = "org.apache.spark.sql.catalyst.optimizer.ColumnPruning"
        if options.batch_size:
            confs["spark.sql.parquet.columnarReaderBatchSize"] = str(options.batch_size)
        return configured(self.spark, confs)

    def run(self, query: str | Bound, options: Options = Options()) -> Result:
        """Run a statement within `options.timeout`, footers and planning included."""
        with deadline(self.spark, options.timeout):
            return self._run(query, options)

    def profile(self, query: str | Bound, options: Options = Options()) -> dict:
        """What a run reports, without its rows: each is made on the executors and counted there, and none comes to the driver."""
        with deadline(self.spark, options.timeout):
            return self._run(query, options, counted=True).profile

    def _run(self, query: str | Bound, options: Options, counted: bool = False) -> Result:
        if options.engine.lower() not in ENGINES:
            raise QueryError(f"unknown engine {quoted(options.engine)} (want vectorized or row)")
        engine = ENGINES[options.engine.lower()]
        q = self.bind(query) if isinstance(query, str) else query
        table = self.catalog[q.table]
        table.check()
        kept = self.kept(q, table, options.skip)
        plan = self._explained(q, kept, options)
        df = self.frame(q, options, self.session_for(options))
        shown = df if options.cap is None else df.limit(options.cap + 1)
        started = time.perf_counter()
        # Counting the rows of the plan itself leaves its columns and metrics as they are when they are collected.
        rows = [] if counted else shown.collect()
        emitted = shown._jdf.queryExecution().toRdd().count() if counted else len(rows)
        elapsed = (time.perf_counter() - started) * 1000
        read = scanned_rows(shown)
        truncated = options.cap is not None and emitted > options.cap
        if truncated:
            rows, emitted = rows[: options.cap], options.cap
        scan = plan.find("ParquetScan").facts
        size = kept.bytes if options.prune else kept.all_bytes
        # Scans through the Python source, or without metrics, count the rows of the kept groups.
        scan |= {"bytes_read": size, "rows_in": read if read is not None else kept.rows}
        profile = {
            "elapsed_ms": round(elapsed, 3),
            "engine": engine,
            "jobs": options.jobs,
            "rows_read": scan["rows_in"],
            "rows_emitted": emitted,
            "bytes_read": size,
            "row_groups_total": kept.total,
            "row_groups_read": scan["kept_row_groups"],
            "row_groups_skipped": scan["skipped_row_groups"],
            "columns_read": len(scan["columns"]),
        }
        return Result(df.columns, [type_name(f.dataType) for f in df.schema.fields], rows, truncated, profile, plan, df)


def configured(spark: SparkSession, confs: dict[str, str]) -> SparkSession:
    """A session with these settings beside those of `spark`, which itself does not change:
    other threads run on it."""
    if not confs:
        return spark
    own = spark.newSession()
    for k, v in {**spark.conf.getAll, **confs}.items():
        if own.conf.isModifiable(k):
            own.conf.set(k, v)
    return own


@contextmanager
def deadline(spark: SparkSession, seconds: float | None):
    """Cancel this thread's Spark jobs after so many seconds; work that ends later fails too."""
    if not seconds:
        yield
        return
    context, tag, late, over = spark.sparkContext, f"quarry-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def stop() -> None:
        if over.wait(seconds):
            return
        late.set()
        # Jobs that start after the first call are cancelled too.
        while not over.wait(0.05):
            context.cancelJobsWithTag(tag)

    watch = threading.Thread(target=stop, daemon=True)
    context.addJobTag(tag)
    watch.start()
    try:
        yield
    except Exception:
        if late.is_set():
            raise TimedOut("query timeout") from None
        raise
    finally:
        over.set()
        watch.join()
        context.removeJobTag(tag)
    if late.is_set():
        raise TimedOut("query timeout")


def scanned_rows(df: DataFrame) -> int | None:
    """Rows that the Parquet scan gave out, from the metrics of the plan that ran; None if there is no such scan."""
    found = []

    def walk(node) -> None:
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            metric = node.metrics().get("numOutputRows")
            if metric.isDefined():
                found.append(metric.get().value())
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif "QueryStage" in name:
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(found) if found else None
