"""Tables of a data directory.

A table is a sub-directory with Parquet files, or a single `<name>.parquet` (file
or directory). Spark's own file systems list them, so any store that Spark reads
will do; footers are read on demand, and only a store that Arrow reads too has them.
Footers of tables of few files are kept; those of others are reduced where they are
read to a few numbers a file, which are kept.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import CatalogFailure, NotFound, quoted
from ..plans import syntax
from ..plans.binder import predicate_columns, type_name
from .footer import DRIVER_FILES, Footer, RowGroup, map_footers, open_file, read_footers, size_text
from .zonemap import can_skip

#: Reductions of footers that a table of many files keeps.
REDUCED = 32
DEFAULT_DIR = "./data/tables"
DIR_VARIABLE = "QUARRY_DATA_DIR"


def data_dir(flag: str | None = None) -> str:
    """The flag, else the environment, else the default."""
    return flag or os.environ.get(DIR_VARIABLE) or DEFAULT_DIR


def uri(path: str) -> str:
    """The path as a URI; Hadoop prints local ones as file:/x."""
    return path if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else f"file://{os.path.abspath(path)}"


def list_dir(spark: SparkSession, path: str) -> list[tuple[str, bool, str, int, int]] | None:
    """(name, is directory, path, size, modified) of the entries, sorted by name; None if there is no such directory."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(uri(path))
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        return None
    entries = [(e.getPath().getName(), e.isDirectory(), e.getPath().toString(), e.getLen(), e.getModificationTime()) for e in fs.listStatus(where)]
    return sorted(entries)


def _data_files(entries) -> list[tuple[str, int, int]]:
    return [(path, size, when) for name, folder, path, size, when in entries if not folder and name.endswith(".parquet") and name[0] not in "._"]


@dataclass(frozen=True)
class KeptFile:
    """What a predicate leaves of a file: row groups, their rows, and their bytes of some columns and of all."""

    file: str
    total: int
    indices: tuple[int, ...]
    rows: int
    bytes: int
    all_bytes: int


@dataclass(frozen=True)
class Kept:
    """What a predicate leaves of a table; files without a row group left are not listed."""

    files: tuple[KeptFile, ...]
    total: int  # row groups of the table

    @property
    def count(self) -> int:
        return sum(len(f.indices) for f in self.files)

    @property
    def rows(self) -> int:
        return sum(f.rows for f in self.files)

    @property
    def bytes(self) -> int:
        return sum(f.bytes for f in self.files)

    @property
    def all_bytes(self) -> int:
        return sum(f.all_bytes for f in self.files)


def _kept_of(where: syntax.Node | None, columns: list[str]) -> Callable[[Footer], KeptFile]:
    def work(f: Footer) -> KeptFile:
        left = [g for g in f.groups if not can_skip(where, g)]
        size = sum(g.columns[c].bytes for g in left for c in columns if c in g.columns)
        return KeptFile(f.file, len(f.groups), tuple(g.index for g in left), sum(g.rows for g in left), size, sum(g.bytes for g in left))

    return work


def _totals_of(f: Footer) -> tuple[int, int, int, bytes]:
    return f.rows, f.bytes, len(f.groups), hashlib.sha256(repr(f.schema).encode()).digest()[:16]


def _rise_of(column: str) -> Callable[[Footer], tuple]:
    """(number of row groups, first minimum, last maximum, what is wrong) of a file; wrong is (group, maximum before, minimum)."""

    def work(f: Footer) -> tuple:
        last = None
        for i, g in enumerate(f.groups):
            st = g.columns.get(column)
            if st is None or not st.bounded:
                return len(f.groups), None, None, (i, None, None)
            if last is not None and st.low < last:
                return len(f.groups), None, None, (i, last, st.low)
            last = st.high
        first = f.groups[0].columns[column].low if f.groups else None
        return len(f.groups), first, last, None

    return work


def _span_of(column: str) -> Callable[[Footer], tuple | None]:
    """(least, greatest, whether all row groups state times) of a file; None for a file without row groups."""

    def work(f: Footer) -> tuple | None:
        stats = [g.columns.get(column) for g in f.groups]
        if any(st is None or not isinstance(st.low, datetime) or not st.bounded for st in stats):
            return None, None, False
        return (min(st.low for st in stats), max(st.high for st in stats), True) if stats else None

    return work


@dataclass
class Table:
    name: str
    path: str
    files: list[tuple[str, int, int]]  # (path, bytes, modified)
    spark: SparkSession = field(repr=False)

    @cached_property
    def schema(self) -> T.StructType:
        """From one footer; `check()` compares the others."""
        return self.spark.read.parquet(self.files[0][0]).schema

    @cached_property
    def _whole(self) -> DataFrame:
        """All rows; the files are listed once, as their footers are read once."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self, files: list[str] | None = None, session: SparkSession | None = None) -> DataFrame:
        """All rows, or those of the given files."""
        spark = session or self.spark
        if files is not None and not files:
            return spark.createDataFrame([], self.schema)
        if files is None and spark is self.spark:
            return self._whole
        return spark.read.schema(self.schema).parquet(*(files if files is not None else [self.path]))

    @cached_property
    def inspectable(self) -> bool:
        """Whether Arrow reads the store that the files are in; without that there are no zone maps."""
        try:
            open_file(self.files[0][0])
        except (pa.ArrowException, OSError):
            return False
        return True

    @cached_property
    def footers(self) -> list[Footer]:
        """All footers with all columns: for listings, and for tables of few files."""
        return read_footers([f[0] for f in self.files], self.spark)

    @cached_property
    def _reduced(self) -> dict:
        return {}

    def reduced(self, key: str, work: Callable[[Footer], object], columns: set[str]) -> list:
        """`work` of every footer, kept under `key` while the files are the same."""
        if len(self.files) <= DRIVER_FILES:
            return [work(f) for f in self.footers]
        if key not in self._reduced:
            while len(self._reduced) >= REDUCED:
                self._reduced.pop(next(iter(self._reduced)))
            self._reduced[key] = map_footers([f[0] for f in self.files], work, self.spark, columns)
        return self._reduced[key]

    @property
    def _totals(self) -> list[tuple]:
        return self.reduced("totals", _totals_of, set())

    @property
    def groups(self) -> list[RowGroup]:
        return [g for f in self.footers for g in f.groups]

    @property
    def rows(self) -> int:
        return sum(t[0] for t in self._totals)

    @property
    def bytes(self) -> int:
        return sum(t[1] for t in self._totals)

    @property
    def group_count(self) -> int:
        return sum(t[2] for t in self._totals)

    def kept(self, where: syntax.Node | None, columns: list[str]) -> Kept:
        """What zone maps leave for a bound and folded predicate (None: all), and the bytes of `columns` there.
        Footers are judged where they are read."""
        wanted = sorted({*columns, *predicate_columns(where)})
        found = self.reduced(f"kept {where!r} {wanted}", _kept_of(where, columns), set(wanted))
        return Kept(tuple(f for f in found if f.indices), sum(f.total for f in found))

    def check(self) -> None:
        """Every file must have the first one's columns, in order and of the same types."""
        for (file, _, _), total in zip(self.files, self._totals):
            if total[3] != self._totals[0][3]:
                raise CatalogFailure(f"table {quoted(self.name)}: schema of {os.path.basename(file)} differs from {os.path.basename(self.files[0][0])}")

    def clustering(self, column: str) -> tuple[bool, str]:
        """Whether each row group's minimum is at or above the last one's maximum, and why."""
        last, before, n = None, "", 0
        for (path, _, _), (count, low, high, wrong) in zip(self.files, self.reduced(f"rise {column}", _rise_of(column), {column})):
            name = os.path.basename(path)
            if wrong is not None and wrong[1] is None:
                return False, f"{column} has no bounds in row group {n + wrong[0]} ({name})"
            if wrong is not None:
                return False, f"{column} falls from {wrong[1]} in {name} to {wrong[2]} in {name}"
            if count and last is not None and low < last:
                return False, f"{column} falls from {last} in {before} to {low} in {name}"
            if count:
                last, before, n = high, name, n + count
        return True, "single row group" if n <= 1 else f"{column} rises over {n} row groups"

    def time_range_ms(self, column: str) -> tuple[int, int] | None:
        """Epoch milliseconds of the least minimum and greatest maximum, if all row groups state them."""
        spans = [s for s in self.reduced(f"span {column}", _span_of(column), {column}) if s is not None]
        if not spans or not all(s[2] for s in spans):
            return None
        ms = lambda v: (v - datetime(1970, 1, 1)) // timedelta(milliseconds=1)
        return ms(min(s[0] for s in spans)), ms(max(s[1] for s in spans))

    def item(self) -> dict:
        return {"name": self.name, "files": len(self.files), "rows": self.rows, "row_groups": self.group_count, "compressed_bytes": self.bytes}

    def info(self) -> dict:
        out = {"table": self.name, "dir": self.path, **{k: v for k, v in self.item().items() if k != "name"}}
        names = [f.name for f in self.schema.fields]
        if "ts" in names:
            span = self.time_range_ms("ts")
            if span:
                out["min_ts_ms"], out["max_ts_ms"] = span
            out["ts_clustering"] = self.clustering("ts")[1]
        out["schema"] = [{"name": f.name, "type": type_name(f.dataType)} for f in self.schema.fields]
        return out


class Catalog:
    """The tables of a directory; a missing directory has none. Reloading keeps tables whose files are the same."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, data_dir(path)
        self.tables: dict[str, Table] = {}
        self.reload()

    def reload(self) -> Catalog:
        found = {}
        for name, folder, path, size, when in list_dir(self.spark, self.path) or []:
            files = _data_files(list_dir(self.spark, path) or []) if folder else _data_files([(name, False, path, size, when)])
            if files:
                name = name.removesuffix(".parquet")
                old = self.tables.get(name)
                found[name] = old if old is not None and old.files == files else Table(name, path, files, self.spark)
        self.tables = dict(sorted(found.items()))
        return self

    def __getitem__(self, name: str) -> Table:
        if name not in self.tables:
            have = f" (have {', '.join(self.tables)})" if self.tables else ""
            raise NotFound(f"table {quoted(name)} not found{have}")
        return self.tables[name]


def describe_text(t: Table) -> str:
    lines = [f"table: {t.name}", f"dir: {t.path}", f"files: {len(t.files)}  rows: {t.rows}  row_groups: {t.group_count}  compressed: {size_text(t.bytes)}", "schema:"]
    lines += [f"  {f.name:<16} {type_name(f.dataType)}" for f in t.schema.fields]
    info = t.info()
    if "ts_clustering" in info:
        clustered, why = t.clustering("ts")
        lines.append(f"ts clustering: {why}" if clustered else f"ts clustering: not clustered ({why})")
    if "min_ts_ms" in info:
        lines.append(f"ts range: {info['min_ts_ms']} .. {info['max_ts_ms']}")
    lines.append("row groups:")
    for i, g in enumerate(t.groups):
        ts = g.columns.get("ts")
        span = f"  ts {ts.low} .. {ts.high}" if ts is not None and ts.bounded else ""
        lines.append(f"  [{i}] {os.path.basename(g.file)} rg={g.index} rows={g.rows}{span}")
    return "\n".join(lines)


def inspect_text(footers: list[Footer]) -> str:
    lines = []
    for f in footers:
        lines += [f"file {f.file}", f"  rows: {f.rows}  row groups: {len(f.groups)}  compressed: {size_text(f.bytes)}", "  schema:"]
        lines += [f"    {name:<16} {kind}" for name, kind in f.schema]
        for g in f.groups:
            lines.append(f"  row group {g.index}  rows={g.rows}  compressed={size_text(g.bytes)}")
            for name, st in g.columns.items():
                nulls = "?" if st.nulls is None else st.nulls
                span = f"  min={st.low} max={st.high}" if st.bounded else ""
                lines.append(f"    {name:<16} {size_text(st.bytes)}  values={st.values}  nulls={nulls}{span}")
    lines.append(f"totals: files={len(footers)} rows={sum(f.rows for f in footers)} row_groups={sum(len(f.groups) for f in footers)} compressed={size_text(sum(f.bytes for f in footers))}")
    return "\n".join(lines)
