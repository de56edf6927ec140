"""Parquet footers: schema, row groups and column statistics, without reading pages.

The driver reads the footers of small tables in a thread pool. Beyond `DRIVER_FILES`
files the executors read them and reduce each to what is asked, one small value a file.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs

DRIVER_FILES = 64


@dataclass(frozen=True)
class ColumnStats:
    """Statistics of a column chunk; `low` and `high` are None where the footer has none, and
    `nulls` is None where it is not stated."""

    values: int
    nulls: int | None
    low: object = None
    high: object = None
    bytes: int = 0

    @property
    def bounded(self) -> bool:
        return self.low is not None and self.high is not None


@dataclass(frozen=True)
class RowGroup:
    file: str
    index: int
    rows: int
    bytes: int
    columns: dict[str, ColumnStats] = field(default_factory=dict)


@dataclass(frozen=True)
class Footer:
    file: str
    rows: int
    schema: tuple[tuple[str, str], ...]  # (name, Arrow type)
    groups: tuple[RowGroup, ...]

    @property
    def bytes(self) -> int:
        return sum(g.bytes for g in self.groups)


def open_file(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def plain(value: object) -> object:
    """A statistic as a comparable Python value; times are UTC without zone."""
    if isinstance(value, pd.Timestamp):
        value = value.to_pydatetime(warn=False)
    if isinstance(value, datetime) and value.tzinfo is not None:
        return value.astimezone(timezone.utc).replace(tzinfo=None)
    if isinstance(value, date) and not isinstance(value, datetime):
        return datetime(value.year, value.month, value.day)
    if isinstance(value, float) and value != value:
        return None
    return value


def type_text(kind: pa.DataType) -> str:
    return {"double": "float64", "float": "float32", "string": "utf8", "large_string": "utf8", "date32[day]": "date32"}.get(str(kind), str(kind))


def read_footer(uri: str, columns: set[str] | None = None) -> Footer:
    fs, path = open_file(uri)
    with fs.open_input_file(path) as f:
        meta = pq.ParquetFile(f).metadata
        schema = tuple((c.name, type_text(c.type)) for c in meta.schema.to_arrow_schema())
    groups = []
    for g in range(meta.num_row_groups):
        group, stats = meta.row_group(g), {}
        for c in range(group.num_columns):
            chunk = group.column(c)
            name = chunk.path_in_schema
            if columns is not None and name not in columns:
                continue
            st = chunk.statistics
            low = high = nulls = None
            if st is not None:
                nulls = st.null_count if st.has_null_count else None
                if st.has_min_max:
                    low, high = plain(st.min), plain(st.max)
            stats[name] = ColumnStats(chunk.num_values, nulls, low, high, chunk.total_compressed_size)
        size = sum(group.column(c).total_compressed_size for c in range(group.num_columns))
        groups.append(RowGroup(uri, g, group.num_rows, size, stats))
    return Footer(uri, meta.num_rows, schema, tuple(groups))


def map_footers(uris: list[str], work: Callable[[Footer], object], spark=None, columns: set[str] | None = None) -> list:
    """`work` of the footer of each file, in the order of `uris`. Its results should be small: they
    all come to the driver, which knows as many files as it is."""
    if spark is None or len(uris) <= DRIVER_FILES:
        with ThreadPoolExecutor(min(16, max(1, len(uris)))) as pool:
            return list(pool.map(lambda u: work(read_footer(u, columns)), uris))
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pickle.dumps(work(read_footer(u, columns))) for u in batch["uri"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["at"], pa.array(found, pa.binary())], names=["at", "found"])

    table = pa.table({"at": pa.array(range(len(uris)), pa.int64()), "uri": pa.array(uris, pa.string())})
    rows = spark.createDataFrame(table).repartition(min(1000, len(uris) // 16 + 1))
    found = rows.mapInArrow(run, "at long, found binary").collect()
    return [pickle.loads(bytes(r.found)) for r in sorted(found, key=lambda r: r.at)]


def read_footers(uris: list[str], spark=None, columns: set[str] | None = None) -> list[Footer]:
    """Whole footers in the order of `uris`: for listings, and for tables of few files."""
    return map_footers(uris, lambda f: f, spark, columns)


def size_text(n: int) -> str:
    """B, KiB, ... with one decimal below 100 of a unit."""
    if n < 1024:
        return f"{n} B"
    value = float(n)
    for unit in ("KiB", "MiB", "GiB", "TiB"):
        value /= 1024
        if value < 1024 or unit == "TiB":
            return f"{value:.0f} {unit}" if value >= 100 else f"{value:.1f} {unit}"
    raise AssertionError
