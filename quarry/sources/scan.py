"""Scans that read only the row groups a predicate needs.

Spark skips row groups by numbers, strings and times with zone, but not by times
without zone. `skipping_scan` closes that gap: it drops whole files, and inside the
kept ones adds a condition on a companion column, a whole number or string whose
values rise from row group to row group, that every row of a kept group meets.
`rowgroup_scan` reads exactly the kept row groups through a Python data source.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.predicates import column, literal
from .catalog import Kept, Table
from .footer import DRIVER_FILES, RowGroup, open_file, read_footers

#: Runs of neighbouring row groups that a companion condition lists at most.
MOST_RUNS = 64


def companion(table: Table, groups: list[RowGroup], names: set[tuple[str, int]]) -> Column | None:
    """A condition that holds for all rows of the named groups, or None if no column gives a sound one.

    `groups` are all row groups of the files to read. Sound means: the column has bounds and no
    NULL in every named group; it is worth adding if it excludes some group that was not named.
    """
    kept = [g for g in groups if (g.file, g.index) in names]
    rest = [g for g in groups if (g.file, g.index) not in names]
    best, most = None, 0
    for f in table.schema.fields if rest else ():
        if not isinstance(f.dataType, (T.IntegralType, T.StringType)):
            continue
        stats = [g.columns.get(f.name) for g in kept]
        if any(st is None or not st.bounded or st.nulls != 0 for st in stats):
            continue
        # Neighbouring kept groups form a run with one range.
        marked = [((g.file, g.index) in names, g.columns[f.name]) for g in groups if f.name in g.columns]
        runs = [[st for _, st in run] for chosen, run in groupby(marked, key=lambda m: m[0]) if chosen]
        ranges = [(min(st.low for st in run), max(st.high for st in run)) for run in runs]
        if len(ranges) > MOST_RUNS:
            ranges = [(min(r[0] for r in ranges), max(r[1] for r in ranges))]
        excluded = sum(1 for g in rest if (st := g.columns.get(f.name)) is not None and st.bounded and all(st.high < a or st.low > b for a, b in ranges))
        if excluded > most:
            col = column(f.name)
            best, most = reduce(lambda a, b: a | b, [(col >= literal(a)) & (col <= literal(b)) for a, b in ranges]), excluded
    return best


def skipping_scan(table: Table, kept: Kept, session: SparkSession) -> DataFrame:
    """The kept files; in those that are kept in part, up to DRIVER_FILES of them, a companion condition too."""
    if kept.count == kept.total:
        return table.read(session=session)
    names = [f.file for f in kept.files]
    part = [f.file for f in kept.files if len(f.indices) < f.total]
    if not part or len(part) > DRIVER_FILES:
        return table.read(names, session)
    few = names if len(names) <= DRIVER_FILES else part
    footers = table.footers if len(table.files) <= DRIVER_FILES else read_footers(few)
    groups = [g for f in footers for g in f.groups if f.file in set(few)]
    extra = companion(table, groups, {(f.file, i) for f in kept.files for i in f.indices})
    if extra is None:
        return table.read(names, session)
    df = table.read(few, session).filter(extra)
    whole = [f for f in names if f not in set(few)]
    return df.unionAll(table.read(whole, session)) if whole else df


class _Group(InputPartition):
    def __init__(self, file: str, index: int):
        super().__init__(None)
        self.file, self.index = file, index


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names = schema.fieldNames()
        self.groups = [line.rsplit("|", 1) for line in options.get("groups", "").split("\n") if line]

    def partitions(self) -> list[InputPartition]:
        # A source without rows still needs a partition.
        return [_Group(file, int(i)) for file, i in self.groups] or [_Group("", -1)]

    def read(self, partition: _Group) -> Iterator:
        if partition.index < 0:
            return
        fs, path = open_file(partition.file)
        with fs.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(row_groups=[partition.index], columns=self.names)


class RowGroupSource(DataSource):
    """Option `groups`: lines of file|row group; the schema names the columns to read."""

    @classmethod
    def name(cls) -> str:
        return "quarry_row_groups"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options)


def rowgroup_scan(table: Table, kept: Kept, columns: list[str], session: SparkSession) -> DataFrame:
    """Exactly the kept row groups, one task each, and of them only `columns` (at least one)."""
    session.dataSource.register(RowGroupSource)
    fields = [f for f in table.schema.fields if f.name in columns] or table.schema.fields[:1]
    lines = "\n".join(f"{f.file}|{i}" for f in kept.files for i in f.indices)
    return session.read.format(RowGroupSource.name()).schema(T.StructType(fields)).option("groups", lines).load()
