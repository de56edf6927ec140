"""Sharding along a Hilbert curve through several metadata dimensions.

Every dimension is quantised to `bits` bits between its least and greatest
value, rows are sorted by the index of their cell on the curve, and the order is
cut into runs of equal row counts. Neighbours on the curve are neighbours in all
dimensions, so a shard covers a small range of each and a filter on any of them
prunes files by their minimum and maximum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_workers, materialise, spare_name


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of rows of cell coordinates (rows, dims) below 2**bits.

    Skilling's transform: undo the rotations from the highest bit down, Gray-encode,
    then interleave the bits of all dimensions, highest first.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        turn ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def _number(column: str, kind: str) -> tuple[Column, bool]:
    """A dimension as a double, and whether its scale is logarithmic; dates and times are linear."""
    x = F.col(column)
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return x.cast("double"), True
    if kind == "boolean":
        return x.cast("int").cast("double"), False
    if kind == "date":
        return F.unix_date(x).cast("double"), False
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(x.cast("timestamp")).cast("double"), False
    raise ValueError(f"{column} has the type {kind}, which has no place on the curve")


def quantised(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """A cell number for each dimension; null is cell 0, NaN the last, infinities the first and last.

    One aggregation finds the bounds among finite values. Numbers are scaled by their logarithm
    above the minimum, booleans, dates and times (of either kind) linearly, strings by the six bytes
    after the prefix that all values share. Other types raise ValueError.
    """
    kinds = dict(df.dtypes)
    numbers = {d: _number(d, kinds[d]) for d in dims if kinds[d] != "string"}
    finite = {d: F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x) for d, (x, _) in numbers.items()}
    marks = df.agg(*[f(finite.get(d, F.col(d))).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top = (1 << bits) - 1
    out = []
    for i, d in enumerate(dims):
        lo, hi = marks[f"lo{i}"], marks[f"hi{i}"]
        if d not in numbers:
            if lo is None or lo == hi:
                out.append(F.lit(0))
                continue
            a, b = lo.encode(), hi.encode()
            skip = next((k for k, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))
            code = lambda v: int.from_bytes(v[skip : skip + 6].ljust(6, b"\0"), "big")  # noqa: E731, B023
            tail = F.substring(F.col(d).cast("binary"), skip + 1, 6)
            share = (F.conv(F.rpad(F.hex(tail), 12, "0"), 16, 10).cast("double") - F.lit(float(code(a)))) / F.lit(float(code(b) - code(a)) or 1.0)
        else:
            x, steep = numbers[d]
            lo, hi = (lo, hi) if lo is not None else (0.0, 0.0)
            wide = hi - lo
            above = F.least(F.greatest(x, F.lit(lo)), F.lit(hi)) - F.lit(lo)
            if not wide:
                share = F.lit(0.0)
            elif not np.isfinite(wide):
                share = above / 2 / F.lit(hi / 2 - lo / 2)
            else:
                share = F.log1p(above) / F.lit(float(np.log1p(wide))) if steep else above / F.lit(wide)
            share = F.when(F.isnan(x) | (x > F.lit(hi)), 1.0).when(x < F.lit(lo), 0.0).otherwise(share)
            share = F.when(x.isNull(), 0.0).otherwise(share)
        share = F.coalesce(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        out.append(F.floor(share * top + F.lit(0.5)).cast("int"))
    return out


def _indexed(dims: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            cells = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n - dims, n)], axis=1)
            curve = pa.array(hilbert_index(cells, bits))
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - dims], curve], names=[*batch.schema.names[: n - dims], "curve"])

    return run


def assign(df: DataFrame, dims: list[str], key: str, shards: int = 16, *, bits: int = 8, keep: list[str] | None = None) -> DataFrame:
    """Rows (`key`, the `keep` columns, curve, position, shard, slot) of all of `df`.

    Law: `rows`. With n rows, shard s holds the positions from s * n // shards up to
    the next shard's, so counts differ by one at most; slot counts from 0 in a shard.
    Rows of one cell are ordered by key (null first), then by the kept columns, so the
    assignment depends on the rows alone; identical rows are interchangeable. A null
    dimension is cell 0. An empty table gives no row. Only narrow columns are
    shuffled, by ranges of (curve, key, ...), which split a cell or key that many rows share.
    """
    ensure_workers(df.sparkSession)
    keep = [c for c in keep or [] if c != key]
    cells = quantised(df, dims, bits)
    names = [f"cell{i}_" for i in range(len(dims))]
    narrow = df.select(key, *keep, *[c.alias(n) for c, n in zip(cells, names)])
    schema = ", ".join([*[f"`{c}` {t}" for c, t in narrow.dtypes if c not in names], "curve long"])
    placed = narrow.mapInArrow(_indexed(len(dims), bits), schema)
    order = ["curve", key, *keep]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = spare_name(placed.columns, "tie")
    spread = placed.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *order, tie).sortWithinPartitions(*order, tie).drop(tie)
    spot = spare_name(placed.columns, "spot")
    stored = materialise(spread.withColumn(spot, F.monotonically_increasing_id()), "shard-order")
    # Upper bits: the range; lower bits: the place in it. One row per range is collected.
    counts = sorted((r[0], r[1]) for r in stored.groupBy(F.shiftright(spot, 33)).count().collect())
    total, starts = 0, []
    for part, n in counts:
        starts.append((part, total))
        total += n
    if not total:
        return stored.select(key, *keep, "curve", F.lit(0).cast("long").alias("position"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    bases = df.sparkSession.createDataFrame(starts, "part_ long, base_ long")
    joined = stored.join(F.broadcast(bases), F.shiftright(F.col(spot), 33) == F.col("part_"))  # one row per shuffle partition
    position = F.col("base_") + F.col(spot).bitwiseAND(F.lit((1 << 33) - 1))
    out = joined.withColumn("position", position).withColumn("shard", F.expr(f"cast(({shards} * (position + 1) - 1) div {total} as int)"))
    return out.select(key, *keep, "curve", "position", "shard", F.expr(f"position - (cast(shard as long) * {total}) div {shards}").alias("slot"))


def write_shards(df: DataFrame, assigned: DataFrame, key: str, folder: str) -> None:
    """Write whole rows into one folder per shard, in slot order; `key` must be unique in `df`.

    Dealt by shard and range of slots, so that a shard may be several files, each a run of the curve.
    """
    spots = assigned.select(F.col(key).alias("key_"), "shard", "slot")
    rows = df.join(spots, df[key].eqNullSafe(F.col("key_"))).drop("key_")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(folder)
