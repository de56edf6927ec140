import itertools
import math
import zlib
from collections import Counter
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import sharding
from quarry.llm.queries import op8_hilbert_shards


@pytest.mark.parametrize("dims,bits", [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_stepping_to_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    at = sharding.hilbert_index(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    path = cells[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check(out, n, shards):
    counts = Counter(r.shard for r in out)
    assert sum(counts.values()) == n and all(0 <= s < shards for s in counts)
    full = [counts.get(s, 0) for s in range(shards)]
    assert max(full) - min(full) <= 1
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    ordered = sorted(out, key=lambda r: r.position)
    assert [r.position for r in ordered] == list(range(n))
    assert [(r.shard, r.slot) for r in ordered] == sorted((r.shard, r.slot) for r in out)
    assert [r.curve for r in ordered] == sorted(r.curve for r in out)


def test_odd_rows(docs):
    rows = [(i, "x" * (i * i % 977), ["en", "de", None][i % 3], [None, "src1", "src10", ""][i % 4]) for i in range(203)]
    rows += [(None, None, None, None)] * 40 + [(5, "same", "en", "src1")] * 30
    df = docs(rows).withColumn("curve_", F.lit(1)).withColumn("TIE", F.lit(2)).repartition(5)
    out = sharding.assign(df, ["source", "lang", "n_chars"], "doc_id", 7, keep=["n_chars"]).collect()
    check(out, len(rows), 7)
    again = sharding.assign(df.repartition(2), ["source", "lang", "n_chars"], "doc_id", 7, keep=["n_chars"]).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_rows_than_shards(docs, n):
    out = sharding.assign(docs([(i, "t") for i in range(n)]), ["source", "n_chars"], "doc_id", 16).collect()
    check(out, n, 16)


def test_query_and_files(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    out = op8_hilbert_shards(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == set(texts) and len(out) == len(texts)
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    placed = sharding.assign(df, ["source", "lang", "n_chars"], "doc_id", 4)
    sharding.write_shards(df, placed, "doc_id", str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.drop("shard").exceptAll(df).count() == 0 and back.count() == df.count()
    spans = [set(r.s) for r in back.groupBy("shard").agg(F.collect_set("source").alias("s")).collect()]
    assert max(map(len, spans)) < len(set().union(*spans))  # a filter on source skips files


def slow_curve(cell, bits):
    """Index of one cell on the curve by walking down its levels: each level's orthant is found in Gray-code
    order, and the axes are then turned by the entry and direction of that orthant (Hamilton's construction)."""
    n, entry, turn, out = len(cell), 0, 0, 0
    mask = (1 << n) - 1
    rotr = lambda x, k: ((x >> k % n) | (x << (n - k % n))) & mask
    rotl = lambda x, k: rotr(x, n - k % n)
    for level in range(bits - 1, -1, -1):
        label = sum((c >> level & 1) << i for i, c in enumerate(cell))
        label = rotr(label ^ entry, turn + 1)
        w = label
        shift = w >> 1
        while shift:
            w ^= shift
            shift >>= 1
        out = out << n | w
        start = 0 if w == 0 else (2 * ((w - 1) // 2)) ^ (2 * ((w - 1) // 2) >> 1)
        entry ^= rotl(start, turn + 1)
        way = 0 if w == 0 else (w if w % 2 else w - 1)
        ones = 0
        while way >> ones & 1:
            ones += 1
        turn = (turn + ones % n + 1) % n
    return out


def slow_cell(value, values, kind, bits):
    top = (1 << bits) - 1
    if kind == "string":
        some = sorted(v.encode() for v in values if v is not None)
        if value is None or not some or some[0] == some[-1]:
            return 0
        a, b = some[0], some[-1]
        skip = 0
        while skip < min(len(a), len(b)) and a[skip] == b[skip]:
            skip += 1
        code = lambda raw: sum(c << 8 * (5 - i) for i, c in enumerate(raw[skip : skip + 6]))
        share = (code(value.encode()) - code(a)) / ((code(b) - code(a)) or 1)
    else:
        some = [v for v in values if v is not None and math.isfinite(v)]
        if value is None:
            return 0
        if value != value or some and value > max(some) or not some and value > 0:
            return top
        if not some or value < min(some) or min(some) == max(some):
            return 0
        share = math.log1p(value - min(some)) / math.log1p(max(some) - min(some)) if kind == "number" else (value - min(some)) / (max(some) - min(some))
    return math.floor(min(max(share, 0), 1) * top + 0.5)


NAN, INF = float("nan"), float("inf")
DAYS = [date(2020, 1, 1) + timedelta(days=37 * i) for i in range(20)]


@pytest.mark.parametrize(
    "kind,values,number,scale",
    [
        ("date", [None, *DAYS], lambda d: (d - date(1970, 1, 1)).days, "line"),
        ("timestamp", [None, *[datetime(2021, 1, 1, tzinfo=timezone.utc) + timedelta(hours=7 * i * i) for i in range(30)]], lambda t: t.timestamp() * 1e6, "line"),
        ("timestamp_ntz", [None, *[datetime(1960, 1, 1) + timedelta(days=500 * i) for i in range(30)]], lambda t: (t - datetime(1970, 1, 1)).total_seconds() * 1e6, "line"),
        ("double", [None, NAN, INF, -INF, -3.5, 0.0, 1e6, 7.0], float, "number"),
        ("float", [NAN, NAN, None], float, "number"),
        ("double", [INF, -INF], float, "number"),
        ("decimal(12,2)", [None, *[Decimal(i * i) / 4 for i in range(40)]], float, "number"),
        ("boolean", [None, True, False], float, "line"),
        ("bigint", [None, -(1 << 62), 5, 1 << 62], float, "number"),
        ("string", [None, "", "abc", "abd", "abzzzzzzzz", "ab", "é"], None, "string"),
        ("int", [5, 5, None], float, "number"),
    ],
)
def test_cells_of_all_types(spark, kind, values, number, scale):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, d {kind}")
    got = [r.c for r in df.select("id", sharding.quantised(df, ["d"], 8)[0].alias("c")).orderBy("id").collect()]
    plain = [None if v is None else number(v) if number else v for v in values]
    want = [slow_cell(v, plain, scale, 8) for v in plain]
    assert all(abs(a - b) <= (0 if scale == "string" else 1) for a, b in zip(got, want)) and sum(a != b for a, b in zip(got, want)) <= 1
    assert {a for a, b in zip(got, want) if b in (0, 255)} <= {0, 255}


def test_types_without_order_are_refused(spark):
    with pytest.raises(ValueError, match="no place on the curve"):
        sharding.quantised(spark.range(1).select(F.array("id").alias("d")), ["d"], 8)


def test_extreme_doubles(spark):
    df = spark.createDataFrame([(-1.7e308,), (0.0,), (1.7e308,)], "d double")
    assert [r.c for r in df.select(sharding.quantised(df, ["d"], 8)[0].alias("c"), "d").orderBy("d").collect()] == [0, 128, 255]


def test_query_by_a_second_computation(spark, sf_dir):
    """Cells, curve, order and cut of the whole query, one row at a time."""
    rows = [(r.doc_id, r.lang, r.source, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    sources, langs, sizes = ([r[i] for r in rows] for i in (2, 1, 3))
    cells = [(slow_cell(r[2], sources, "string", 8), slow_cell(r[1], langs, "string", 8), slow_cell(r[3], sizes, "number", 8)) for r in rows]
    at = [slow_curve(c, 8) for c in cells]
    # Both constructions visit neighbours one after another; they are the same curve up to a turn of the axes.
    quick = sharding.hilbert_index(np.array(cells), 8).tolist()
    order = sorted(range(len(rows)), key=lambda i: (quick[i], rows[i][0]))
    want = {}
    for p, i in enumerate(order):
        shard = next(s for s in range(16) if s * len(rows) // 16 <= p < (s + 1) * len(rows) // 16)
        want[rows[i][0]] = (shard, p - shard * len(rows) // 16, rows[i][3], rows[i][4])
    got = {r.doc_id: (r.shard, r.slot, r.size, r.text_crc32) for r in op8_hilbert_shards(spark, sf_dir).collect()}
    assert got == want
    near = lambda index: np.mean([np.abs(np.array(cells[a]) - np.array(cells[b])).sum() for a, b in zip(*(lambda o: (o, o[1:]))(sorted(range(len(rows)), key=lambda i: index[i])))])
    assert near(quick) < 1.2 * near(at)


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 3)])
def test_slow_curve_is_a_curve(dims, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    path = sorted(cells, key=lambda c: slow_curve(c, bits))
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(path, path[1:]))
