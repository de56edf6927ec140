import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def expected(rows, asks, k):
    whole = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(np.float32(x)) for x in v):
            continue
        whole.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    out = []
    for at, (i, q) in enumerate(whole):
        if asks(i):
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for other, (j, v) in enumerate(whole) if other != at and len(v) == len(q))
            out += [(i, n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, every=5, k=4):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("DIMS", F.lit(1)).withColumn("length", F.lit(None).cast("int")).repartition(3)
    return sorted(tuple(r) for r in topk.top_k(topk.quantised(df), F.pmod("vec_id", F.lit(every)) == 0, k).collect())


def made(seed, n=200, dims=6):
    rng = np.random.default_rng(seed)
    scale = rng.lognormal(0, 1, n)
    return [(i, (rng.normal(size=dims) * scale[i]).astype(float).tolist()) for i in range(n)]


@pytest.mark.parametrize("bucket,steep", [(4096, 0.7), (16, 0.0), (16, 2.0), (5, 0.5)])
def test_odd_rows(spark, bucket, steep, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "STEEP", steep)
    rows = made(1)
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # a hot vector: ties
    rows += [(2000, None), (2005, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2010, [float("nan")] * 6), (2015, [float("inf")] * 6), (None, [1.0] * 6), (2020, [0.0] * 6), (2025, [1.0, 2.0]), (2030, [3.0, 4.0]), (2035, []), (3000, [-5.0] * 6)]
    assert run(spark, rows) == expected(rows, lambda i: i % 5 == 0, 4)


def test_repeated_ids_and_small_tables(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])]
    assert run(spark, rows) == expected(rows, lambda i: i % 5 == 0, 4)
    assert run(spark, []) == []
    assert run(spark, [(5, [1.0])]) == []
    huge = [(0, [3e15, 3e15]), (1, [3e15, -3e15]), (2, [3e15, 3e15]), (3, [1e30, 1e30])]
    assert run(spark, huge[:3]) == expected(huge[:3], lambda i: i % 5 == 0, 4)
    assert len(run(spark, huge)) == 3


@pytest.mark.parametrize("seed", range(4))
def test_pruning_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    vecs = np.floor(rng.normal(size=(300, 5)) * rng.lognormal(3, 1, (300, 1))).astype(np.int64)
    lengths = topk.norms(vecs)
    unit = vecs / np.maximum(lengths, 1e-300)[:, None]
    pruned = 0
    for q in vecs[:40]:
        scores = vecs @ q
        for least in np.quantile(scores, [0.0, 0.5, 0.9, 0.99, 1.0]):
            some = set(topk.survivors(q, unit, lengths, least, lengths.max()))
            assert set(np.flatnonzero(scores >= least)) <= some
            pruned += len(vecs) - len(some)
    assert pruned > 0


def test_a_twin_row_is_a_candidate(spark):
    rows = [(100, [1.0, 0.0]), (100, [2.0, 0.0]), (1, [0.5, 0.0])]
    got = run(spark, rows, every=100)
    assert got == expected(rows, lambda i: i % 100 == 0, 4)
    assert [r[2] for r in got].count(100) == 2


def test_blocks_that_cannot_reach_are_not_met(spark, monkeypatch):
    """Lengths vary, so most pairs of a query block and a bucket are ruled out by length."""
    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    met, real = [], topk._pairs

    def watched(queries, buckets, k):
        every = queries.count() * buckets.count()
        some = queries.alias("q").join(buckets.alias("b"), F.col("q.need") <= F.col("b.length") * (1 + topk.SLACK)).count()
        met.append((some, every))
        return real(queries, buckets, k)

    monkeypatch.setattr(topk, "_pairs", watched)
    rows = made(5, 2000)
    assert run(spark, rows) == expected(rows, lambda i: i % 5 == 0, 4)
    (one, blocks), (some, every) = met
    assert one == blocks  # one bucket in the first pass
    assert some < 0.6 * every


def test_one_first_bucket_where_lengths_tie(spark, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 8)
    sizes, real = [], topk._pairs
    monkeypatch.setattr(topk, "_pairs", lambda q, b, k: sizes.append(b.count()) or real(q, b, k))
    rows = [(i, [float(i % 3 == j) for j in range(3)]) for i in range(100)]
    assert run(spark, rows) == expected(rows, lambda i: i % 5 == 0, 4)
    assert sizes[0] == 1 and sizes[1] > 10
