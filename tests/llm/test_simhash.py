import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import components, simhash


def slow_print(text):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in raw + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """{index: least index} by trying all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "É É É é", "x " * 50, "A\x0bb\x0cc\x1cd e", "the cat sat on the mat " * 9])
def test_fingerprint(text, monkeypatch):
    assert simhash.fingerprint(text) == slow_print(text)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == slow_print(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2))
def test_linked_prints_share_an_anchor(a, bits):
    def near(x):
        s = 0
        for i in range(63):
            s ^= (i + 1) * (x >> i & 1)
        return {x ^ m for m in simhash.flips()[s]}

    b = a
    for i in bits:
        b ^= 1 << i
    assert near(a) & near(b)


def test_columns_find_the_anchors(spark):
    values = [0, -1, 5, 2**62, -(2**63), 123456789123456789]
    df = spark.createDataFrame([(v,) for v in values], "print long").select("print", simhash.anchors("print").alias("a"))
    for r in df.collect():
        for a in r.a:
            assert ((r.print ^ a) & (2**64 - 1)).bit_count() <= 2
            s = 0
            for i in range(63):
                s ^= (i + 1) * (a >> i & 1)
            assert s == 0
        assert len(set(r.a)) in (2, 33)


def test_components_of_dense_groups(spark):
    rng = random.Random(3)
    prints = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        prints += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(60)]
    chain = rng.getrandbits(64)
    for b in range(0, 64, 2):
        prints.append(chain := chain ^ (3 << b))
    prints = sorted({p - 2**64 if p >> 63 else p for p in prints})
    want = slow_components([p & (2**64 - 1) for p in prints])
    df = spark.createDataFrame([(p,) for p in prints], "print long").repartition(5)
    got = {r.node: r.root for r in components.roots(simhash.links(df)).collect()}
    assert {p: got.get(p, p) for p in prints} == {p: prints[w] for p, w in zip(prints, want)}


def test_long_path_and_hub(spark):
    edges = [(i, i + 1) for i in range(1, 120)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (2, 1)]
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 121)} | {i: 1000 for i in range(1001, 1300)}
    assert components.roots(spark.createDataFrame([], "a long, b long")).collect() == []


def check(rows, got):
    prints = [slow_print(r[1]) for r in rows]
    root = slow_components(prints)
    least = {}
    for r, c in zip(rows, root):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    key = lambda x: (x[0] is not None, x[0] or 0, *map(str, x[1:]))
    want = sorted(((r[0], p, least.get(c)) for r, p, c in zip(rows, prints, root)), key=key)
    assert sorted(((r.doc_id, r.print & (2**64 - 1), r.component_id) for r in got), key=key) == want


def test_odd_rows(docs):
    base = "the quick brown fox jumps over the lazy dog again and again until night falls over the hill " * 8
    rows = [(9, None), (8, ""), (7, " \t"), (None, "only here x"), (None, base), (4, base), (4, base), (5, base + "end"), (6, base.upper()), (1, "a b"), (2, "A b"), (3, "b a"), (20, "word " * 30000)]
    df = docs(rows).withColumn("print", F.lit("x")).withColumn("ROOT", F.lit(1)).withColumn("row", F.lit(None).cast("string"))
    check(rows, simhash.components(df).collect())
    assert simhash.components(docs([])).collect() == []


def test_query(spark, sf_dir):
    from quarry.llm.queries import op3_simhash

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op3_simhash(spark, sf_dir).collect()
    assert len({r.component_id for r in got}) < len(got)
    prints = [slow_print(t) for _, t in rows]
    root = slow_components(prints)
    least = {}
    for (i, _), c in zip(rows, root):
        least[c] = min(i, least.get(c, i))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, root)}
    assert np.all([len(r.fingerprint) == 16 for r in got])


def test_a_hub_is_split(spark):
    """The star joins read written tables, so a node with most of the links is spread over tasks."""
    from quarry.llm import components

    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in confs}
    plans, real = [], components.materialise

    def watched(df, what):
        out = real(df, what)
        if what == "edges":
            # The same plan once more, as collect() lets its adaptive form be read.
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    n = 20000
    edges = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    edges = edges.unionByName(spark.range(n, n + 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    for k, v in confs.items():
        spark.conf.set(k, v)
    components.materialise = watched
    try:
        got = {r.node: r.root for r in components.roots(edges).collect()}
    finally:
        components.materialise = real
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {**{i: 0 for i in range(1, n)}, **{i: n for i in range(n + 1, n + 301)}}
    assert any("skew=true" in p for p in plans)
