import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing
from quarry.llm.common import numbered


def water_fill(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets by resharing the excess again and again; sizes in source order."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    while open_ and left > 1e-9:
        total = sum(weights[i % len(weights)] for i in open_)
        over = False
        for i in sorted(open_):
            out[i] += left * weights[i % len(weights)] / total
        left = 0.0
        for i in sorted(open_):
            if out[i] >= cap * sizes[i]:
                left += out[i] - cap * sizes[i]
                out[i] = float(cap * sizes[i])
                open_.discard(i)
                over = True
        if not over:
            break
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got):
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, s.encode() if s is not None else b""))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(words(r[1]))
    goal = dict(zip(order, water_fill([sum(by[s]) for s in order])))
    sizes = {s: sum(by[s]) for s in order}
    assert sorted((r.row) for r in got) == sorted({r.row for r in got}) and len(got) == len(rows)
    taken, key = defaultdict(int), {}
    for r in got:
        assert 0 <= r.copies <= 2
        key[r.source_size, round(r.target, 4)] = 1
        taken[r.target] += r.copies * r.size
    want = defaultdict(list)
    for s in order:
        want[round(goal[s], 4)].append(s)
    assert {k for k in key} == {(sizes[s], round(goal[s], 4)) for s in order}
    for target, n in taken.items():
        sources = want[round(target, 4)]
        slack = sum(max(by[s], default=0) for s in sources) + 1
        assert abs(n - target * len(sources)) <= slack


def test_words(spark):
    texts = ["", " ", "a", " a  b\t\nc ", " x y", "a\x0bb\x0cc\rd", "\x1ca b", "  \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.word_count(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == {t: words(t) for t in texts}


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in df.collect()]
    first = mixing.mix(df).collect()
    check([(r[0], r[1], r[2], r[3]) for r in rows], first)
    again = mixing.mix(df.repartition(3)).collect()
    pick = lambda out: sorted((r.doc_id, r.size, r.copies) for r in out)
    assert pick(first) == pick(again)


def test_odd_rows(docs):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 60)), "en", ["a", "é", None, "Z", "hot"][int(rng.integers(0, 5))]) for i in range(300)]
    rows += [(1000, "copy of one " * 5, "en", "hot")] * 1500  # one class in several parts
    rows += [(2000, None, "en", "a"), (None, "", "en", "none"), (2001, "x", "en", "tiny"), (2002, "w " * 30000, "en", "long"), (2003, "short", "en", "long")]
    df = docs(rows).withColumn("n", F.lit(1)).withColumn("LAM", F.lit("clash")).withColumn("row", F.lit("x"))
    check(rows, mixing.mix(df).collect())


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "a")], [(1, "one", "en", None)]])
def test_small(docs, rows):
    got = mixing.mix(docs(rows)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.copies <= 2 for r in got)


def slow_tilt(sizes, target, cap=2.0):
    """Rates of least relative entropy to the uniform rate cap / 2 in (0, cap) that meet the target: the dual by bisection."""
    mean = sum(sizes) / len(sizes)
    rates = lambda lam: [cap / (1 + math.exp(-max(-700.0, min(700.0, lam * z / mean)))) for z in sizes]
    low, high = -700.0, 700.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(r * z for r, z in zip(rates(middle), sizes)) < target else (low, middle)
    return rates((low + high) / 2)


def test_query_takes_the_tilted_optimum(spark):
    """The registered query: sizes and targets exactly, and copies as the rounded running sum of a slow solver's rates."""
    from quarry.llm.queries import op7_mixing

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op7_mixing(spark, sf).collect()}
    assert set(got) == set(docs)
    by = defaultdict(list)
    for i, r in docs.items():
        by[r.source].append((words(r.text), i))
    order = sorted(by, key=lambda s: (s is None, s))
    goals = water_fill([sum(z for z, _ in by[s]) for s in order])
    inner = 0
    for source, goal in zip(order, goals):
        rows = by[source]
        total = sum(z for z, _ in rows)
        for z, i in rows:
            assert (got[i].size, got[i].source_size) == (z, total) and got[i].target == pytest.approx(goal)
            assert got[i].taken in (0, z, 2 * z)
        if goal >= 2 * total:
            assert all(got[i].taken == 2 * z for z, i in rows)
            continue
        inner += 1
        sizes = sorted(z for z, _ in rows)
        rates = dict(zip(sizes, slow_tilt(sizes, goal)))
        running = copies = 0.0
        for z in sorted(set(sizes) - {0}):
            running += rates[z] * sizes.count(z)
            copies += sum(got[i].taken for y, i in rows if y == z) / z
            assert abs(copies - running) <= 1.0 + 1e-4 + sizes.count(0)
    assert inner >= 1


def test_texts_of_one_doc_id_do_not_depend_on_the_layout(docs):
    rows = [(7, f"w{i} " * 3, "en", ["a", "b"][i % 2]) for i in range(300)]
    pick = lambda df: sorted((r.text, r.copies) for r in mixing.mix(numbered(df, "row_"), row="row_").join(numbered(df, "row_").select(F.col("row_").alias("row"), "text"), "row").collect())
    a, b = docs(rows).coalesce(1), docs(rows[::-1]).coalesce(1)
    assert pick(a) == pick(b)
