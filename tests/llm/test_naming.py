import hashlib
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import naming
from quarry.llm.common import numbered


def expected(rows):
    by = defaultdict(list)
    for i, r in enumerate(rows):
        by[r[1] or ""].append(r[0])
    low = lambda k: (k is not None, k or 0)
    return {t: (max(ids, key=low), len(ids)) for t, ids in by.items()}


def check(rows, got):
    want = expected(rows)
    assert len(got) == len(rows)
    assert sum(r.kept for r in got) == len(want)
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.body]
    for text, (best, _) in want.items():
        assert [r.doc_id for r in got if r.kept and r.body == text] == [best]


@pytest.mark.parametrize("block", [3, 4096])
def test_odd_rows(docs, block, monkeypatch):
    monkeypatch.setattr(naming, "BLOCK", block)
    rows = [(1, None), (2, ""), (3, "abc"), (4, "abcabc"), (5, "abcabc"), (6, "abcabcabc"), (7, "abcabcabcab"), (None, "abc"), (3, "abc"), (8, "é" * 50), (9, "é" * 50), (10, "é" * 49), (11, "abc" * 4000 + "x"), (12, "abc" * 4000 + "x"), (13, "abc" * 4000 + "y")]
    rows += [(100 + i, "hot text") for i in range(60)] + [(200 + i, "a\0b") for i in range(2)] + [(300, "a")]
    df = docs(rows).withColumn("kept", F.lit(1)).withColumn("NAME", F.lit("x")).withColumn("level", F.lit(1)).repartition(3)
    df, row = numbered(df, "r").cache(), "r"
    ids = naming.identities(df, row=row, keep={"body": F.coalesce("text", F.lit(""))}, block=block).collect()
    names = defaultdict(set)
    for r in ids:
        names[r.body].add((r.level, r.name))
    assert all(len(v) == 1 for v in names.values())
    assert len(set().union(*names.values())) == len(names)
    if block == 4096:
        check(rows, naming.groups(df, row=row, keep={"body": F.coalesce("text", F.lit(""))}).collect())


def test_empty_table(docs):
    assert naming.groups(docs([])).collect() == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab", max_size=14), min_size=1, max_size=25))
def test_any_texts(docs, texts):
    rows = list(enumerate(texts))
    df = docs(rows)
    ids = naming.identities(numbered(df, "r"), row="r", keep={"body": F.col("text")}, block=2).collect()
    assert len({(r.level, r.name) for r in ids}) == len(set(texts)) == len({(r.level, r.name, r.body) for r in ids})


def test_query(spark, sf_dir):
    from quarry.llm.queries import op5_exact_dedup

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = expected(list(texts.items()))
    for r in op5_exact_dedup(spark, sf_dir).collect():
        t = texts[r.doc_id]
        assert (r.keep_id, r.group_size, r.kept) == (*want[t], want[t][0] == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
