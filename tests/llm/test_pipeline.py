from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp

from .test_mixing import water_fill, words
from .test_nearcopies import keep_unlike


def keep_distinct(rows):
    best = {}
    for r in rows:
        if r.text not in best or (best[r.text].doc_id or -1) < (r.doc_id or -1):
            best[r.text] = r
    return sorted(best.values(), key=str)


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = sorted(docs.collect(), key=str)
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = sorted(docs.collect(), key=str)
        if name == "language_id":
            assert not set(after) - set(before) and len(after) >= 0.99 * len(before)
        elif name == "exact_dedup":
            assert after == keep_distinct(before) and len(after) < len(before)
        elif name == "near_dedup":
            assert after == keep_unlike(before)
        elif name == "mixing":
            assert set(after) <= set(before)
            times = Counter(after)
            assert max(times.values()) <= 2
            by, got, largest = defaultdict(int), defaultdict(int), defaultdict(int)
            for r in before:
                by[r.source] += words(r.text)
                got[r.source] += times[r] * words(r.text)
                largest[r.source] = max(largest[r.source], words(r.text))
            order = sorted(by)
            for s, target in zip(order, water_fill([by[s] for s in order])):
                assert abs(got[s] - target) <= largest[s] + 1
        else:
            enc = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = Counter((r.doc_id, len(enc.encode(r.text, add_special_tokens=False).ids) + 1) for r in before)
            pieces, lengths = Counter(), defaultdict(int)
            for p in after:
                lengths[p.doc_id] += p.length
                if p.start == 0:
                    pieces[p.doc_id, p.doc_tokens] += 1
            assert pieces == want
            assert all(lengths[d] == sum(n * c for (e, n), c in want.items() if e == d) for d, _ in want)
        if i < 4:
            assert docs.columns == cp.COLUMNS
        before = after


ONE = "one text of more than five words"


@pytest.mark.parametrize(
    "rows,kept",
    [
        ([], set()),
        ([(1, None), (2, "")], set()),
        # Equal texts: the largest doc_id stays, null being the smallest; texts without letters go.
        ([(1, "one text"), (1, "one text"), (None, "one text"), (None, None, None, None), (3, "x" * 9000, None, None), (4, "12 34")], {1, 3}),
        # Near copies: the smallest doc_id stays, null only among nulls.
        ([(7, ONE), (5, ONE.upper()), (None, f"{ONE} "), (None, "alone")], {5, None}),
    ],
)
def test_odd_rows(spark, docs, tmp_path, rows, kept):
    """The documents that are left, each packed whole as often as it is taken."""
    frame = docs(rows).withColumn("TEXT_", F.lit("clash")).withColumn("row_", F.lit(1))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    pieces = cp.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == kept
    if pieces:
        assert sorted(pieces[0].asDict()) == sorted(["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"])
    enc = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r[0]: r[1] for r in rows}
    for i in kept:
        own = [p for p in pieces if p.doc_id == i]
        assert {p.doc_tokens for p in own} == {len(enc.encode(text[i], add_special_tokens=False).ids) + 1}
        assert sum(p.length for p in own) % own[0].doc_tokens == 0


def test_workers_get_bounded_batches(spark, docs):
    frame = docs([(i, "word " * 20_000) for i in range(200)]).coalesce(1)
    cp.pack_sequences(spark, frame, "")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    got = frame.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 200
    assert max(r.bytes for r in got) <= cp.BATCH_BYTES + 200_000


def test_names():
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert np.all([callable(f) for _, f in cp.STAGES])
