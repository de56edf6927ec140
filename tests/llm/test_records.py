import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import records
from quarry.llm.common import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def expected(plain, rows):
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(text)
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_whole_table(plain, spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(tuple(r) for r in records.round_trip(df, PATH).collect())
    assert got == expected(plain, rows)


def test_odd_rows(plain, docs):
    rows = [(7, None), (3, ""), (None, "no id"), (5, "same"), (5, "same"), (9, "word " * 20000), (-2, "neg")]
    df = docs(rows).withColumn("tie", F.lit(1)).withColumn("PART", F.lit("x")).repartition(3)
    got = sorted((tuple(r) for r in records.round_trip(df, PATH).collect()), key=lambda r: r[1])
    assert got == expected(plain, rows)
    assert records.round_trip(docs([]), PATH).collect() == []


def test_shuffled_reads_and_damage(plain, docs, spark, tmp_path):
    rows = [(i, f"text number {i} " * i) for i in range(50)]
    folder = shared_dir(spark, "records")
    parts = records.write(docs(rows), folder, PATH)
    seen = {}
    for part, n, _ in parts:
        file = records.RecordFile(folder, part)
        assert len(file) == n
        seen |= {doc_id: ids.tolist() for doc_id, _, ids in file.shuffled(3)}
    assert seen == {i: plain(t) for i, t in rows}
    assert list(spark.sparkContext.parallelize([1]).collect()) == [1]

    path = tmp_path / "part-000000.rec"
    import zstandard

    record = records.frame(records.pack_ids(1, np.array([1, 70000], np.uint32), zstandard.ZstdCompressor()))
    for i in range(len(record)):
        path.write_bytes(record[:i] + bytes([record[i] ^ 1]) + record[i + 1 :])
        with path.open("rb") as f, pytest.raises(ValueError):
            records.read_frame(f)
    path.write_bytes(record)
    with path.open("rb") as f:
        doc_id, ids = records.unpack_ids(records.read_frame(f), zstandard.ZstdDecompressor())
        assert (doc_id, ids.tolist()) == (1, [1, 70000])
        assert records.read_frame(f) is None
