from collections import Counter

import pytest

import corpus_pipeline as cp

TEXT = "a quite different text of document number {} with words such as {} and {}"


@pytest.mark.parametrize("stage", [cp.drop_copies, cp.drop_near_copies, cp.mix_sources])
def test_later_scans_may_be_split_otherwise(spark, docs, tmp_path, monkeypatch, stage):
    """As with an executor lost after the choice: the rows' second scan has other splits than the first."""
    rows = [(i, TEXT.format(i // 2, i // 2 * 7, i // 2 * 11), "en", "abc"[i % 5 % 3]) for i in range(200)]
    rows = [(i, t + (" x" if stage is cp.drop_near_copies and i % 2 else ""), *more) for i, t, *more in rows]
    docs(rows).repartition(8).write.parquet(str(tmp_path / "documents"))
    frame = spark.read.parquet(str(tmp_path / "documents"))
    monkeypatch.setattr(cp.mixing, "mix", lambda rows, row: rows.selectExpr(f"{row} AS row", "int(doc_id % 3) AS copies"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
        spark.conf.set("spark.sql.files.openCostInBytes", "1g")
        out = stage(spark, frame, "")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        got = Counter(r.doc_id for r in out.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if stage is cp.mix_sources:
        assert got == {i: i % 3 for i in range(200) if i % 3}
    else:
        assert got == dict.fromkeys(range(stage is cp.drop_copies, 200, 2), 1)
