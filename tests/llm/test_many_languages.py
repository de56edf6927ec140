import numpy as np
import pyarrow as pa

from quarry.llm import langid


def word(i, k):
    return "".join(chr(0x4E00 + 8 * i + (k >> j & 3)) for j in range(0, 6, 2))


def test_every_label_is_learned(docs):
    rows = [(10 * i + k, " ".join(word(i, k + j) for j in range(12)), f"l{i:03}") for i in range(300) for k in range(10)]
    df = docs(rows).repartition(4)
    model = langid.fit(df)
    assert model.every == sorted({r[2] for r in rows})
    truth = {r[0]: r[2] for r in rows}
    got = langid.identify(df, model, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(r.lang_pred == truth[r.doc_id] for r in got)


def test_groups_score_as_one(monkeypatch):
    rng = np.random.default_rng(1)
    counts = {f"l{i}": ([f"{a}{'abcde'[i]}{b}" for a in "xyz" for b in "stu"], rng.integers(1, 9, 9).astype(float)) for i in range(5)}
    texts = pa.array(["xas yct", "zet qq", "", None])
    whole = langid.scores(langid.train(counts), texts)
    monkeypatch.setattr(langid, "GROUP", 2)
    parted = langid.train(counts)
    assert len(parted.more) == 2
    got = langid.scores(parted, texts)
    assert np.allclose(got[0], whole[0], rtol=1e-9) and (got[1] == whole[1]).all()
