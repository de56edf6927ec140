import base64
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import langid

SF = "/root/testdata/sf0.01/documents.parquet"


def test_limits_extend():
    got = langid.limits({(0, 3): 2.0, (0, 5): 1.0, (1, 5): 4.0}, 3)
    m, three, five = langid.MARGIN, langid.SPREAD / 8**0.5, langid.SPREAD / 32**0.5
    short, long = 2 + m + three, 1 + m + five
    assert got[0].tolist() == pytest.approx([short + 3 * m, short + 2 * m, short + m, short, short, *[long] * 8])
    assert got[1][12] == pytest.approx(4 + m + five) and got[1][0] == pytest.approx(4 + 6 * m + five)
    assert got[2].tolist() == pytest.approx(np.maximum(got[0], got[1]).tolist())
    assert np.isinf(langid.limits({}, 2)).all()


def test_quantiles_against_brute_force(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text", "lang")
    model = langid.fit(docs, train_docs=60)
    sample = docs.filter("doc_id % 3 = 0")
    langid.calibrate(model, sample)
    texts = [r.text for r in sample.collect()]
    score, chars = langid.scores(model, pa.array(texts))
    by = {}
    for s, n in zip(score, chars):
        if n:
            by.setdefault((int(s.argmax()), min(int(np.log2(n)), 12)), []).append(-s.max() / n)
    want = langid.limits({k: np.quantile(v, langid.QUANTILE) for k, v in by.items()}, 4)
    assert np.allclose(model.limits, want)
    # By construction no more than the stated share of the calibration texts is rejected.
    over = langid.predict(model, pa.array(texts))["rejected"][chars > 0]
    assert over.mean() <= 1 - langid.QUANTILE


def test_unlearned_language_and_noise_are_rejected(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text", "lang")
    rng = random.Random(3)
    noise = [base64.b64encode(rng.randbytes(400)).decode() for _ in range(60)]
    noise += ["".join(rng.choice("qxzjkvw ") for _ in range(300)) for _ in range(60)] + ["ЖЩЪЫ ЭЮЯ ЖЩЪЫЖЩЪЫ " * 9, "漢字仮名交" * 40]
    planted = spark.createDataFrame([(10**6 + i, t, "noise") for i, t in enumerate(noise)], "doc_id long, text string, lang string")
    model = langid.fit(docs, F.col("lang") != "es")
    got = langid.identify(docs.unionByName(planted), model, ["doc_id", "lang"]).collect()
    share = lambda lang: np.mean([r.rejected for r in got if (r.lang == lang if lang else r.lang not in ("es", "noise"))])
    assert share("noise") == 1 and share("es") >= 0.98 and share(None) <= 0.01


def test_one_bad_text_does_not_disable_rejection(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text", "lang")
    bad = spark.createDataFrame([(10**6 + i, "zqx jvk xqz wvj " * 30, "en") for i in range(5)], docs.schema)
    noise = pa.array(["qzx kvj zxq vjw kqz " * 20])
    model = langid.fit(docs.unionByName(bad))
    assert langid.predict(model, noise)["rejected"].all()


def test_shared_ids_do_not_decide_the_sample(docs):
    rows = [(7, f"the cat number {'abcdefghij'[i % 10]} sat {'klmnopqrst'[i // 10 % 10]} times {'uvwxyz'[i % 6]}{'abcdefghij'[i // 100 % 10]}{'abcdef'[i // 1000]}", "en") for i in range(6000)]
    some = docs(rows)
    drawn = langid._draw(some, {"en": 0.1}, "train").count()
    assert 450 < drawn < 750
    assert langid._draw(docs([(7, "the cat", "en")] * 6000), {"en": 1.0}, "train").count() == 1


def test_words_are_bounded(docs):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + j)}{chr(97 + i // 26)}" for j in range(26)), "en") for i in range(200)]
    by = langid._counted(docs(rows).select("lang", "text"), 1000)
    assert 800 < len(by["en"][0]) < 1200
