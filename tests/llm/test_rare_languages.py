import pytest
from pyspark.sql import functions as F

from quarry.llm import langid

RARE = "жщъы эюя жщъыж"


@pytest.fixture
def kept(spark):
    """A doc_id that the hash sets aside for calibration."""
    return spark.range(1000, 2000).filter(F.pmod(F.xxhash64("id", F.lit(RARE), F.lit("part")), F.lit(5)) == 0).first().id


@pytest.mark.parametrize("repeats", [1, 50, 20000])
def test_a_rare_language_is_learned(docs, kept, repeats):
    rows = [(i, "the cat and the dog sat on the mat", "en") for i in range(100)]
    model = langid.fit(docs(rows + [(kept, RARE, "ru")] * repeats))
    assert model.every == ["en", "ru"]
    plain = langid.fit(docs(rows))
    assert (model.limits <= plain.limits + 1).all()
    got = langid.identify(docs([(5, RARE, None)]), model, ["doc_id"]).collect()
    assert [r.lang_pred for r in got] == ["ru"]


def test_the_only_labelled_text(docs, kept):
    model = langid.fit(docs([(kept, RARE, "ru"), (1, "the cat", None)]))
    assert model.every == ["ru"]
    assert langid.identify(docs([(5, RARE, None)]), model, ["doc_id"]).first().lang_pred == "ru"
