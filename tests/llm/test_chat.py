import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
TEXTS = st.text(alphabet=st.sampled_from("\\<|>n\na turnedé☃"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS)
def test_escapes_are_reversible(role, text):
    assert chat.unescape(chat.escape(text)) == text
    made = chat.format_turn(role, [{"type": "text", "text": text}])
    assert chat.parse("".join(made.out)) == (role, [("text", text)])


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: t[:2])
        said = "".join(t for _, _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def digests(rows):
    return sorted((tuple(r)[:5] for r in rows), key=str)


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", "b <|end|>\n"), (1, 0, "user", "\\<|turn|>x"), (2, 0, None, None), (2, 1, "assistant", None), (3, 5, "assistant", "é☃" * 9000), (None, 0, "user", "x"), (None, None, "assistant", "y"), (4, 0, "odd\nrole\\n<|", ""), (5, 0, "user", "same"), (5, 0, "user", "same")]
    rows += [(6, i, "assistant", f"turn {i}") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("parts", F.lit(1)).withColumn("NTH", F.lit("x")).withColumn("loss", F.lit(2)).repartition(4)
    assert digests(chat.read_back(chat.format_turns(df)).collect()) == expected(rows)
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], SCHEMA))).collect() == []


def test_tied_turns_have_one_order(spark):
    rows = [(1, 0, "user", t) for t in ("a", "b", "c")] + [(1, 0, "assistant", "a")]
    out = [chat.read_back(chat.format_turns(spark.createDataFrame(r, SCHEMA).repartition(n))).collect() for r, n in ((rows, 1), (rows[::-1], 3))]
    assert out[0] == out[1] and out[0][0].n_turns == 4


def test_typed_parts(spark):
    parts = [("text", "see <|image 0|>: ", None, None, None, None, None), ("image", None, "s3://i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 2.01, None), ("text", "end", None, None, None, None, None), ("document", None, None, None, None, None, 3), None]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    made = {r.turn: r for r in chat.format_turns(df.withColumn("text", F.lit("unused")), parts=F.col("parts")).collect()}
    row = made[0]
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [("image", "s3://i.png", 3), ("audio", "a.wav", 51), ("document", None, 1536)]
    assert row.expanded_tokens == 3 + 51 + 1536
    assert [chat.unescape(row.segment[s.start : s.stop]) for s in row.loss] == ["see <|image 0|>: ", "end"]
    for i, a in enumerate(row.attachments):
        assert row.segment[a["at"] :].startswith(f"<|{a.kind} {i}|>")
    assert chat.parse(row.segment)[1] == [("text", "see <|image 0|>: "), ("image", 0), ("text", ""), ("audio", 1), ("text", "end"), ("document", 2), ("text", "")]
    assert made[1].segment == "<|turn|>user\n<|end|>\n" and made[1].loss == []
    # A part of an unknown type once stopped the whole job.
    assert [a["kind"] for a in chat.format_turn("user", [{"type": "video"}]).attachments] == ["unknown"]


def test_query(spark, sf_dir):
    from quarry.llm.queries import op4_chat_format

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    assert digests(op4_chat_format(spark, sf_dir).collect()) == expected(rows)


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    "part,kind,tokens",
    [
        ({"type": "audio", "seconds": NAN}, "audio", 1),
        ({"type": "audio", "seconds": INF}, "audio", 1),
        ({"type": "audio", "seconds": -3.0}, "audio", 1),
        ({"type": "audio", "seconds": 1e300}, "audio", 25 * 10**15),
        ({"type": "image", "width": -5, "height": 100}, "image", 1),
        ({"type": "document", "pages": -2}, "document", 512),
        ({"type": None}, "unknown", 1),
        ({"type": "video"}, "unknown", 1),
        ({"type": ""}, "unknown", 1),
    ],
)
def test_odd_parts(spark, part, kind, tokens):
    whole = {k: None for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} | part | {"ref": "r"}
    turns = spark.createDataFrame([(1, 0, "user", [whole])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    row = chat.format_turns(turns, parts=turns["parts"]).first()
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [(kind, "r", tokens)] and row.expanded_tokens == tokens
    assert chat.parse(row.segment) == ("user", [("text", ""), (kind, 0), ("text", "")])
