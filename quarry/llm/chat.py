"""Chat formatting with typed content parts.

A turn is a role and a list of typed parts. A visitor flattens the parts in
order: text is escaped, and every image, audio or document part becomes a
placeholder, with a record of its attachment and of the tokens it expands to.
Each turn gives one row, so no conversation is ever gathered to be formatted;
its rows, in order, are its formatted text.

A formatted turn is  <|turn|>role NEWLINE content<|end|>NEWLINE . In texts and
roles a backslash and the string <| get a backslash before them, in roles a line
break is written \\n; so an unescaped <| always begins a mark, and removing the
escapes gives the text back. The loss covers the texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_workers

TURN, END = "<|turn|>", "<|end|>\n"
LEARNED_ROLE = "assistant"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<kind:string,ref:string,at:long,tokens:long>>"
SEGMENT_SCHEMA = f"conv_id long, turn long, nth long, segment string, loss array<struct<start:long,stop:long>>, attachments {ATTACHMENTS}, expanded_tokens long"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_ESCAPED = re.compile(r"\\|<\|")
_ESCAPE = re.compile(r"\\(n|\\|<)")
_MARK = re.compile(r"\\.|<\|(\w+)(?: ([^|]*))?\|>", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def amount(x: float | None) -> float:
    """A size as a finite number that is not below zero; above 10^15 it stays there."""
    return 0 if x is None or not math.isfinite(x) or x < 0 else min(x, 10**15)


@dataclass
class Visitor:
    """Flattens the parts of one turn. Token counts: an image has one token per started
    `patch` squared, audio `per_second`, a document `per_page`, and one at least. Sizes that are
    null, NaN, infinite or below zero count as zero. A part of an unknown or null type is
    kept as an attachment of kind `unknown` with one token."""

    patch: int = 28
    per_second: float = 25.0
    per_page: int = 512
    out: list[str] = field(default_factory=list)
    size: int = 0
    loss: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def add(self, piece: str) -> None:
        self.out.append(piece)
        self.size += len(piece)

    def visit(self, part: dict, learned: bool) -> None:
        handler = getattr(self, f"visit_{part['type']}", self.visit_unknown)
        handler(part, learned)

    def visit_unknown(self, part: dict, learned: bool) -> None:
        self._attach("unknown", part.get("ref"), 1)

    def visit_text(self, part: dict, learned: bool) -> None:
        start = self.size
        self.add(escape(part["text"] or ""))
        if learned:
            self.loss.append({"start": start, "stop": self.size})

    def visit_image(self, part: dict, learned: bool) -> None:
        tokens = math.ceil(amount(part["width"]) / self.patch) * math.ceil(amount(part["height"]) / self.patch)
        self._attach("image", part["ref"], max(1, tokens))

    def visit_audio(self, part: dict, learned: bool) -> None:
        self._attach("audio", part["ref"], max(1, math.ceil(amount(part["seconds"]) * self.per_second)))

    def visit_document(self, part: dict, learned: bool) -> None:
        self._attach("document", part["ref"], max(1, amount(part["pages"])) * self.per_page)

    def _attach(self, kind: str, ref: str | None, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": ref, "at": self.size, "tokens": tokens})
        self.add(f"<|{kind} {len(self.attachments) - 1}|>")


def format_turn(role: str | None, parts: list[dict] | None, **sizes) -> Visitor:
    visitor = Visitor(**sizes)
    visitor.add(f"{TURN}{escape_role(role or '')}\n")
    for part in parts or []:
        if part is not None:
            visitor.visit(part, role == LEARNED_ROLE)
    visitor.add(END)
    return visitor


def _format(sizes: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = segment_types()
        for batch in batches:
            done = [format_turn(r, p, **sizes) for r, p in zip(batch["role"].to_pylist(), batch["parts"].to_pylist())]
            columns = [batch[c] for c in ("conv_id", "turn", "nth")]
            columns += [pa.array(["".join(v.out) for v in done]), pa.array([v.loss for v in done], kinds[0]), pa.array([v.attachments for v in done], kinds[1])]
            columns.append(pa.array([sum(a["tokens"] for a in v.attachments) for v in done], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "nth", "segment", "loss", "attachments", "expanded_tokens"])

    return run


def segment_types() -> list[pa.DataType]:
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    attachment = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])
    return [pa.list_(span), pa.list_(attachment)]


def text_parts(text: Column) -> Column:
    """One text part, for tables that hold plain texts."""
    null = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *null))


def format_turns(turns: DataFrame, *, parts: Column | None = None, **sizes) -> DataFrame:
    """One row (SEGMENT_SCHEMA) per turn of `turns` (conv_id, turn, role, and text or `parts`).

    `loss` has the spans of learned text in code points of the segment, `attachments` the
    references with the place of their placeholder. `nth` orders rows that share conv_id and
    turn: it is a hash of role and content, so equal rows tie and are interchangeable. A null
    text, role or list of parts is empty; null conv_ids are one conversation; an empty table
    gives no row. No shuffle.
    """
    ensure_workers(turns.sparkSession)
    content = text_parts(F.coalesce(turns["text"].cast("string"), F.lit(""))) if parts is None else parts.cast(PARTS)
    rows = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"),
        turns["turn"].cast("long").alias("turn"),
        turns["role"].cast("string").alias("role"),
        content.alias("parts"),
    )
    rows = rows.select("conv_id", "turn", F.xxhash64("role", "parts").alias("nth"), "role", "parts")
    return rows.mapInArrow(_format(sizes), SEGMENT_SCHEMA)


def parse(segment: str) -> tuple[str, list[tuple[str, int | str]]]:
    """(role, contents) of a formatted turn; contents are ("text", unescaped) and (kind, attachment number)."""
    if not segment.startswith(TURN) or not segment.endswith(END):
        raise ValueError("not a formatted turn")
    role, _, body = segment[len(TURN) : -len(END)].partition("\n")
    out: list[tuple[str, int | str]] = []
    at = 0
    for m in _MARK.finditer(body):
        if m[1] is None:
            continue
        out += [("text", unescape(body[at : m.start()])), (m[1], int(m[2]))]
        at = m.end()
    out.append(("text", unescape(body[at:])))
    return unescape(role), out


class _Digest:
    """What a conversation adds up to, one segment at a time."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, loss: list[dict]) -> None:
        role, contents = parse(segment)
        text = "".join(str(c) if k == "text" else f"<|{k} {c}|>" for k, c in contents)
        self.all.update(f"{role}\n{text}\n".encode())
        for span in loss:
            learned = unescape(segment[span["start"] : span["stop"]])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
        self.turns += 1
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, rows = None, []
    for batch in batches:
        for conv_id, segment, loss in zip(batch["conv_id"].to_pylist(), batch["segment"].to_pylist(), batch["loss"].to_pylist()):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    rows.append(now.row())
                now = _Digest(conv_id)
            now.add(segment, loss)
        if len(rows) >= 1000:
            yield digest_batch(rows)
            rows = []
    if now is not None:
        rows.append(now.row())
    if rows:
        yield digest_batch(rows)


def digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_back(segments: DataFrame) -> DataFrame:
    """One row (DIGEST_SCHEMA) per conversation, from the formatted text alone.

    A hash over a conversation must see its turns in order, so a conversation is read by one
    task; it is streamed from a sorted shuffle, with one turn and two hash states in memory,
    however long it is.
    """
    ensure_workers(segments.sparkSession)
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("nth")]
    dealt = segments.select("conv_id", "turn", "nth", "segment", "loss").repartition(parts, "conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "segment", "loss").mapInArrow(_digests, DIGEST_SCHEMA)
