"""Near-duplicates by SimHash and anchor-point covering.

Fingerprints have 64 bits and are linked at `THRESHOLD` = 2 or fewer differing
bits. Anchors are the words of a covering code: the perfect [63, 57] Hamming code
on bits 0 to 62 with bit 63 free, of covering radius 1. Two linked fingerprints
have a midpoint one bit or less from each, that midpoint has an anchor within the
covering radius, and so both lie within 1 + 1 = 2 of that anchor: half of the
threshold is added on each side. (Adding all of it on one side finds the same
links with 683 instead of 33 anchors a fingerprint.) Every distinct fingerprint
is replicated to its anchors within 2 and compared there; at most 2081
fingerprints lie within 2 of an anchor, so no anchor's group can grow with the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_workers, materialise, numbered
from .components import roots

WORDS = 3
SEED = 42
THRESHOLD = 2
#: Bytes of a text shingled at once.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded list at a time; lists are cut at white space."""
    at = 0
    while at < len(raw):
        m = _SPACE.search(raw, at + PIECE)
        end = m.start() if m else len(raw)
        yield raw[at:end].split()  # bytes.split() splits at exactly these characters
        at = end


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a whole text: a bit is 1 if set in over half the shingles' hashes."""
    from xxhash import xxh64_intdigest

    ones, total, carry = np.zeros(64, np.int64), 0, []
    for more in _pieces((text or "").encode().lower()):  # bytes.lower() lowers A-Z alone
        carry += more
        if len(carry) >= words:
            hashes = [xxh64_intdigest(b" ".join(s), seed) for s in zip(*[carry[i:] for i in range(words)])]
            ones += _ones(hashes)
            total += len(hashes)
            carry = carry[len(hashes) :]
    if not total and carry:
        ones, total = _ones([xxh64_intdigest(b" ".join(carry), seed)]), 1
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def _ones(hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words, seed) for t in batch["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array(prints.view(np.int64))], names=["row", "doc_id", "print"])

    return run


def flips() -> list[list[int]]:
    """For each syndrome of the Hamming code, the masks that turn a word into the anchors within 2 of it."""
    one = [1 << i for i in range(64)]
    out = [[0, one[63]]]
    for s in range(1, 64):
        pairs = [one[a - 1] | one[(a ^ s) - 1] for a in range(1, 64) if a < a ^ s]
        out.append([one[s - 1], one[s - 1] | one[63], *pairs])
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def anchors(col: str) -> Column:
    """All anchors within 2 bits of a fingerprint, as an array."""
    checks = [sum(1 << i for i in range(63) if (i + 1) >> k & 1) for k in range(6)]
    syndrome = sum((F.pmod(F.bit_count(F.col(col).bitwiseAND(F.lit(c))), F.lit(2)) * (1 << k) for k, c in enumerate(checks)), F.lit(0))
    table = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks]) for masks in flips()])
    return F.transform(F.element_at(table, (syndrome + 1).cast("int")), lambda m: m.bitwiseXOR(F.col(col)))


def stars(prints: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links that join what is connected within `limit` bits among these fingerprints: each to the least of its part."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= limit
    left = np.ones(len(prints), bool)
    out = []
    for i in range(len(prints)):
        if not left[i]:
            continue
        part = front = near[i] & left
        while front.any():
            reach = near[front].any(0) & left & ~part
            part, front = part | reach, reach
        left &= ~part
        out += [(int(prints[i]), int(prints[j])) for j in np.flatnonzero(part) if j != i]
    return out


def _compare(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((2, 0), np.int64)
        for batch in batches:
            now = np.concatenate([kept, np.stack([batch[c].to_numpy() for c in ("anchor", "print")])], axis=1)
            if not now.shape[1]:
                continue
            # The last anchor may go on in the next batch.
            cut = int(np.searchsorted(now[0], now[0, -1]))
            kept = now[:, cut:].copy()
            yield compare_sorted(now[0, :cut], now[1, :cut], limit)
        yield compare_sorted(kept[0], kept[1], limit)

    return run


def compare_sorted(anchor: np.ndarray, prints: np.ndarray, limit: int) -> pa.RecordBatch:
    """Links within each run of equal anchors."""
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(anchor)))
    twos = starts[sizes == 2]
    linked = np.bitwise_count((prints[twos] ^ prints[twos + 1]).view(np.uint64)) <= limit if len(twos) else np.empty(0, bool)
    a, b = [prints[twos][linked]], [prints[twos + 1][linked]]
    more = [pair for s, n in zip(starts[sizes > 2], sizes[sizes > 2]) for pair in stars(prints[s : s + n].view(np.uint64), limit)]
    if more:
        pairs = np.unique(np.array(more, np.uint64).view(np.int64), axis=0)
        a.append(pairs[:, 0])
        b.append(pairs[:, 1])
    return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})


def links(prints: DataFrame, limit: int = THRESHOLD) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column print) that connect all within `limit` <= 2 bits."""
    if limit > THRESHOLD:
        raise ValueError("the anchors cover two differing bits")
    ensure_workers(prints.sparkSession)
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = prints.select("print", F.explode(anchors("print")).alias("anchor"))
    dealt = spread.repartition(parts, "anchor").sortWithinPartitions("anchor", "print")
    return dealt.select("anchor", "print").mapInArrow(_compare(limit), "a long, b long")


def components(docs: DataFrame, *, words: int = WORDS, limit: int = THRESHOLD, row: str | None = None) -> DataFrame:
    """(row, doc_id, print, root, component_id) for every row of `docs` (columns doc_id, text).

    `print` is the signed form of the fingerprint; `root` the least signed fingerprint of
    the component; component_id its smallest doc_id, null where no member has one. A null
    text counts as empty, and a text without words has fingerprint zero, linked like any
    other. Repeated rows are members of their own. An empty table gives no row; other
    columns play no part.
    """
    ensure_workers(docs.sparkSession)
    if row is None:
        docs, row = numbered(docs.select("doc_id", "text"), "row_"), "row_"
    source = docs.select(docs[row].alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    prints = materialise(source.mapInArrow(_fingerprints(words, SEED), "row long, doc_id long, print long"), "prints")
    unique = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "unique-prints")
    found = roots(links(unique, limit))
    # Least doc_id of each component of several fingerprints; any other fingerprint has its own.
    # Both sides of every join are written tables, so the adaptive join can split a large component.
    linked = unique.join(found, unique["print"] == found["node"]).select("print", "least", "root")
    heads = found.select("root").distinct()
    linked = linked.unionByName(unique.join(heads, unique["print"] == heads["root"]).select("print", "least", "root"))
    linked = materialise(linked, "linked-prints")
    ids = materialise(linked.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    linked = linked.select(F.col("print").alias("print_"), "root").join(ids, "root")
    known = unique.join(linked, F.col("print") == F.col("print_"), "left").select("print", F.coalesce("root", "print").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    known = materialise(known, "print-components")
    return prints.join(known, "print").select("row", "doc_id", "print", "root", "component_id")
