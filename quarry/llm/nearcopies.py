"""SimHash near copies at a similarity of 0.8 on five-word shingles.

A text has a SimHash fingerprint over all its shingles. Fingerprints go to the anchors around them
and are compared there by Hamming distance as in `simhash`, at most `THRESHOLD` bits apart, and the
texts of a component of fingerprints are candidates: that finds every pair so close.

Two texts at 0.8 differ in about 10 of the 64 bits, a distance at which unrelated texts meet as
well. For those a text gets `PRINTS` fingerprints besides,
each over a min-wise sample of `SAMPLE` shingles: texts of similarity s have the same sample, and
so the same fingerprint, with probability s^4, and unrelated texts with none. Anchors are the words
of the Hamming code of `simhash`, of covering radius 1; with equal fingerprints to find, the
threshold is 0, and a fingerprint goes to the one anchor within 1. Texts that share an anchor of the
same sample are compared; texts at 0.8 share none with probability (1 - 0.8^4)^40 < 1e-9. Links are
those candidates with an exact similarity of 0.8 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_steps, ensure_workers, made, materialise, release
from .components import roots
from .simhash import THRESHOLD
from .simhash import links as close_prints
from .tokens import slices

WORDS = 5
SEED = 42
#: Fingerprints of a text, and shingles in the sample of each.
PRINTS, SAMPLE = 40, 4
#: Texts are shingled in slices of so many bytes.
SLICE = 2 << 20
#: A block of a group has about so many rows and shingles at most; a matrix, so many cells.
BLOCK_ROWS, BLOCK_SHINGLES, MATRIX = 1024, 4 << 20, 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a hash and a value; for a fixed hash, one-to-one."""
    x = (a ^ b) * _ODD
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct shingles' hashes of each text, sorted, end to end; how many each text has).

    Words are split at ASCII white space and A-Z are lowered. A text of fewer than
    `WORDS` words, or none, is one shingle; a null text counts as empty.
    """
    from xxhash import xxh64_intdigest

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    owner, words = pc.list_parent_indices(lists), lists.flatten()
    some = pc.not_equal(words, "")
    owner, coded = owner.filter(some).to_numpy(zero_copy_only=False), words.filter(some).dictionary_encode()
    hashes = np.array([xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()], np.uint64)
    word = np.append(hashes[coded.indices.to_numpy(zero_copy_only=False)], np.uint64(0))
    per = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    ends = np.cumsum(per)
    many = np.maximum(per - WORDS + 1, 1)
    text = np.repeat(np.arange(len(texts)), many)
    at = np.arange(len(text)) + np.repeat(ends - per - (np.cumsum(many) - many), many)
    end = np.repeat(ends, many)
    found = np.full(len(text), SEED, np.uint64)
    for k in range(WORDS):
        found = _fold(found, np.where(at + k < end, word[np.minimum(at + k, len(word) - 1)], np.uint64(0)))
    order = np.lexsort((found, text))
    found = found[order]  # `text` is in order already
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[first], np.bincount(text[first], minlength=len(texts))


def nearest_anchor(prints: np.ndarray) -> np.ndarray:
    """The anchor within one bit: the word of the Hamming code on bits 0 to 62, with bit 63 as it is."""
    syndrome = np.zeros(prints.shape, np.uint64)
    for k in range(6):
        mask = np.uint64(sum(1 << i for i in range(63) if (i + 1) >> k & 1))
        syndrome |= (np.bitwise_count(prints & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    return np.where(syndrome == 0, prints, prints ^ (np.uint64(1) << (syndrome - np.minimum(syndrome, np.uint64(1)))))


def fingerprints(found: np.ndarray, per: np.ndarray) -> np.ndarray:
    """The fingerprints of each text, a row each: a bit is 1 if set in over half of the sample's hashes."""
    seeds = np.random.default_rng(SEED).integers(0, 1 << 63, (2, SAMPLE * PRINTS), np.uint64)
    starts = np.cumsum(per) - per
    out = np.empty((len(per), PRINTS), np.uint64)
    for p in range(PRINTS):
        least = [np.minimum.reduceat((found ^ seeds[0, i]) * (seeds[1, i] << np.uint64(1) | np.uint64(1)), starts) for i in range(p * SAMPLE, (p + 1) * SAMPLE)]
        # A minimum begins with zeros, so it is hashed again.
        a, b, c, d = (_fold(np.uint64(p), x) for x in least)
        out[:, p] = (a & b & (c | d)) | (c & d & (a | b))
    return out


def whole_prints(found: np.ndarray, per: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of each text: a bit is 1 if set in over half of its shingles' hashes."""
    starts = np.cumsum(per) - per
    out = np.zeros(len(per), np.uint64)
    for bit in np.arange(64, dtype=np.uint64):
        ones = np.add.reduceat((found >> bit & np.uint64(1)).astype(np.int64), starts)
        out |= (2 * ones > per).astype(np.uint64) << bit
    return out


def keys(found: np.ndarray, per: np.ndarray) -> np.ndarray:
    """One key for the anchor of each fingerprint of each text, a row each."""
    return _fold(np.arange(PRINTS, dtype=np.uint64), nearest_anchor(fingerprints(found, per))).view(np.int64)


def _lists(values: np.ndarray, per: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), pa.array(values))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to in slices(batch["text"], SLICE):
            found, per = shingles(batch["text"].slice(at, to - at))
            bands = _lists(keys(found, per).reshape(-1), np.full(len(per), PRINTS))
            prints = pa.array(whole_prints(found, per).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["row"].slice(at, to - at), pa.array(per, pa.int64()), prints, bands], names=["row", "n", "print", "keys"])
    release()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to in slices(batch["text"], SLICE):
            found, per = shingles(batch["text"].slice(at, to - at))
            yield pa.RecordBatch.from_arrays([batch["row"].slice(at, to - at), _lists(found.view(np.int64), per)], names=["row", "shingles"])
    release()


def _sizes_allow(a: str, b: str) -> Column:
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact similarity is 0.8 or more."""
    left = sets.select(F.col("row").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("row").alias("b"), F.col("shingles").alias("y"))
    # i / (x + y - i) >= 4 / 5
    alike = 9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))
    return materialise(pairs.join(left, "a").join(right, "b").filter(alike).select("a", "b"), "near-links")


def _close(signed: DataFrame) -> DataFrame:
    """(row, n, key) of every text: the key stands for the component of its whole fingerprint at `THRESHOLD` bits."""
    unique = materialise(signed.select("print").distinct(), "whole-prints")
    found = materialise(roots(close_prints(unique, THRESHOLD)), "print-roots")
    known = signed.select("row", "n", "print").join(found, F.col("print") == F.col("node"), "left")
    return known.select("row", "n", F.xxhash64(F.lit("whole"), F.coalesce("root", "print")).alias("key"))


def _stars(shared: DataFrame) -> DataFrame:
    """Candidates (a, b): every row with the head of each of its groups.

    The head is the row with the most partners over all its groups, so of a large group of
    edited copies it is one with few edits, which most others are linked to.
    """
    score = materialise(shared.groupBy("row").agg(F.sum("m").alias("score")), "partners")
    scored = materialise(shared.join(score, "row").select("key", "row", "n", "score"), "scored-keys")
    first = F.max(F.struct("score", (-F.col("row")).alias("back"), "n")).alias("head")
    heads = scored.groupBy("key").agg(first).select("key", (-F.col("head.back")).alias("head"), F.col("head.n").alias("head_n"))
    both = scored.join(materialise(heads, "heads"), "key")
    both = both.filter((F.col("row") != F.col("head")) & _sizes_allow("n", "head_n"))
    return both.select(F.col("head").alias("a"), F.col("row").alias("b")).distinct()


def _blocks(rows: str, shingles: str) -> Column:
    return F.ceil(F.greatest(F.col(rows) / BLOCK_ROWS, F.col(shingles) / BLOCK_SHINGLES, F.lit(1.0))).cast("int")


def _rest(shared: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) between the components found that no head has.

    A shingle that no other text of the unsettled groups has can't be shared. With r shingles
    besides those, a text shares at most r, and a link of sizes x and y needs 4 / 9 (x + y) of them:
    an exact bound that closes many edited copies. What stays open is compared within its group, exactly,
    in blocks: the rows outside the group's largest component against one another and against those in it.
    No pair becomes a row, only links do; a block has a bounded number of rows and shingles.
    """
    placed = shared.join(found, shared["row"] == found["node"], "left").select("key", "row", "n", F.coalesce("root", "row").alias("root"))
    placed = materialise(placed, "placed-keys")
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least")).filter("lo <> hi")
    left = materialise(placed.join(materialise(mixed.select("key", "least"), "mixed-keys"), "key"), "unsettled-keys")
    every = sets.join(left.select("row").distinct(), "row", "left_semi").select("row", F.explode("shingles").alias("shingle"))
    alone = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("row").alias("row")).filter("c = 1")
    alone = materialise(alone.groupBy("row").agg(F.count(F.lit(1)).alias("own")), "own-shingles")
    left = left.join(alone, "row", "left").withColumn("r", F.col("n") - F.coalesce("own", F.lit(0)))
    left = materialise(left.filter(4 * (F.col("n") + F.col("least")) <= 9 * F.col("r")).select("key", "row", "n", "root"), "open-keys")

    per = left.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    lead = per.groupBy("key").agg(F.max(F.struct("c", "root", "s")).alias("lead"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    lead = lead.select("key", F.col("lead.root").alias("lead"), F.col("lead.c").alias("in_c"), F.col("lead.s").alias("in_s"), (F.col("c") - F.col("lead.c")).alias("out_c"), (F.col("s") - F.col("lead.s")).alias("out_s"))
    lead = lead.filter("out_c > 0").select("key", "lead", _blocks("in_c", "in_s").alias("ins"), _blocks("out_c", "out_s").alias("outs"))
    rows = left.join(materialise(lead, "open-groups"), "key")
    inside = F.col("root") == F.col("lead")
    own = F.pmod(F.xxhash64("row"), F.when(inside, F.col("ins")).otherwise(F.col("outs"))).cast("int")
    meet = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    with_outs = F.transform(F.sequence(F.lit(0), F.col("outs") - 1), lambda i: meet(0, i, F.col("own")))
    with_ins = F.transform(F.sequence(F.lit(0), F.col("ins") - 1), lambda j: meet(0, F.col("own"), j))
    others = F.transform(F.filter(F.sequence(F.lit(0), F.col("outs") - 1), lambda j: j != F.col("own")), lambda j: meet(1, F.least("own", j), F.greatest("own", j)))
    rows = rows.withColumn("own", own).withColumn("meet", F.explode(F.when(inside, with_outs).otherwise(F.concat(with_ins, others))))
    rows = rows.select("row", "root", F.xxhash64("key", "meet").alias("block")).join(sets, "row")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "block").sortWithinPartitions("block", "row")
    return materialise(dealt.select("block", "row", "root", "shingles").mapInArrow(_compared, "a long, b long"), "rest-links")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch["block"].to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for at, to in zip(cuts, cuts[1:]):
            if held and at < to and held[0]["block"][0].as_py() != int(ids[at]):
                yield _linked(held)
                held = []
            if at < to:
                held.append(batch.slice(at, to - at))
    if held:
        yield _linked(held)
    release()


def _linked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    shingle = pc.list_flatten(table["shingles"]).to_numpy()
    per = pc.list_value_length(table["shingles"]).to_numpy().astype(np.int64)
    a, b = links(shingle, per, table["root"].to_numpy())
    row = table["row"].to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(row[a]), pa.array(row[b])], names=["a", "b"])


def links(shingle: np.ndarray, per: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that join what links between texts of different roots join; the texts' distinct shingles lie end to end."""
    n = len(per)
    none = np.empty(0, np.int64)
    if n < 2 or (root == root[0]).all():
        return none, none
    distinct, at, count = np.unique(shingle, return_inverse=True, return_counts=True)
    some = count[at] > 1
    column = (np.cumsum(count > 1) - 1)[at[some]]
    owner = np.repeat(np.arange(n), per)[some]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((n, n))  # counts beyond 2^24 stay exact
    width = max(1, MATRIX // n)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((n, width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        both += part @ part.T
    near = (9 * both >= 4 * (per[:, None] + per[None, :])) & (root[:, None] != root[None, :])
    a, b, left = [none], [none], np.ones(n, bool)
    for i in np.flatnonzero(near.any(1)):
        if not left[i]:
            continue
        part = np.zeros(n, bool)
        part[i] = True
        front = part
        while front.any():
            reach = near[front].any(0) & ~part
            part, front = part | reach, reach
        left &= ~part
        others = np.flatnonzero(part)
        a.append(np.full(len(others) - 1, i))
        b.append(others[others != i])
    return np.concatenate(a), np.concatenate(b)


def components(docs: DataFrame, row: str) -> DataFrame:
    """(node, root) for every row number that is not the least of the rows linked to it.

    `docs` (row, text) is read twice, so its row numbers must be the same in every scan. A null text counts as
    empty; texts of fewer than five words are linked where their words are equal; repeated rows
    are linked; an empty table gives no row; other columns play no part. Candidates are first
    compared with the head of their group (a component of whole fingerprints, or an anchor of a
    sample); what these links leave apart, and an exact bound leaves
    open, is compared in blocks, so that no link between components is lost and no pair is a row.
    """
    spark, first = docs.sparkSession, len(made())
    ensure_workers(spark)
    source = docs.select(docs[row].alias("row"), docs["text"].cast("string").alias("text"))
    signed = materialise(source.mapInArrow(_signatures, "row long, n long, print long, keys array<long>"), "signatures")
    spread = signed.select("row", "n", F.explode("keys").alias("key"))
    spread = spread.unionByName(materialise(_close(signed), "whole-keys"))
    crowds = materialise(spread.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared-keys")
    shared = materialise(spread.join(crowds, "key").select("key", "row", "n", "m"), "candidates")
    wanted = materialise(shared.select("row").distinct(), "candidate-rows")
    sets = materialise(source.join(wanted, "row", "left_semi").mapInArrow(_sets, "row long, shingles array<long>"), "shingle-sets")
    near = _verified(_stars(shared), sets)
    found = materialise(roots(near), "near-roots")
    rest = _rest(shared, sets, found)
    # What is found already goes in as stars, which no round changes.
    every = found if rest.isEmpty() else roots(rest.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    every = materialise(every, "near-copies")
    clean_steps(spark, first)
    return every
