"""Exact deduplication by deterministic block naming.

Texts are cut into fixed-size blocks. Equal blocks are brought together and
sorted, and every distinct block gets an integer name; then adjacent names are
paired and the distinct pairs named, level by level, until each document is one
name. Names come from comparing contents, never from a hash, so two documents
share an identity only if they are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ensure_workers, materialise, numbered, text_of

BLOCK = 4096
#: Stands for the missing right half of the last pair; no name has this value.
NOTHING = -(1 << 63)


def _name_runs(values: int, salted: bool):
    """Number the runs of equal values in sorted rows.

    In: `values` value columns, then, if `salted`, salt and hot, then others. Out: the
    others and `name`; if `salted`, also the values, set in the first row of a hot run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        same = values + salted  # a run has one salt
        last: list | None = None
        made = -1
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = np.zeros(n, bool)
            for col in batch.columns[:same]:
                if n > 1:
                    fresh[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            fresh[0] = last is None or [c[0].as_py() for c in batch.columns[:same]] != last
            last = [c[n - 1].as_py() for c in batch.columns[:same]]
            ids = made + np.cumsum(fresh)
            made = int(ids[-1])
            skip = values + 2 * salted
            out = dict(zip(batch.schema.names[skip:], batch.columns[skip:])) | {"name": pa.array(base + ids)}
            if salted:
                shown = pa.array(fresh & batch.column(values + 1).to_numpy(zero_copy_only=False))
                for i, col in enumerate(batch.columns[:values]):
                    out[f"value{i}"] = pc.if_else(shown, col, pa.scalar(None, col.type))
            yield pa.RecordBatch.from_pydict(out)

    return run


def _runs(rows: DataFrame, by: list[str], others: list[str], salted: bool) -> DataFrame:
    kinds = dict(rows.dtypes)
    salt = ["salt"] * salted
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*by, *salt, *["hot"] * salted, *others).repartition(parts, *by, *salt).sortWithinPartitions(*by, *salt)
    schema = [*[f"{c} {kinds[c]}" for c in others], "name long", *[f"value{i} {kinds[c]}" for i, c in enumerate(by) if salted]]
    return dealt.mapInArrow(_name_runs(len(by), salted), ", ".join(schema))


def _crowded(rows: DataFrame, key: str) -> DataFrame:
    """(key, salts) of the keys that more than a small share of all rows have.

    That share is 1 / (4 * max(1024, partitions)) of the rows, so there are at most
    that many such keys, and at most twice that many salts: a proven bound.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = materialise(rows.groupBy(key).count(), "name-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    share = max(1, total // (4 * max(1024, parts)))
    return counts.filter(F.col("count") > share).select(key, F.ceil(F.col("count") / share).cast("long").alias("salts"))


def named(rows: DataFrame, by: list[str], others: list[str], what: str) -> DataFrame:
    """`others` and `name` for all rows; names are equal where `by` is, and nowhere else.

    The contents are shuffled once. Values that many rows share are dealt over salts and
    named in each; their first rows, at most two per salt allowed, are then named once
    more and the names replaced through a broadcast of that bounded map.
    """
    keyed = rows.withColumn("key", F.xxhash64(*by))
    keyed = keyed.join(F.broadcast(_crowded(keyed, "key")), "key", "left").withColumn("hot", F.col("salts").isNotNull())
    keyed = keyed.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("rid", "pos"), "salts")).otherwise(F.lit(0)).cast("long"))
    local = materialise(_runs(keyed, by, others, salted=True), what)
    hot = local.filter(F.col("value0").isNotNull()).select(*[f"value{i}" for i in range(len(by))], F.col("name").alias("was"))
    # Below zero, these names can't meet those of the salted runs.
    again = _runs(hot, [f"value{i}" for i in range(len(by))], ["was"], salted=False).select("was", (-F.col("name") - 1).alias("now"))
    again = materialise(again, f"{what}-hot")
    return local.join(F.broadcast(again), local["name"] == again["was"], "left").select(*others, F.coalesce("now", "name").alias("name"))


def identities(docs: DataFrame, text: str = "text", *, row: str, keep: dict | None = None, block: int = BLOCK) -> DataFrame:
    """(rid, the `keep` columns, level, name) for every row of `docs`.

    `row` is a number column that is unique and repeats on every scan. `keep` maps names
    to columns carried along. (level, name) is the row's identity: equal texts, as UTF-8
    bytes, have equal identities and others have not. Null counts as empty; an empty text
    is one empty block. An empty table gives no row.
    """
    ensure_workers(docs.sparkSession)
    kept = F.struct(F.lit(0).alias("none_"), *[c.alias(n) for n, c in (keep or {}).items()])
    body = docs.select(F.col(row).alias("rid"), kept.alias("kept"), text_of(text).cast("binary").alias("body"))
    count = F.expr(f"cast(greatest(1, (octet_length(body) + {block - 1}) div {block}) as long)")
    cut = body.select("rid", "kept", "body", count.alias("blocks"), F.explode(F.expr(f"sequence(0L, greatest(0L, cast((octet_length(body) - 1) div {block} as long)))")).alias("pos"))
    cut = cut.select(
        "rid",
        "pos",
        "blocks",
        F.when(F.col("pos") == 0, F.col("kept")).alias("kept"),
        F.expr(f"substring(body, cast(pos * {block} + 1 as int), {block})").alias("block"),
    )
    kind = dict(cut.dtypes)["kept"]
    first = named(cut, ["block"], ["rid", "pos", "blocks", "kept"], "name-0")
    first = first.withColumn("kept", F.col("kept").cast(kind))
    done = first.filter("blocks = 1").select("rid", "kept.*", F.lit(0).alias("level"), "name")
    heads = first.filter("blocks > 1 and pos = 0").select("rid", "kept")
    longest = first.agg(F.max("blocks")).first()[0] or 1
    rows, level, ended = first.select("rid", "pos", "blocks", "name").filter("blocks > 1"), 0, []
    while longest > 1:
        level += 1
        half = F.pmod("pos", F.lit(2)) == 0
        pairs = rows.groupBy("rid", F.expr("pos div 2").alias("pos")).agg(
            F.expr("(max(blocks) + 1) div 2").alias("blocks"),
            F.max(F.when(half, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(NOTHING)).alias("right"),
        )
        pairs = materialise(pairs, f"pairs-{level}")
        rows = named(pairs, ["left", "right"], ["rid", "pos", "blocks"], f"name-{level}")
        ended.append(rows.filter("blocks = 1").select("rid", F.lit(level).alias("level"), "name"))
        rows = rows.filter("blocks > 1")
        longest = (longest + 1) // 2
    for part in ended:
        done = done.unionByName(heads.join(part, "rid").select("rid", "kept.*", "level", "name"))
    return done.drop("none_")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", *, row: str | None = None, keep: dict | None = None) -> DataFrame:
    """(rid, key, the `keep` columns, keep_id, group_size, kept) for every row of `docs`.

    Of rows with equal texts the one with the largest key stays; among repeats of that
    key, the last in row order. A null key is the smallest. Only identities of several rows
    are joined back, from a written table, so the adaptive join can split a large group.
    """
    if row is None:
        docs, row = numbered(docs, "row_"), "row_"
    named_rows = materialise(identities(docs, text, row=row, keep={key: F.col(key)} | (keep or {})), "identities")
    best = named_rows.groupBy("level", "name").agg(F.max(F.struct(F.col(key).alias("key"), "rid")).alias("best"), F.count(F.lit(1)).alias("n"))
    best = materialise(best.filter("n > 1"), "shared-identities")
    both = named_rows.join(best, ["level", "name"], "left")
    return both.select(
        "rid",
        key,
        *(keep or {}),
        F.when(F.col("n").isNull(), F.col(key)).otherwise(F.col("best.key")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        (F.col("n").isNull() | (F.col("best.rid") == F.col("rid"))).alias("kept"),
    )
