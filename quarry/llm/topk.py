"""Exact top-k search by inner product with norm-bucketed retrieval.

Vectors are ordered by length and cut into buckets. A query first meets the
bucket of the longest vectors, which gives a lower bound t for its k-th best
product. In a bucket of greatest length l, a vector can only reach t if its cosine
with the query q is at least t / (|q| l), the local threshold. Above 1 the
bucket is skipped; a high threshold confines each of a few coordinates of the
normalised vector to a range and rows outside them are dropped (coordinate
pruning); a low one only drops rows that are too short, |v| < t / |q| (length
pruning). What remains is verified by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_workers, materialise, numbered

#: Vectors of a bucket, and queries of a block, at most.
BUCKET = 4096
QUERIES = 512
#: Local thresholds from here on are worth coordinate pruning, on so many coordinates.
STEEP = 0.7
FOCUS = 4
#: Allowance for rounding in cosine comparisons.
SLACK = 1e-9
#: Products are exact in doubles below this.
EXACT = float(1 << 53)
BLOCK_SCHEMA = "nth long, dims int, length double, need double, n int, width int, ids binary, rows binary, bounds binary, vecs binary"
HITS = "query_id long, query_row long, vec_id long, score long"


def _pack(size: int):
    """Blocks of at most `size` rows with one number of dimensions, from rows sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, held, n = None, [], 0
        names = _counter()
        for batch in batches:
            for start, stop, d in _runs(batch["dims"].to_numpy()):
                if held and (d != dims or n >= size):
                    yield from _blocks(names, dims, held, size)
                    held, n = [], 0
                part = batch.slice(start, stop - start)
                vecs = part["vec"].flatten().to_numpy(zero_copy_only=False).reshape(stop - start, d)
                held.append((part["vec_id"].to_numpy(), part["row"].to_numpy(), part["bound"].to_numpy(), vecs))
                dims, n = d, n + stop - start
        if held:
            yield from _blocks(names, dims, held, size)

    return run


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, b, int(values[a])


def _counter() -> Iterator[int]:
    """Numbers that no other task gives."""
    return count(TaskContext.get().partitionId() << 33)


def _blocks(names: Iterator[int], dims: int, held: list, size: int) -> Iterator[pa.RecordBatch]:
    """`nth` names the block; `length` is the greatest of the block; `need` the length that a vector needs to reach the bound of any row."""
    all_ids, all_rows, all_bounds, all_vecs = (np.concatenate(x) for x in zip(*held))
    for at in range(0, len(all_ids), size):
        ids, rows, bounds, vecs = (x[at : at + size] for x in (all_ids, all_rows, all_bounds, all_vecs))
        lengths = norms(vecs)
        need = np.where(bounds > 0, bounds / np.maximum(lengths, 1e-300), 0.0).min()
        low, high = (int(f(vecs)) for f in (np.min, np.max)) if vecs.size else (0, 0)
        width = next(w for w in (2, 4, 8) if low >= -(1 << 8 * w - 1) and high < 1 << 8 * w - 1)
        values = [next(names), dims, float(lengths.max()), float(need), len(ids), width, ids.astype("<i8").tobytes(), rows.astype("<i8").tobytes(), bounds.astype("<f8").tobytes(), vecs.astype(f"<i{width}").tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        columns = ["nth", "dims", "length", "need", "n", "width", "ids", "rows", "bounds", "vecs"]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=columns)


def norms(vecs: np.ndarray) -> np.ndarray:
    return np.sqrt((vecs.astype(float) ** 2).sum(1))


def unpack(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, rows, bounds, vectors)"""
    vecs = np.frombuffer(block["vecs"], f"<i{block['width']}").reshape(block["n"], block["dims"]).astype(np.int64)
    return np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["rows"], "<i8"), np.frombuffer(block["bounds"], "<f8"), vecs


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of q and v: in doubles where they are exact, else in
    Python's integers, kept within the range of a long."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if top < EXACT:
        return (q.astype(float) @ v.astype(float).T).astype(np.int64)
    wide = q.astype(object) @ v.astype(object).T
    limit = (1 << 63) - 1
    return np.array([[max(-limit - 1, min(limit, int(x))) for x in row] for row in wide], np.int64).reshape(len(q), len(v))


def survivors(query: np.ndarray, unit: np.ndarray, lengths: np.ndarray, least: float, longest: float) -> np.ndarray:
    """Rows of a bucket that may have a product of at least `least` with the query; `unit` are the rows normalised."""
    size = float(np.sqrt((query.astype(float) ** 2).sum()))
    if size == 0 or longest == 0 or least <= 0:
        return np.arange(len(lengths))
    local = least / (size * longest)
    if local > 1 + SLACK:
        return np.empty(0, np.int64)
    fit = lengths >= least / size * (1 - SLACK)
    if local >= STEEP:
        # The angle to the query is at most `wide`, so the angle to an axis differs by no more.
        cosines = query / size
        wide = np.arccos(min(1.0, local))
        for f in np.argsort(-np.abs(cosines))[:FOCUS]:
            axis = np.arccos(np.clip(cosines[f], -1, 1))
            low, high = np.cos(min(np.pi, axis + wide)), np.cos(max(0.0, axis - wide))
            fit &= (unit[:, f] >= low - SLACK) & (unit[:, f] <= high + SLACK)
    return np.flatnonzero(fit)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids, in order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def _search(k: int):
    """Joined rows of a query block and a bucket: the best k of the bucket for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                queries, bucket = batch["q"][i].as_py(), batch["b"][i].as_py()
                q_ids, q_rows, bounds, q_vecs = unpack(queries)
                ids, rows, _, vecs = unpack(bucket)
                found = search(ids, rows, vecs, q_rows, q_vecs, bounds, k, bucket["length"])
                if found:
                    at, hit, score = (np.concatenate(x) for x in zip(*found))
                    columns = [q_ids[at], q_rows[at], ids[hit], score]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_row", "vec_id", "score"])

    return run


def search(ids, rows, vecs, q_rows, q_vecs, bounds, k, longest) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query position, row position, score) of the best k rows for each query whose bound the bucket may reach."""
    lengths = norms(vecs)
    unit = vecs / np.maximum(lengths, 1e-300)[:, None]
    out = []
    for i in range(len(q_rows)):
        some = survivors(q_vecs[i], unit, lengths, bounds[i], longest)
        some = some[rows[some] != q_rows[i]]
        if not len(some):
            continue
        scores = products(q_vecs[i : i + 1], vecs[some])[0]
        top = best(scores, ids[some], k)
        top = top[scores[top] >= bounds[i]]
        out.append((np.full(len(top), i), some[top], scores[top]))
    return out


def quantised(table: DataFrame, key: str = "vec_id", vector: str = "embedding", factor: int = 1024) -> DataFrame:
    """(vec_id, vec) with components floor(factor * x), x as double; rows with a null key, a null
    vector or a null or non-finite component take no part. Values beyond a long stay at its limit."""
    x = table.select(table[key].cast("long").alias("vec_id"), table[vector].cast("array<double>").alias("x"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = x.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & sound)
    return x.select("vec_id", F.transform("x", lambda v: F.floor(F.lit(float(factor)) * v)).alias("vec"))


def _packed(rows: DataFrame, size: int, what: str) -> DataFrame:
    dealt = rows.select("dims", "vec_id", "row", "bound", "vec").mapInArrow(_pack(size), BLOCK_SCHEMA)
    return materialise(dealt, what)


def _pairs(queries: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """Hits of all pairs of a query block and a bucket that its queries may reach.

    The stated queries meet all rows in blocks: a loop over pairs of blocks that no key can
    narrow, pruned by the lengths that the queries of a block need. Equality of `dims` is written as two
    bounds, since as an equality it would deal all blocks of one dimension to one task; as it is,
    Spark broadcasts the query blocks if they are small and otherwise goes partition against partition.
    """
    q, b = queries.select(F.struct("*").alias("q")), buckets.select(F.struct("*").alias("b"))
    met = (F.col("q.dims") <= F.col("b.dims")) & (F.col("q.dims") >= F.col("b.dims"))
    met &= F.col("q.need") <= F.col("b.length") * (1 + SLACK)
    return q.join(b, met).select("q", "b").mapInArrow(_search(k), HITS)


def top_k(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of `vectors` (vec_id, vec) where `queries`
    holds, the k highest inner products with the other rows, ties to smaller vec_ids.

    Vectors are compared with those of as many dimensions. Products beyond a long stay at its
    limit. Rows that repeat a vec_id are candidates each and queries each, also for one another. A
    query gets all others if they are fewer than k; an empty table gives no row. Nothing is
    approximate: pruning drops only vectors that cannot reach a query's k-th best product so far.
    """
    spark = vectors.sparkSession
    ensure_workers(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    rows = numbered(vectors.select("vec_id", "vec", F.size("vec").alias("dims"), length.alias("length"), queries.alias("asks")), "row")
    rows = materialise(rows.withColumn("bound", F.lit(float("-inf"))), "vectors")
    order = ["dims", F.col("length").desc(), "vec_id", "row"]
    buckets = _packed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), BUCKET, "buckets")
    asking = rows.filter("asks")
    blocks = max(1, -(-asking.count() // QUERIES))
    asking = materialise(asking.repartition(blocks).sortWithinPartitions("dims", "row"), "queries")

    # One bucket of long vectors gives every query a bound, if it has k other rows.
    first = buckets.groupBy("dims").agg(F.max(F.struct((F.col("n") > k).alias("enough"), "length", "n", "nth")).alias("best"))
    first = buckets.join(first.select(F.col("best.nth").alias("nth")), "nth", "left_semi")
    seen = _ranked(_pairs(_packed(asking, QUERIES, "query-blocks"), first, k), k).filter(F.col("rank") == k)
    bounds = materialise(seen.select(F.col("query_row").alias("row_"), F.col("score").alias("least")), "bounds")
    bounded = asking.drop("bound").join(bounds, F.col("row") == F.col("row_"), "left").withColumn("bound", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))))
    # Queries that need like lengths share a block, so that its least need rules buckets out.
    need = F.when(F.col("bound") > 0, F.col("bound") / F.greatest("length", F.lit(1e-300))).otherwise(F.lit(0.0))
    bounded = bounded.withColumn("need", need).repartitionByRange(blocks, "dims", "need", "row").sortWithinPartitions("dims", "need", "row")
    return _ranked(_pairs(_packed(bounded, QUERIES, "query-blocks"), buckets, k), k).select("query_id", "rank", "vec_id", "score")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The best k of each query; Spark limits every task's rows to k a query before the shuffle."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
