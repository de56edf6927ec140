"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component.

    `edges` has number columns a and b, in any direction, repeats and loops allowed. Minima
    are pre-aggregated before each shuffle. Both sides of every join are written tables: the
    adaptive join splits only what comes straight from a shuffle, and so a node with many links
    is spread over tasks. Each round is written to shared storage and no edge reaches the driver.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialise(links, "edges")
    seen = _mark(links)
    while seen[0]:
        # Large star: every greater neighbour is linked to the least of the neighbourhood.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.filter("a <> b").distinct(), "edges")
        # Small star: smaller neighbours, and the node itself, are linked to the least of them.
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), "least")
        moved = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        links = materialise(moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        now = _mark(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
