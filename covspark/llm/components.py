"""Connected components of a link table: distributed union-find by alternating stars.

Every round hooks the larger neighbours of each node to the smallest one near it, then the smaller
ones; trees flatten to stars in a number of rounds that grows with the logarithm of the longest
chain. Each round is written to the shared folder, so nothing is recomputed and lost executors
cost one round. Minima are taken before the shuffle, so a node with very many links is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covspark.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node of its component, for every node of a link; null ends and loops are ignored."""
    x, y = F.col(a), F.col(b)
    edges = links.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    edges = written(edges, "links")
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = large.join(low, "a")
        small = (
            hooked.select(F.col("b").alias("x"), "m")
            .where(F.col("x") != F.col("m"))
            .unionByName(low.select(F.col("a").alias("x"), "m"))
            .select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b"))
            .distinct()
        )
        edges, before = written(small, "links"), mark
        mark = _mark(edges)
        if mark == before:
            break
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
