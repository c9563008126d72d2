"""Connected components by large-star and small-star steps over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import tables


def _sign(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of edges (a, b: long). No edges, no rows.

    Each round hangs larger neighbours on a node's smallest neighbour (minima are combined before the shuffle) and
    writes the edges to the shared folder; stars are done after about log2 of the longest path rounds.
    """
    current = tables.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = _sign(current)
    if not before[0]:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        current = tables.keep(small, "edges")
        now = _sign(current)
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select("b", "b").distinct())
