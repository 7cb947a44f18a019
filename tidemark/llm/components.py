"""Connected components of a table of links, by alternating stars.

Each round hangs every node's neighbours under the smallest node it can see,
first the larger ones, then the smaller. Only minima are gathered, never the
neighbours of a node, so a node with very many links is spread over tasks like
any other. Rounds grow with the logarithm of a component's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import discard, stage


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, lowest) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) with the smallest b of each a, which is staged so that a hub's rows can be split in the join."""
    small = stage(edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", lowest), "minima")
    return edges.join(small, "a"), small


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of long ids as rows (node, root): the smallest id of each linked component, for all its other nodes."""
    edges = stage(links.select("a", "b").filter("a <> b").distinct(), "links")
    before = _sum(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        star, m1 = _star(both, F.least("a", "m"))
        large = stage(star.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        star, m2 = _star(large, F.col("m"))
        to = F.explode(F.array("a", "b")).alias("a")
        small = stage(star.select(to, F.col("m").alias("b")).filter("a <> b").distinct(), "small-star")
        after = _sum(small)
        for old in (edges, m1, large, m2):
            discard(old)
        edges, (before, done) = small, (after, after == before)
        if done:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
