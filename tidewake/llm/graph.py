"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, spread


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of links (a, b: long); nodes without links are not in it.

    Each round replaces links by as many links nearer to the smallest node; minima are aggregated before they are joined, so
    a node with very many links is spread over tasks. It ends when a round changes nothing; rounds needed grow with the logarithm
    of the longest path.
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(spread(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        new = cut(large.join(spread(small), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop_cut(now)
        now, before = new, seen
        seen = mark(now)
        if seen == before:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
