"""Connected components of links, by rounds of star operations on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.sources.storage import forget, stored


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches) of all nodes of ``links`` (a, b).

    Each round links every node's larger neighbours, then its smaller ones, to its smallest; the
    number of rounds grows with the logarithm of the longest chain. Minima combine before the
    shuffle, so a node with very many links is no burden to one task. Loops and nulls are ignored.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    edges = links.where("a <> b").select(larger.alias("u"), smaller.alias("v")).distinct()
    edges = stored(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        older, edges = edges, stored(small.where("u <> v").distinct(), "small")
        forget(older, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
