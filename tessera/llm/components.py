"""Connected components of a table of links, by alternating stars.

Each round hangs every node's neighbours under the smallest of them (larger ones
first, then smaller ones), which at least halves the depth; only minima are
gathered by node, never neighbour lists. Works on tables alone: nothing of the
graph reaches the driver but a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def _hang(pairs: DataFrame, only_larger: bool) -> DataFrame:
    """Link the neighbours of each u, or only the larger ones, to the smallest of u and all of them."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(least, "u")
    moved = (joined.where("v > u") if only_larger else joined).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return (moved if only_larger else moved.unionByName(own)).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that links lead to, for every node with a link. ``links`` has long columns u and v."""
    edges = written(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = _hang(both, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = written(_hang(larger, False), "links")
        now = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
