"""Connected components of a graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.sources.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b: long); the root is the component's smallest node.

    Each round hangs all neighbours of a node on the smallest one (larger ones first, then smaller ones) until only
    stars remain. Minima are aggregated before they move, so a node with many neighbours makes no hot group. Rounds
    end in a written table; no lineage grows. No edges give no rows; loops and repeated edges are harmless.
    """
    links = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == seen or state[0] == 0:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = tuple(state)
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = (
            both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        )
        large = materialize(large, "links")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = materialize(small.union(low).distinct(), "links")
