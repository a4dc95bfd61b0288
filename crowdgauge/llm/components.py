"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b); root is the smallest node it reaches.

    Large-star and small-star steps take turns until the links no longer change: every node points to a smaller
    neighbour each time, so the number of rounds grows with the logarithm of the longest chain. Each round is
    written to the shared folder. No node's links are gathered in one place: minima are folded before the shuffle,
    and the joins are equi-joins that adaptive execution may split."""
    current, state = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"), None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        current = written(small.select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").unionByName(
            low.select("a", F.col("low").alias("b"))).distinct(), "links")
        found = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if found == state:
            break
        state = found
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
