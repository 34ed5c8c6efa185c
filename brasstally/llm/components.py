"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasstally.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").where("dst > m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node and label (the smallest node of its component) of every node in ``edges`` (src, dst).

    Each round ends with a checkpoint; only the number of links and a sum of their hashes come to the driver. Links from a
    node to itself and links with a null end are ignored.
    """
    least, most = F.least("src", "dst"), F.greatest("src", "dst")
    now = edges.where("src <> dst").select(most.alias("src"), least.alias("dst")).distinct()
    seen = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("label")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct())
