"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import cut


def _linked(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _linked(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _linked(moved.union(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node on an edge (a, b): its component's least node.

    Both steps aggregate before they join, so a node with very many neighbours is
    a skewed join key, which adaptive execution splits, and never one task's
    list.  The steps end when the edges are stars: no edge changes any more.
    """
    now = cut(_linked(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    def mark(df: DataFrame):
        h = F.xxhash64("u", "v")
        return df.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h))).first()

    last = mark(now)
    while last[0]:
        now = cut(_small_star(_large_star(now)))
        new = mark(now)
        if new == last:
            break
        last = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
