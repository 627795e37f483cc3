"""Connected components of a graph in a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import checkpointed


def connected_components(links: DataFrame) -> DataFrame:
    """links: a long, b long. Returns (node, root): of each node with a link to another, the smallest node reachable.

    Stars by turns: each node's larger neighbours are tied to the smallest neighbour, then its smaller ones are, until all
    hang on the smallest node of their component. The rounds grow with the logarithm of the longest path. A node with many
    neighbours is summed up before the shuffle; its rows come back by a join that Spark splits when they are many.
    """
    tied = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (now := _mark(tied)) != before and now[0]:
        before = now
        both = tied.union(tied.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        tied = checkpointed(small)
    roots = tied.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return tied.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _mark(tied: DataFrame) -> tuple:
    return tuple(tied.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
