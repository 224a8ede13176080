"""Connected components of an edge table, as joins and aggregates over checkpointed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from launchlens.session import cut_lineage

#: Shuffle partitions of edges, keys and pairs that go to one checkpoint file.
PARTS_A_FILE = 8


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node with a link to another.

    `edges` has columns a and b (long), in any direction, repeated or not; null ends and
    loops are ignored. Each round hooks all neighbours of a node to its smallest
    neighbour, first the larger ones and then the smaller ones, until the edges form
    stars, which is looked at before each round; the number of rounds grows with the logarithm of a component's size. A hub's minimum is
    combined on the map side and its edges are spread by Spark's skew join.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))
    )
    e = cut_lineage(e.distinct(), PARTS_A_FILE)
    for _ in range(max_rounds):
        if _stars(e):
            break
        both = e.union(e.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours move to the node's minimum
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself move to the minimum
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        e = cut_lineage(small.select("p.*").where("u > v").distinct(), PARTS_A_FILE)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _stars(e: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has that edge only."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("p")).select("p.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 and n > 1").isEmpty()
