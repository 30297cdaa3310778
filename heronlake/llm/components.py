"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equi-join of two written tables, so that Spark
can split a hot node. Each step's edges are written to the shared folder; the one before is deleted. The number of
steps grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import Written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: of each node, all larger neighbours get the smallest as theirs. Small star: the same for the smaller ones and the node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = Written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "least")
    met = both.join(least.df, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.df.select("a", F.col("low").alias("b")))
    new = Written(out.where("a <> b").distinct(), "star")
    least.drop()
    return new


def components(edges: DataFrame, max_steps: int = 60) -> Written:
    """Written (node, root): the smallest node reachable, for each node with an edge. edges: a, b (long)."""
    now = Written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    mark = None
    for _ in range(max_steps):
        large = _star(now.df, True)
        now.drop()
        now = _star(large.df, False)
        large.drop()
        seen = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    done = Written(now.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "components")
    now.drop()
    return done
