"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.staging import removed, staged


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b); the root is the least node of its component.

    Each step hangs neighbours on the least node seen. Edges stay as many as they were or
    fewer, and are written after each round; the rounds end when every node hangs on a root.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = staged(pairs, "component-edges")
    for _ in range(most_rounds):
        if _settled(pairs):
            roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        nxt = staged(_small_star(_large_star(pairs)), "component-edges")
        removed(pairs)
        pairs = nxt
    raise RuntimeError("components did not settle")


def _settled(pairs: DataFrame) -> bool:
    """Whether each node that hangs on another hangs on one only, and has none hanging on it: a round would change nothing."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("hangs")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("hangs")))).alias("end"))
    counts = ends.groupBy("end.node").agg(F.count("*").alias("n"), F.max("end.hangs").alias("hangs"))
    return counts.where("hangs = 1 AND n > 1").isEmpty()


def _large_star(pairs: DataFrame) -> DataFrame:
    """Pairs may repeat here, but are no more than they were."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    hung = both.join(least, both["a"] == least["u"]).where("b > a")
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every pair here leads from a node to a smaller one."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    hung = pairs.join(least, pairs["a"] == least["u"])
    # Both ends hang on the least one, which itself does not.
    return hung.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
