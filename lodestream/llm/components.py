"""Connected components by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.shared import discard, materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its smallest node.

    Each turn writes its edges, which number no more than before, and ends
    when no edge changes, after about log of the longest path. A node's edges
    are joined with the minimum that was reduced for it before, so that a hub
    is dealt out by the skew join, not gathered.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = materialise(pairs, "edges")
    state = _state(now)
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "edges")
        # here a > b: b are the smaller neighbours of a
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        old, now = now, materialise(small.where("a <> b").distinct(), "edges")
        discard(old, large)
        before, state = state, _state(now)
        if state == before:
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
