"""Connected components by alternating large-star and small-star joins over tables in the shared folder.

Scale: each round is two joins and aggregates by node with partial aggregation; nothing is collected but one row of
totals. Tables of earlier rounds are removed. The number of rounds grows with the logarithm of the longest chain.

Defined cases: no edges give no rows; repeated edges and edges in either direction count once; a node linked to itself
only is no node of an edge; if `max_rounds` do not suffice, an error is raised and nothing is returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of an edge (a, b)."""
    spark = edges.sparkSession
    edges = stored(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "components")
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: neighbours not above the node, and the node, link to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("x"), F.col("m").alias("b"))
        before, edges = edges, stored(spark, small.where("x <> b").select(F.col("x").alias("a"), "b").distinct(), "components")
        discard(before)
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if seen == tuple(state):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(state)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
