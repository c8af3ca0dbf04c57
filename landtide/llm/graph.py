"""Connected components over an edge table, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landtide.llm.store import drop, settle


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for each node of the undirected ``edges (a, b)``; the component is its smallest node.

    Alternates two star contractions until no edge changes: each node's larger
    neighbours are linked to its smallest neighbour, then its smaller ones. Minima
    per node are partially aggregated before the shuffle and written before they
    are joined, so that the join's own shuffles can be split where a node has very
    many edges. Each round is written to the shared folder; rounds grow with the
    logarithm of the longest path.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = settle(edges.select(high.alias("u"), low.alias("v")).where("u <> v").distinct(), name)
    while True:
        # Large star: every neighbour above u, to the smallest of u and its neighbours.
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low_of = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = settle(both.join(low_of, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        # Small star: u and its smaller neighbours, to the smallest of them.
        min_of = settle(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(min_of, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = settle(small, name)
        changed = after.exceptAll(now).limit(1).count() + now.exceptAll(after).limit(1).count()
        drop(now, low_of, large, min_of)
        now = after
        if not changed:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
