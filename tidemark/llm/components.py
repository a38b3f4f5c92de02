"""Connected components of an edge table by large-star and small-star, with DataFrames alone.

Each round joins the edges with the least neighbour of a node, which is found by an aggregate that
combines on the map side, so a node with very many edges is spread like any other skewed join. Rounds
end when the edges no longer change; their number grows with the logarithm of the longest path. Each
round's edges are a table in the shared folder, which takes the place of the one before: lineage stays
short and lost executors cost little.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node that has an edge (columns u, v of one ordered type); root: the least node reachable."""
    shelf, before, k = Shelf(edges.sparkSession, "components"), None, 0
    edges = shelf.put("0", edges.select("u", "v").filter("u <> v").distinct())
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before, k = state, k + 1
        edges = shelf.put(str(k), _small_star(_large_star(edges)))
        shelf.drop(str(k - 1))
