"""Connected components by alternating star contractions, all in joins and aggregations that can be split.

Each round sends every node's larger neighbours to its smallest one (large star), then its smaller ones (small star).
The rounds are logarithmic in the size of the largest component, and a node's neighbours are only ever aggregated.
Rounds never add edges, so the edges that are left stand in as many partitions as their number asks for: a graph that
fits one partition is contracted in one task, without shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import Scratch

#: Edges, of two numbers each, to a partition.
PARTITION_EDGES = 100_000


def connected_components(edges: DataFrame, most_rounds: int = 60, partition_edges: int = PARTITION_EDGES) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable."""

    def pairs(rows: DataFrame, *made: str) -> DataFrame:
        return rows.select(F.inline(F.expr(f"array({', '.join(f'struct({x})' for x in made)})"))).where("a <> b")

    def told(rows: DataFrame):
        return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hash")).first()

    scratch = Scratch(edges.sparkSession)
    table = scratch.written(edges.selectExpr("greatest(a, b) a", "least(a, b) b").where("a <> b").distinct())
    before = told(table)
    partitions = max(1, -(-before.n // partition_edges))
    now = table.coalesce(partitions)
    for _ in range(most_rounds):
        both = pairs(now, "a, b", "b a, a b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) m")
        large = pairs(both.where("b > a").join(least, "a"), "b a, m b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = pairs(large.join(least, "a"), "b a, m b", "a, m b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct()
        table = scratch.written(small.coalesce(partitions))
        scratch.drop_others(table)
        now = table.coalesce(partitions)
        same = told(now)
        if same == before:
            break
        before = same
    else:
        raise RuntimeError("the components did not settle")
    star = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
