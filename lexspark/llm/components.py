"""Connected components by alternating stars, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import removed, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. Edges run from larger u to smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """node, component (its least node), for every node on an edge (u, v) of comparable values; loops don't matter.

    Each round cuts its lineage with a table in the shared folder. The driver sees one row a round, to know the end.
    """
    ends = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = written(ends, name)
    before = None
    for _ in range(rounds):
        last, current = current, written(_small_star(_large_star(current)), name)
        removed(last)
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
