"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a few shuffles of the edges; its result is written in the shared folder, so lineage stays short and no
edge or label passes through the driver (only two numbers that tell whether a round changed anything).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stage_table


def _least(edges: DataFrame, side: str) -> DataFrame:
    return edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias(side))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both, "m"), F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are linked to the smallest of them. ``edges``: u > v."""
    to_least = edges.join(_least(edges, "m"), F.col("u") == F.col("c"))
    return to_least.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u > v")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another node; component: the smallest node.

    ``edges`` has two integer columns u and v; order, repeats and self-loops don't matter; an empty table gives an empty
    result.
    """
    now = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u > v").distinct()
    now, before = stage_table(now, "edges"), None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before = seen
        now = stage_table(small_star(large_star(now)).distinct(), "edges")
    raise RuntimeError("components did not settle")
