"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import settle


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``, the root being the smallest node it can reach.

    Alternating star contraction: each vertex points its larger neighbours, then all its smaller ones, to the smallest of its
    neighbourhood. Rounds grow with the logarithm of the longest path; each ends in a written table.
    """
    edges = settle(_directed(links), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = settle(_small(_large(edges)), "links")
    roots = edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_anti")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )


def _directed(links: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller end."""
    return links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lowest.select("u", F.col("m").alias("v")).unionByName(moved).distinct()
