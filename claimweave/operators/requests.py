"""Request tables for the model: one row per call, prompt wording supplied by the caller."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.vocab import CONSOLIDATION_LIMIT, CONSOLIDATION_TEXT_LIMIT


@dataclass(frozen=True)
class Prompts:
    """Configurable wording."""

    system: str = "Read the paper and return its discourse graph as one JSON object with nodes and edges."
    whole_paper: str = "The whole paper follows."
    section: str = "One part of the paper follows."
    consolidate: str = "Review these records; return merges and missing relations as one JSON object."


def extraction_requests(texts: DataFrame, prompts: Prompts = Prompts(), whole: bool = True) -> DataFrame:
    """Add ``system_message`` and ``user_message`` to papers or pieces with a ``text`` column."""
    preamble = prompts.whole_paper if whole else prompts.section
    return texts.withColumns(
        {
            "system_message": F.lit(prompts.system),
            "user_message": F.concat(F.lit(preamble + "\n\n---\n"), "text"),
        }
    )


def consolidation_eligibility(nodes: DataFrame, limit: int = CONSOLIDATION_LIMIT) -> DataFrame:
    """Records per graph and the reason when there are too many for one call."""
    reason = F.concat(F.col("records").cast("string"), F.lit(f" records, over the limit of {limit}"))
    return (
        nodes.groupBy("graph_id")
        .agg(F.count(F.lit(1)).alias("records"))
        .withColumn("skipped", F.when(F.col("records") > limit, reason))
    )


def consolidation_requests(
    nodes: DataFrame, edges: DataFrame, prompts: Prompts = Prompts(), limit: int = CONSOLIDATION_LIMIT
) -> DataFrame:
    """``(graph_id, part, n_parts, user_message)``: requests that hold record lists and existing relations as JSON.

    Every record is in exactly one part of at most ``limit`` records, by its number ``ord``; a relation stands in the
    part of its subject. A graph within the limit is one part.
    """
    cut = lambda name: F.substring(name, 1, CONSOLIDATION_TEXT_LIMIT).alias(name)
    part = F.floor(F.col("ord") / F.lit(limit)).cast("int").alias("part")
    placed = nodes.select("graph_id", part, "ord", F.struct("id", "type", cut("text"), cut("description")).alias("r"))
    node_lists = placed.groupBy("graph_id", "part").agg(F.array_sort(F.collect_list(F.struct("ord", "r"))).alias("_n"))
    sizes = nodes.groupBy("graph_id").agg((F.max(F.floor(F.col("ord") / F.lit(limit))) + 1).cast("int").alias("n_parts"))
    subjects = nodes.select("graph_id", F.col("id").alias("subject"), part)
    edge_lists = (
        edges.select("graph_id", "ord", "relation", "subject", "object")
        .join(subjects, ["graph_id", "subject"])
        .groupBy("graph_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("ord", F.struct("relation", "subject", "object").alias("r")))).alias("_e"))
    )
    no_edges = F.array().cast("array<struct<relation: string, subject: string, object: string>>")
    payload = F.to_json(F.struct(F.col("_n.r").alias("nodes"), F.coalesce("_e.r", no_edges).alias("edges")))
    return (
        node_lists.join(edge_lists, ["graph_id", "part"], "left")
        .join(sizes, "graph_id")
        .select("graph_id", "part", "n_parts", F.concat(F.lit(prompts.consolidate + "\n\n"), payload).alias("user_message"))
    )
