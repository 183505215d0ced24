"""Checking grounding quotes against the source text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.ordering import block_of
from claimweave.functions.text import comparable

#: Quotes checked per copy of a text; a paper with more quotes gets one more copy of its text per block.
QUOTES_PER_TEXT = 4096


def check_anchors(anchors: DataFrame, texts: DataFrame, width: int = QUOTES_PER_TEXT) -> DataFrame:
    """Add ``match`` (exact, normalized, missing; NULL without a quote or a text) to anchors.

    ``anchors(paper_id, pos, anchor)`` meets ``texts(paper_id, text)``. Quotes are packed into arrays first, so a text
    is joined once per block of quotes instead of once per quote, and the normalised text is computed at most once
    per block and only when a quote is not found verbatim.
    """
    quoted = anchors.where(F.col("anchor") != "").withColumn("_block", block_of(F.col("pos"), width))
    packed = quoted.groupBy("paper_id", "_block").agg(
        F.collect_list(F.struct("pos", "anchor", comparable(F.col("anchor")).alias("norm"))).alias("_quotes")
    )
    joined = packed.join(texts.where(F.col("text") != "").select("paper_id", "text"), "paper_id")
    verbatim = F.transform(
        "_quotes", lambda q: q.withField("exact", F.contains(F.col("text"), q["anchor"]))
    )
    needs_norm = F.exists("_checked", lambda q: ~q["exact"])
    # A one-element array binds the normalised text to a lambda variable: evaluated once, not once per quote.
    judged = F.transform(
        F.array(F.when(needs_norm, comparable(F.col("text"))).otherwise(F.lit(""))),
        lambda norm: F.transform(
            "_checked",
            lambda q: F.struct(
                q["pos"].alias("pos"),
                F.when(q["exact"], "exact").when(F.contains(norm, q["norm"]), "normalized").otherwise("missing")
                .alias("match"),
            ),
        ),
    )[0]
    matches = (
        joined.withColumn("_checked", verbatim)
        .select("paper_id", F.explode(judged).alias("_m"))
        .select("paper_id", "_m.pos", "_m.match")
    )
    return anchors.join(matches, ["paper_id", "pos"], "left")


def anchor_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Records and anchored records per graph, for nodes and edges."""
    kinds = nodes.select("graph_id", F.lit("node").alias("kind"), "anchor").unionByName(
        edges.select("graph_id", F.lit("edge").alias("kind"), "anchor")
    )
    is_node, is_edge = F.col("kind") == "node", F.col("kind") == "edge"
    anchored = F.col("anchor").isNotNull()
    return kinds.groupBy("graph_id").agg(
        F.count_if(is_node).alias("nodes"),
        F.count_if(is_node & anchored).alias("nodes_with_anchor"),
        F.count_if(is_edge).alias("edges"),
        F.count_if(is_edge & anchored).alias("edges_with_anchor"),
    )


def verified_anchors(checked: DataFrame) -> DataFrame:
    """Per graph: live nodes whose quote is not known to be missing. A quote without a source text counts as found."""
    live = ~F.coalesce("dropped", F.lit(False))
    has_quote = F.coalesce("anchor", F.lit("")) != ""
    found = F.coalesce("match", F.lit("unchecked")) != "missing"
    return checked.groupBy("graph_id").agg(
        F.count_if(live).alias("live_nodes"), F.count_if(live & has_quote & found).alias("anchored_nodes")
    )


def anchor_worklist(checked: DataFrame) -> DataFrame:
    """Records whose quote is not in the text and needs a reviewer."""
    return checked.where(F.col("match") == "missing")
