"""Joining the graphs of a paper's pieces: one id namespace, then folding of records with the same text.

The rule for "same text" is a parameter; the default compares class and text without case and spacing. It is inferred
from how the fold is reported, so callers with another rule pass their own key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.ordering import number_rows
from claimweave.functions.text import comparable
from claimweave.session import settle

#: Room for positions inside one piece when pieces are put in sequence.
PIECE_STRIDE = 1 << 40


def same_text() -> Column:
    return F.sha2(F.concat_ws("|", F.col("type"), comparable(F.col("text"))), 256)


def joined_pieces(nodes: DataFrame, edges: DataFrame, paper: Column, piece: Column) -> tuple[DataFrame, DataFrame]:
    """Renumber piece graphs into one namespace per paper.

    ``paper`` and ``piece`` are expressions over the piece graph's ``graph_id``. Nodes become ``g0, g1, …`` in piece
    order and then record order; edges follow. Both keep their piece and, as ``piece_id`` and ``piece_ord``, what they were
    called in it.
    """
    placed = nodes.withColumns({"piece": piece, "_paper": paper}).withColumn(
        "_seq", F.col("piece") * F.lit(PIECE_STRIDE) + F.col("ord")
    )
    numbered = number_rows(placed, ["_paper"], "_seq", "_n")
    renamed = numbered.withColumn("new_id", F.concat(F.lit("g"), F.col("_n").cast("string")))
    joined = renamed.select(
        F.col("_paper").alias("graph_id"), "piece", F.col("_n").alias("ord"), F.col("new_id").alias("id"),
        F.col("id").alias("piece_id"), "type", "text", "description", "doi", "url", "anchor",
    )
    ids = joined.select(F.col("graph_id").alias("_paper"), "piece", "piece_id", "id")
    followed = (
        edges.withColumns({"piece": piece, "_paper": paper})
        .join(ids.withColumnsRenamed({"piece_id": "subject", "id": "_subject"}), ["_paper", "piece", "subject"])
        .join(ids.withColumnsRenamed({"piece_id": "object", "id": "_object"}), ["_paper", "piece", "object"])
        .withColumn("_seq", F.col("piece") * F.lit(PIECE_STRIDE) + F.col("ord"))
        .withColumnRenamed("ord", "piece_ord")
    )
    followed = number_rows(followed, ["_paper"], "_seq", "_n").select(
        F.col("_paper").alias("graph_id"), "piece", F.col("_n").alias("ord"), "relation",
        F.col("_subject").alias("subject"), F.col("_object").alias("object"), "anchor", "consolidated", "piece_ord",
    )
    return joined, followed


def record_ids(nodes: DataFrame, folds: DataFrame) -> DataFrame:
    """``(graph_id, piece, piece_id, id)``: under which id each record of the joined pieces lives on after the fold."""
    named = nodes.select("graph_id", "piece", "piece_id", "id")
    return named.join(folds, ["graph_id", "id"], "left").select("graph_id", "piece", "piece_id", F.coalesce("survivor", "id").alias("id"))


def edge_ords(joined_edges: DataFrame, folds: DataFrame, kept: DataFrame) -> DataFrame:
    """``(graph_id, piece, piece_ord, ord)``: the edge that each edge of the joined pieces lives on in."""
    triple = ["graph_id", "relation", "subject", "object"]
    moved = repoint(joined_edges.select(*triple, "piece", "piece_ord"), folds)
    return moved.join(kept.select(*triple, "ord"), triple).select("graph_id", "piece", "piece_ord", "ord")


def piece_lineage(nodes: DataFrame, folds: DataFrame) -> DataFrame:
    """``(graph_id, id, piece, records)``: how many records of which piece each surviving record stands for."""
    return record_ids(nodes, folds).groupBy("graph_id", "id", "piece").agg(F.count(F.lit(1)).alias("records"))


def text_folds(nodes: DataFrame, key: Callable[[], Column] = same_text) -> DataFrame:
    """``(graph_id, id, survivor)`` for every record folded into an earlier one with the same key."""
    # Texts are compared once and not moved: keys, ids and positions go on, and only positions are aggregated.
    keyed = settle(nodes.select("graph_id", "id", "ord", key().alias("_key")), "text-keys")
    heads = keyed.groupBy("graph_id", "_key").agg(F.min("ord").alias("_head"), F.count(F.lit(1)).alias("_uses"))
    headed = keyed.join(heads.where(F.col("_uses") > 1), ["graph_id", "_key"]).drop("_key")
    survivors = headed.where(F.col("ord") == F.col("_head")).select("graph_id", "_head", F.col("id").alias("survivor"))
    return (
        headed.where(F.col("ord") != F.col("_head"))
        .join(survivors, ["graph_id", "_head"])
        .select("graph_id", "id", "survivor")
    )


def fold_nodes(nodes: DataFrame, folds: DataFrame) -> DataFrame:
    """Drop folded records; a survivor takes the longest description (ties: earliest) and the first anchor.

    Descriptions and anchors of all members are combined map-side per survivor before they meet it.
    """
    kept = nodes.join(folds.select("graph_id", "id"), ["graph_id", "id"], "left_anti")
    members = folds.join(nodes.select("graph_id", "id", "ord", "description", "anchor"), ["graph_id", "id"])
    offered = (
        members.groupBy("graph_id", F.col("survivor").alias("id"))
        .agg(
            F.max_by("description", F.struct(F.length("description"), -F.col("ord")))
            .alias("_description"),
            F.min_by("anchor", F.when(F.col("anchor").isNotNull(), F.col("ord"))).alias("_anchor"),
        )
    )
    longer = F.coalesce(F.length("_description"), F.lit(0)) > F.coalesce(F.length("description"), F.lit(0))
    return (
        kept.join(offered, ["graph_id", "id"], "left")
        .withColumn("description", F.when(longer, F.col("_description")).otherwise(F.col("description")))
        .withColumn("anchor", F.coalesce("anchor", "_anchor"))
        .drop("_description", "_anchor")
    )


def repoint(edges: DataFrame, folds: DataFrame) -> DataFrame:
    """Replace folded ends by their survivors."""
    subjects = folds.select("graph_id", F.col("id").alias("subject"), F.col("survivor").alias("_subject"))
    objects = folds.select("graph_id", F.col("id").alias("object"), F.col("survivor").alias("_object"))
    return (
        edges.join(subjects, ["graph_id", "subject"], "left")
        .join(objects, ["graph_id", "object"], "left")
        .withColumns(
            {"subject": F.coalesce("_subject", "subject"), "object": F.coalesce("_object", "object")}
        )
        .drop("_subject", "_object")
    )


def first_triples(edges: DataFrame, *carried: str) -> DataFrame:
    """One row per (relation, subject, object): the earliest by ``ord``, with the ``carried`` columns of that row.

    Only positions are aggregated; the carried columns are fetched by the position, which is unique in a graph.
    """
    triple = ["graph_id", "relation", "subject", "object"]
    edges = settle(edges.select(*triple, "ord", *carried), "triples")
    first = edges.groupBy(*triple).agg(F.min("ord").alias("ord")).select("graph_id", "ord")
    return edges.join(first, ["graph_id", "ord"], "left_semi").select(*triple, "ord", *carried)


def fold_exact(
    nodes: DataFrame, edges: DataFrame, key: Callable[[], Column] = same_text
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold equal records of each graph. Returns nodes, edges and the fold map.

    The fold map is written once: it is narrow, and comparing whole texts is the expensive part.
    """
    folds = settle(text_folds(nodes, key), "text-folds")
    return fold_nodes(nodes, folds), first_triples(repoint(edges, folds), "anchor", "consolidated"), folds


def collapsed_counts(nodes: DataFrame, folds: DataFrame) -> DataFrame:
    """Records before the fold and records folded, per graph."""
    before = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("records"))
    folded = folds.groupBy("graph_id").agg(F.count(F.lit(1)).alias("collapsed"))
    return before.join(folded, "graph_id", "left").withColumn("collapsed", F.coalesce("collapsed", F.lit(0)))
