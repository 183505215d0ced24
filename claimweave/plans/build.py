"""The end-to-end build: replies in, clean graph, linked-data objects and report out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.ordering import number_rows
from claimweave.operators import edits, merge, project
from claimweave.operators.classify import Graph
from claimweave.operators.project import Naming
from claimweave.session import settle


@dataclass
class Projection:
    """All projection tables of a corpus over one clean graph; each is planned on first use.

    The relation objects and the object rows feed several tables, so with ``durable`` they are written once.
    """

    nodes: DataFrame
    edges: DataFrame
    papers: DataFrame
    naming: Naming
    durable: bool = False
    #: ``(graph_id, name)`` that base addresses are made from; without it a graph goes by its id.
    names: DataFrame | None = None

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return settle(df, name) if self.durable else df

    @cached_property
    def minted(self) -> DataFrame:
        return project.minted_nodes(self.nodes)

    @cached_property
    def paper_docs(self) -> DataFrame:
        return project.paper_documents(self.minted, self.papers)

    @cached_property
    def stamps(self) -> DataFrame:
        return project.evidence_stamps(self.minted, self.edges, self.paper_docs)

    @cached_property
    def node_objects(self) -> DataFrame:
        return project.node_objects(self.minted, self.stamps, self.papers, self.paper_docs)

    @cached_property
    def relation_objects(self) -> DataFrame:
        return self._keep(project.relation_objects(self.edges, self.minted), "relation-objects")

    @cached_property
    def graphs(self) -> DataFrame:
        return self.nodes.select("graph_id").distinct()

    @cached_property
    def object_rows(self) -> DataFrame:
        """The objects as planned, for a reader that takes them once."""
        return project.linked_objects(
            self.nodes, self.papers, self.node_objects, self.relation_objects, self.naming
        )

    @cached_property
    def objects(self) -> DataFrame:
        return self._keep(self.object_rows, "objects")

    @cached_property
    def report(self) -> DataFrame:
        return project.projection_report(
            self.nodes, self.edges, self.node_objects, self.relation_objects, self.stamps
        )

    def documents(self, width: int = project.OBJECTS_PER_PART, part_bytes: int = project.BYTES_PER_PART) -> DataFrame:
        names = self.graphs.select("graph_id", F.col("graph_id").alias("name")) if self.names is None else self.names
        return project.documents(self.objects, names, self.naming, width, part_bytes)


def projection_of(graph: Graph, papers: DataFrame, naming: Naming, durable: bool = False) -> Projection:
    return Projection(graph.nodes, graph.edges, papers, naming, durable)


@dataclass
class Merged:
    """One graph per paper in the namespace ``g0, g1, …``, records with equal text folded.

    ``nodes`` are numbered densely anew; ``folds`` says which record went into which. ``ids(graph_id, old_id, id)`` and
    ``ords(graph_id, old_ord, ord)`` lead from the records and edges of the classified graph to what became of them.
    """

    nodes: DataFrame
    edges: DataFrame
    folds: DataFrame
    ids: DataFrame
    ords: DataFrame


def merged(graph: Graph) -> Merged:
    """Renumber and fold a classified corpus whose papers came whole; every build does so before it projects."""
    joined = merge.joined_pieces(graph.nodes, graph.edges, F.col("graph_id"), F.lit(0).cast("bigint"))
    placed, moved = settle(joined[0], "merged-records"), settle(joined[1], "merged-relations")
    nodes, edges, folds = merge.fold_exact(placed.drop("piece_id"), moved)
    numbered = number_rows(nodes.withColumnRenamed("ord", "_ord"), ["graph_id"], "_ord", "ord").drop("_ord", "piece")
    kept = settle(edges, "merged-edges")
    ids = merge.record_ids(placed, folds).select("graph_id", F.col("piece_id").alias("old_id"), "id")
    ords = merge.edge_ords(moved, folds, kept).select("graph_id", F.col("piece_ord").alias("old_ord"), "ord")
    return Merged(settle(numbered, "merged-nodes"), kept, folds, ids, ords)


@dataclass
class MergedStage:
    """The merged graph staged for review, and edits recorded against the classified graph carried over to it."""

    graph: Graph
    whole: Merged
    log: DataFrame

    @cached_property
    def _old_edges(self) -> DataFrame:
        return settle(edits.numbered_edges(self.graph.edges, edits.refused_edges(self.graph)), "old-stage")

    @cached_property
    def edges(self) -> DataFrame:
        """Staged edges of the merged graph: its relations, then the refused ones with their ends carried over."""
        # Numbering reads its rows twice, so the ends are carried over before and once.
        refused = settle(edits.renamed(edits.refused_edges(self.graph), self.whole.ids, ["subject", "object"]), "refused-ends")
        return settle(edits.numbered_edges(self.whole.edges, refused), "merged-stage")

    @cached_property
    def edge_ids(self) -> DataFrame:
        """``(graph_id, old_id, id)`` of staged edges."""
        old = self._old_edges.select("graph_id", F.col("id").alias("old_id"), "branch", "pos")
        new = self.edges.select("graph_id", "id", "branch", "pos")
        ords = self.whole.ords.select("graph_id", F.col("old_ord").alias("pos"), F.col("ord").alias("_pos"))
        accepted = old.where("branch = 0").join(ords, ["graph_id", "pos"]).drop("pos").withColumnRenamed("_pos", "pos")
        return accepted.unionByName(old.where("branch > 0")).join(new, ["graph_id", "branch", "pos"]).select("graph_id", "old_id", "id")

    @cached_property
    def rebased(self) -> DataFrame:
        """The edit log in the names of the merged graph."""
        # New records have the same places in both stagings; only where their numbers start differs.
        adds = settle(edits.numbered_adds(self.log), "numbered-adds")
        before = edits.named_adds(adds, self._old_edges, self.graph.nodes).select("graph_id", "seq", "op", F.col("id").alias("old_id"))
        after = edits.named_adds(adds, self.edges, self.whole.nodes).select("graph_id", "seq", "id")
        added = settle(before.join(after, ["graph_id", "seq"]), "added-names")
        own = lambda op: added.where(F.col("op") == op).select("graph_id", "old_id", "id")
        nodes = settle(self.whole.ids.unionByName(own("addNode")), "record-names")
        return settle(edits.rebased(self.log, nodes, self.edge_ids.unionByName(own("addEdge"))), "rebased-log")

    @cached_property
    def edited(self) -> tuple[DataFrame, DataFrame]:
        nodes, edges = edits.replayed(self.whole.nodes, self.edges, self.rebased)
        return settle(nodes, "merged-edited-nodes"), settle(edges, "merged-edited-edges")


def built(graph: Graph, papers: DataFrame, naming: Naming, names: DataFrame | None = None) -> Projection:
    """The whole build from a classified corpus: renumber, fold, project. ``names`` are as from ``routing.run_names``."""
    whole = merged(graph)
    return Projection(whole.nodes, whole.edges, papers, naming, durable=True, names=names)
