"""Admission of raw records into the graph, with a reason for every rejection.

``raw_nodes(graph_id, pos, id, type, text, description, doi, url, anchor)`` and
``raw_edges(graph_id, pos, relation, subject, object, anchor)`` carry the record's position in the reply; every
"first wins" rule is a rule about ``pos``. First occurrences come from aggregates that combine map-side, so neither
a reused id nor a repeated triple that makes up much of the data lands in one task uncombined.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.ordering import number_rows
from claimweave.functions.text import none_if_empty, quote, strip, text_or_empty
from claimweave.session import settle
from claimweave.vocab import NODE_CLASSES, legal_triples, relation_rules


def wanted_versus_got(relation: Column, wants: Column, subj_type: Column, obj_type: Column) -> Column:
    return F.concat(relation, F.lit(" wants "), wants, F.lit(", got "), subj_type, F.lit("→"), obj_type)


def _checked(raw_nodes: DataFrame) -> DataFrame:
    """``graph_id, pos, id, type, raw_type`` and the fault a node has on its own.

    Texts are looked at in the scan and left there: everything that shuffles is narrow.
    """
    return raw_nodes.select(
        "graph_id",
        "pos",
        text_or_empty(F.col("id")).alias("id"),
        text_or_empty(F.col("type")).alias("type"),
        F.coalesce("type", F.lit("")).alias("raw_type"),
        (text_or_empty(F.col("text")) == "").alias("_blank"),
    ).withColumn(
        "_fault",
        F.when(F.col("id") == "", "missing id")
        .when(F.col("_blank"), "missing text")
        .when(~F.col("type").isin(NODE_CLASSES), F.concat(F.lit('invalid type "'), "raw_type", F.lit('"'))),
    )


def admit_nodes(raw_nodes: DataFrame) -> DataFrame:
    """``(graph_id, pos, id, type)`` of the admitted nodes: the first faultless record of each id.

    One hash aggregate, combined map-side; its output is already partitioned for the joins on (graph_id, id). Position
    and class share one number, of which the class is the last digit, since only numbers aggregate without a sort.
    """
    classes = F.array(*[F.lit(name) for name in NODE_CLASSES])
    width = len(NODE_CLASSES)
    packed = F.col("pos") * width + F.array_position(classes, F.col("type")) - 1
    return (
        _checked(raw_nodes)
        .where(F.col("_fault").isNull())
        .groupBy("graph_id", "id")
        .agg(F.min(packed).alias("_first"))
        .select(
            "graph_id",
            F.expr(f"_first div {width}").alias("pos"),
            "id",
            F.element_at(classes, (F.col("_first") % width + 1).cast("int")).alias("type"),
        )
    )


def judge_nodes(raw_nodes: DataFrame) -> DataFrame:
    """The verdict on every raw node: ``graph_id, pos, id, type, raw_type, why`` (``why`` is NULL when admitted).

    Reasons in order: missing id, missing text, invalid type, duplicate id. Only otherwise valid records reserve an
    id, so a rejected record never blocks a later one.
    """
    narrow = _checked(raw_nodes)
    # Ids claimed more than once are the exception: only they travel to the join.
    reused = (
        narrow.where(F.col("_fault").isNull())
        .groupBy("graph_id", "id")
        .agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_uses"))
        .where(F.col("_uses") > 1)
        .drop("_uses")
    )
    repeated = F.col("_fault").isNull() & (F.col("pos") != F.col("_first"))
    duplicate = F.when(repeated, F.concat(F.lit('duplicate id "'), "id", F.lit('"')))
    return narrow.join(reused, ["graph_id", "id"], "left").select(
        "graph_id", "pos", "id", "type", "raw_type", F.coalesce("_fault", duplicate).alias("why")
    )


def clean_nodes(raw_nodes: DataFrame, numbered: DataFrame) -> DataFrame:
    """Clean columns of admitted nodes; DOI and URL survive only on source documents.

    ``numbered`` holds the admitted nodes with their ``ord``. It meets the wide rows on (graph_id, pos), which is
    unique, so the wide rows move at most once and spread evenly.
    """
    on_source = F.col("type") == "SourceDocument"
    return raw_nodes.drop("id", "type").join(numbered, ["graph_id", "pos"]).select(
        "graph_id",
        "pos",
        "ord",
        "id",
        "type",
        strip(F.col("text")).alias("text"),
        none_if_empty(strip(F.col("description"))).alias("description"),
        F.when(on_source, none_if_empty(strip(F.col("doi")))).alias("doi"),
        F.when(on_source, none_if_empty(strip(F.col("url")))).alias("url"),
        none_if_empty(quote(F.col("anchor"))).alias("anchor"),
    )


def distinct_edges(raw_edges: DataFrame) -> DataFrame:
    """First occurrence of each (relation, subject, object), and how many copies were folded.

    A hash aggregate over the position alone; the first copy's anchor is fetched by ``accepted_edges``.
    """
    trimmed = raw_edges.select(
        "graph_id",
        "pos",
        text_or_empty(F.col("relation")).alias("relation"),
        text_or_empty(F.col("subject")).alias("subject"),
        text_or_empty(F.col("object")).alias("object"),
    )
    return (
        trimmed.groupBy("graph_id", "relation", "subject", "object")
        .agg(F.min("pos").alias("pos"), (F.count(F.lit(1)) - 1).alias("copies"))
        .select("graph_id", "pos", "relation", "subject", "object", "copies")
    )


def with_end_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Left-join the classes of both ends as ``subj_type`` and ``obj_type`` (NULL when the id does not resolve)."""
    types = nodes.select("graph_id", "id", "type")
    subjects = types.select("graph_id", F.col("id").alias("subject"), F.col("type").alias("subj_type"))
    objects = types.select("graph_id", F.col("id").alias("object"), F.col("type").alias("obj_type"))
    return edges.join(subjects, ["graph_id", "subject"], "left").join(objects, ["graph_id", "object"], "left")


def with_rule(edges: DataFrame) -> DataFrame:
    """Left-join the relation's rule: ``rel_ord, wants`` and whether the end classes are ``legal``."""
    rules = F.broadcast(relation_rules(edges.sparkSession))
    legal = F.array_contains("subj_classes", F.col("subj_type")) & F.array_contains("obj_classes", F.col("obj_type"))
    return (
        edges.join(rules, F.col("relation") == F.col("rule_relation"), "left")
        .withColumn("legal", F.coalesce(legal, F.lit(False)))
        .drop("subj_classes", "obj_classes")
    )


def judge_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each distinct edge with ``verdict`` (ok, ungrammatical, dangling) and ``why``.

    An unknown relation is reported before unresolved ends, and those before a class mismatch.
    """
    known = F.col("rule_relation").isNotNull()
    resolved = F.col("subj_type").isNotNull() & F.col("obj_type").isNotNull()
    verdict = (
        F.when(~known, "ungrammatical")
        .when(~resolved, "dangling")
        .when(~F.col("legal"), "ungrammatical")
        .otherwise("ok")
    )
    why = (
        F.when(~known, F.concat(F.lit('unknown relation "'), "relation", F.lit('"')))
        .when(~resolved, "endpoint id does not resolve")
        .when(
            ~F.col("legal"),
            wanted_versus_got(F.col("relation"), F.col("wants"), F.col("subj_type"), F.col("obj_type")),
        )
    )
    return (
        with_rule(with_end_types(edges, nodes))
        .withColumns({"verdict": verdict, "why": why})
        .drop("rule_relation", "rel_ord", "wants", "legal")
    )


def mark_folded(raw_edges: DataFrame, judged: DataFrame) -> DataFrame:
    """Verdict of every raw edge: later copies of a triple are ``folded``.

    The join key (graph_id, pos) is unique, so a triple repeated millions of times still spreads evenly.
    """
    return (
        raw_edges.select(
            "graph_id",
            "pos",
            text_or_empty(F.col("relation")).alias("relation"),
            text_or_empty(F.col("subject")).alias("subject"),
            text_or_empty(F.col("object")).alias("object"),
        )
        .join(judged.select("graph_id", "pos", "verdict", "why"), ["graph_id", "pos"], "left")
        .withColumn("verdict", F.coalesce("verdict", F.lit("folded")))
    )


def accepted_edges(judged: DataFrame, raw_edges: DataFrame) -> DataFrame:
    """Legal edges with the cleaned anchor of their first copy; ``ord`` is their order within the graph.

    Anchors meet their edge on (graph_id, pos), which is unique.
    """
    anchors = raw_edges.where(F.col("anchor").isNotNull()).select("graph_id", "pos", "anchor")
    return judged.where(F.col("verdict") == "ok").join(anchors, ["graph_id", "pos"], "left").select(
        "graph_id",
        F.col("pos").alias("ord"),
        "relation",
        "subject",
        "object",
        none_if_empty(quote(F.col("anchor"))).alias("anchor"),
        F.lit(False).alias("consolidated"),
    )


def reject_ledger(raw_nodes: DataFrame, judged_nodes: DataFrame, judged_edges: DataFrame) -> DataFrame:
    """All rejects as ``(graph_id, kind, pos, why, payload)``; kind is node, dangling or ungrammatical."""
    payload = F.struct(
        "id",
        F.col("raw_type").alias("type"),
        text_or_empty(F.col("text")).alias("text"),
        "description",
        "doi",
        "url",
        "anchor",
    )
    refused = judged_nodes.where(F.col("why").isNotNull())
    nodes = (
        raw_nodes.drop("id", "type")
        .join(refused, ["graph_id", "pos"])
        .select(
            "graph_id",
            F.lit("node").alias("kind"),
            "pos",
            "why",
            F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"),
        )
    )
    edges = judged_edges.where(F.col("verdict") != "ok").select(
        "graph_id",
        F.col("verdict").alias("kind"),
        "pos",
        "why",
        F.to_json(F.struct("relation", "subject", "object")).alias("payload"),
    )
    return nodes.unionByName(edges)


def capped_rejects(ledger: DataFrame, limit: int = 8) -> DataFrame:
    """The first ``limit`` rejects per graph and kind, beside the full total.

    The rank filter is pushed below the shuffle as a group limit, and the totals are a separate combined count.
    """
    narrow = ledger.select("graph_id", "kind", "pos", "why")
    ranked = Window.partitionBy("graph_id", "kind").orderBy("pos")
    listed = narrow.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limit)
    totals = narrow.groupBy("graph_id", "kind").agg(F.count(F.lit(1)).alias("total"))
    return listed.join(totals, ["graph_id", "kind"])


def legal_relations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each class pair that edges connect: the relations allowed for it in rule order, and the edge count."""
    pairs = (
        with_end_types(edges, nodes)
        .where(F.col("subj_type").isNotNull() & F.col("obj_type").isNotNull())
        .groupBy("graph_id", "subj_type", "obj_type")
        .agg(F.count(F.lit(1)).alias("n_edges"))
    )
    return pairs.join(relations_by_pair(edges), ["subj_type", "obj_type"], "left")


def relations_by_pair(df: DataFrame) -> DataFrame:
    """``(subj_type, obj_type, first_legal, legal_relations)`` from the ten legal triples; always broadcast."""
    ordered = F.array_sort(F.collect_list(F.struct("rel_ord", "legal_relation")))
    return F.broadcast(
        legal_triples(df.sparkSession)
        .groupBy("subj_type", "obj_type")
        .agg(ordered.alias("_ordered"))
        .select(
            "subj_type",
            "obj_type",
            F.col("_ordered")[0]["legal_relation"].alias("first_legal"),
            F.col("_ordered.legal_relation").alias("legal_relations"),
        )
    )


class Graph:
    """A classified corpus; every table is planned on first use.

    ``nodes`` carry a dense 0-based ``ord`` per graph, from which their ids are minted. Edges only need an order, so
    their ``ord`` is the record position (``numbered_edges`` has the dense one). With ``durable`` the tables that other
    plans read several times (projection, edits, reports) are written to the shared folder once; single-use plans
    stay lazy.
    """

    def __init__(self, raw_nodes: DataFrame, raw_edges: DataFrame, durable: bool = False):
        self.raw_nodes, self.raw_edges, self.durable = raw_nodes, raw_edges, durable

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return settle(df, name) if self.durable else df

    @cached_property
    def admitted(self) -> DataFrame:
        """``(graph_id, pos, id, type)`` of the admitted nodes: enough for every check on edges."""
        return self._keep(admit_nodes(self.raw_nodes), "admitted")

    @cached_property
    def judged_nodes(self) -> DataFrame:
        return judge_nodes(self.raw_nodes)

    @cached_property
    def nodes(self) -> DataFrame:
        numbered = number_rows(self.admitted, ["graph_id"], "pos", "ord")
        return self._keep(clean_nodes(self.raw_nodes, numbered), "nodes")

    @cached_property
    def judged_edges(self) -> DataFrame:
        return self._keep(judge_edges(distinct_edges(self.raw_edges), self.admitted), "judged-edges")

    @cached_property
    def edges(self) -> DataFrame:
        return self._keep(accepted_edges(self.judged_edges, self.raw_edges), "accepted-edges")

    @cached_property
    def numbered_edges(self) -> DataFrame:
        return number_rows(self.edges.withColumnRenamed("ord", "pos"), ["graph_id"], "pos", "ord")

    @cached_property
    def rejects(self) -> DataFrame:
        return reject_ledger(self.raw_nodes, self.judged_nodes, self.judged_edges)


def classify(raw_nodes: DataFrame, raw_edges: DataFrame, durable: bool = False) -> Graph:
    """Classify the raw records of every graph in the corpus."""
    return Graph(raw_nodes, raw_edges, durable)
