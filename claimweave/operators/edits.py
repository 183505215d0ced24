"""Review edits as a log replayed over staged tables.

``edit_log(graph_id, seq, op, target_id, patch MAP<STRING,STRING>)``. A key present in ``patch`` with a NULL value
clears the field. Replay keeps the last value per record and field, combined map-side, so a record edited millions
of times is one row after the first shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.ordering import number_rows
from claimweave.functions.text import none_if_empty, strip
from claimweave.operators.classify import Graph, relations_by_pair, wanted_versus_got, with_end_types, with_rule
from claimweave.session import settle

NODE_FIELDS = ["type", "text", "description", "doi", "url", "anchor"]
EDGE_FIELDS = ["relation", "subject", "object", "anchor"]

_BRANCH = 1 << 40


def staged_nodes(nodes: DataFrame) -> DataFrame:
    """Admitted nodes as editable records."""
    return nodes.select(
        "graph_id", "ord", "id", *NODE_FIELDS, F.lit(False).alias("dropped"), F.lit(False).alias("added")
    )


def refused_edges(graph: Graph) -> DataFrame:
    """``(graph_id, pos, relation, subject, object, verdict)`` of the edges that admission refused."""
    return graph.judged_edges.where(F.col("verdict") != "ok").select("graph_id", "pos", "relation", "subject", "object", "verdict")


def numbered_edges(accepted: DataFrame, refused: DataFrame) -> DataFrame:
    """Accepted, then dangling, then ungrammatical edges as editable records ``x0, x1, …`` per graph.

    ``branch`` and ``pos`` tell where a record comes from: 0 and the edge's ``ord``, or 1 or 2 and the refused edge's ``pos``.
    """
    first = accepted.select("graph_id", F.col("ord").alias("pos"), *EDGE_FIELDS, F.lit(0).alias("branch"))
    rest = refused.select(
        "graph_id",
        "pos",
        "relation",
        "subject",
        "object",
        F.lit(None).cast("string").alias("anchor"),
        F.when(F.col("verdict") == "dangling", 1).otherwise(2).alias("branch"),
    )
    placed = first.unionByName(rest).withColumn(
        "_seq", F.col("branch").cast("bigint") * F.lit(_BRANCH) + F.col("pos")
    )
    return number_rows(placed, ["graph_id"], "_seq", "ord").select(
        "graph_id",
        "ord",
        F.concat(F.lit("x"), F.col("ord").cast("string")).alias("id"),
        *EDGE_FIELDS,
        F.lit(False).alias("dropped"),
        F.lit(False).alias("added"),
        "branch",
        "pos",
    )


def staged_edges(graph: Graph) -> DataFrame:
    """The edges of a classified graph as editable records."""
    return numbered_edges(graph.edges, refused_edges(graph)).drop("branch", "pos")


def renamed(rows: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the ids in ``columns`` mapped by ``ids(graph_id, old_id, id)``.

    An id that names no record stays; one that looks like a record's of the new graph gets a question mark, so that it does
    not come to name one.
    """
    for column in columns:
        known = ids.select("graph_id", F.col("old_id").alias(column), F.col("id").alias("_new"))
        stranger = F.when(F.col(column).rlike(r"^[gn]\d+$"), F.concat(F.lit("?"), column)).otherwise(F.col(column))
        rows = rows.join(known, ["graph_id", column], "left").withColumn(column, F.coalesce("_new", stranger)).drop("_new")
    return rows


def rebased(edit_log: DataFrame, node_ids: DataFrame, edge_ids: DataFrame) -> DataFrame:
    """The log in the names of another staging; both maps are ``(graph_id, old_id, id)``.

    Targets and the ends that patches set are mapped. An edit whose target is not in the map loses it and so changes nothing,
    as before.
    """
    tagged = lambda ids, noun: ids.select("graph_id", F.lit(noun).alias("_noun"), F.col("old_id").alias("target_id"), F.col("id").alias("_target"))
    targets = tagged(node_ids, "Node").unionByName(tagged(edge_ids, "Edge"))
    noun = F.regexp_extract("op", "(Node|Edge)$", 1)
    log = edit_log.withColumn("_noun", noun).join(targets, ["graph_id", "_noun", "target_id"], "left")
    log = log.withColumns({"_subject": F.col("patch")["subject"], "_object": F.col("patch")["object"]})
    log = renamed(log, node_ids, ["_subject", "_object"])
    patch = F.transform_values(
        "patch", lambda key, value: F.when(key == "subject", F.col("_subject")).when(key == "object", F.col("_object")).otherwise(value)
    )
    return log.select("graph_id", "seq", "ts", "op", F.col("_target").alias("target_id"), patch.alias("patch"))


def counter_starts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(graph_id, _start)``: the first number of a graph's new records.

    It comes after the number of staged edges and after the highest number of any record named like a new one (``n7``), so that
    no new id meets a record's.
    """
    named = F.regexp_extract("id", r"^n(\d{1,15})$", 1)
    taken = nodes.where(named != "").select("graph_id", named.cast("bigint").alias("_n"))
    counts = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"))
    return taken.unionByName(counts).groupBy("graph_id").agg((F.max("_n") + 1).alias("_start"))


def added_records(edit_log: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """New nodes and edges with their ids: one counter per graph, from ``counter_starts`` on."""
    return named_adds(numbered_adds(edit_log, "patch"), edges, nodes)


def numbered_adds(edit_log: DataFrame, *carried: str) -> DataFrame:
    """``(graph_id, seq, op)`` of the edits that add a record, and their place ``_k`` among those of the graph."""
    adds = edit_log.where(F.col("op").isin("addNode", "addEdge")).select("graph_id", "seq", "op", *carried)
    return number_rows(settle(adds, "adds"), ["graph_id"], "seq", "_k")


def named_adds(adds: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Numbered new records with their ids in a staging."""
    letter = F.when(F.col("op") == "addNode", "n").otherwise("e")
    counter = F.col("_k") + F.coalesce("_start", F.lit(1))
    named = adds.join(counter_starts(edges, nodes), "graph_id", "left")
    return named.withColumn("id", F.concat(letter, counter.cast("string"))).drop("_k", "_start")


def with_added(staged: DataFrame, adds: DataFrame, op: str, fields: list[str]) -> DataFrame:
    """Staged records followed by the added ones of ``op``; ``born`` is the log position that created them."""
    base = staged.withColumn("born", F.lit(-1).cast("bigint"))
    new = adds.where(F.col("op") == op).select(
        "graph_id",
        (F.col("seq") + F.lit(_BRANCH)).alias("ord"),
        "id",
        *[
            (F.coalesce(F.col("patch")[field], F.lit("")) if field == "text" else F.col("patch")[field]).alias(field)
            for field in fields
        ],
        F.lit(False).alias("dropped"),
        F.lit(True).alias("added"),
        F.col("seq").alias("born"),
    )
    return base.unionByName(new)


def replay(staged: DataFrame, edit_log: DataFrame, noun: str, fields: list[str]) -> DataFrame:
    """Apply ``edit<noun>``, ``drop<noun>`` and ``restore<noun>`` to staged records; the last action per field wins.

    An edit made before its target existed changes nothing, as does one whose target is unknown.
    """
    actions = edit_log.where(F.col("op").isin(f"edit{noun}", f"drop{noun}", f"restore{noun}")).select(
        "graph_id", "seq", "op", F.col("target_id").alias("id"), "patch"
    )
    born = staged.where("added").select("graph_id", "id", "born")
    effective = actions.join(born, ["graph_id", "id"], "left").where(
        F.col("seq") > F.coalesce("born", F.lit(-1))
    )

    def last(value: Column, touched: Column, name: str) -> Column:
        # The struct keeps a NULL value (a cleared field) apart from no value at all.
        return F.max(F.when(touched, F.struct("seq", value.alias("value")))).alias(name)

    edited = F.col("op") == f"edit{noun}"
    picks = [
        last(F.col("patch")[field], edited & F.map_contains_key("patch", field), f"_{field}") for field in fields
    ]
    flagged = F.col("op") != f"edit{noun}"
    latest = effective.groupBy("graph_id", "id").agg(
        *picks, last(F.col("op") == f"drop{noun}", flagged, "_dropped")
    )
    merged = staged.join(latest, ["graph_id", "id"], "left")
    for field in (*fields, "dropped"):
        merged = merged.withColumn(
            field, F.when(F.col(f"_{field}").isNotNull(), F.col(f"_{field}")["value"]).otherwise(F.col(field))
        )
    return merged.drop("born", *[f"_{field}" for field in (*fields, "dropped")])


def edited_graph(graph: Graph, edit_log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of every graph after its edits.

    The staged edges and the added records are numbered tables read several times below, so both are written once.
    """
    return replayed(graph.nodes, settle(staged_edges(graph), "staged-edges"), edit_log)


def replayed(nodes: DataFrame, staged: DataFrame, edit_log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the edits of a log in their names; ``staged`` as from ``staged_edges`` or ``numbered_edges``."""
    edges = staged.drop("branch", "pos")
    adds = settle(added_records(edit_log, edges, nodes), "added-records")
    nodes_now = replay(with_added(staged_nodes(nodes), adds, "addNode", NODE_FIELDS), edit_log, "Node", NODE_FIELDS)
    edges_now = replay(with_added(edges, adds, "addEdge", EDGE_FIELDS), edit_log, "Edge", EDGE_FIELDS)
    return nodes_now, edges_now


def edited_papers(papers: DataFrame, edit_log: DataFrame, fields: tuple[str, ...] = ("title", "doi", "license", "authors")) -> DataFrame:
    """Paper attribution after ``editPaper`` patches; a graph without attribution gains a row.

    A patch of ``authors`` is the whole new list as JSON, objects with ``name`` and ``orcid``; one that is not such a list, or
    NULL, leaves no authors.
    """
    patches = edit_log.where(F.col("op") == "editPaper")
    latest = patches.groupBy("graph_id").agg(
        *[
            F.max(F.when(F.map_contains_key("patch", field), F.struct("seq", F.col("patch")[field].alias("value")))).alias(
                f"_{field}"
            )
            for field in fields
        ]
    )
    merged = papers.join(latest, "graph_id", "full")
    kinds = dict(papers.dtypes)
    for field in fields:
        value = F.col(f"_{field}")["value"]
        if field == "authors":
            value = F.coalesce(F.from_json(value, kinds[field]), F.array().cast(kinds[field]))
        merged = merged.withColumn(field, F.when(F.col(f"_{field}").isNotNull(), value).otherwise(F.col(field)))
    return merged.drop(*[f"_{field}" for field in fields])


def edge_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Status of each kept edge: ``valid`` and ``reason``.

    Unlike admission, missing or dropped ends are reported before an unknown relation.
    """
    live = nodes.where(~F.col("dropped")).select("graph_id", "id", "type")
    ruled = with_rule(with_end_types(edges.where(~F.col("dropped")), live))
    no_subject, no_object = F.col("subj_type").isNull(), F.col("obj_type").isNull()
    reason = (
        F.when(no_subject & no_object, "both ends are gone")
        .when(no_subject, "the subject end is gone")
        .when(no_object, "the object end is gone")
        .when(F.col("rule_relation").isNull(), F.concat(F.lit('unknown relation "'), "relation", F.lit('"')))
        .when(
            ~F.col("legal"),
            wanted_versus_got(F.col("relation"), F.col("wants"), F.col("subj_type"), F.col("obj_type")),
        )
    )
    return ruled.withColumns({"reason": reason, "valid": reason.isNull()}).drop(
        "rule_relation", "rel_ord", "wants", "legal"
    )


def publishable(nodes: DataFrame, status: DataFrame) -> DataFrame:
    """One row per graph: live nodes, nodes needing text, valid edges, and whether the graph may be published."""
    live = ~F.col("dropped")
    blank = live & (F.coalesce(strip(F.col("text")), F.lit("")) == "")
    per_graph = nodes.groupBy("graph_id").agg(
        F.count_if(live).alias("live_nodes"), F.count_if(blank).alias("nodes_needing_text")
    )
    edges = status.groupBy("graph_id").agg(F.count_if("valid").alias("valid_edges"))
    return per_graph.join(edges, "graph_id", "left").select(
        "graph_id",
        "live_nodes",
        "nodes_needing_text",
        F.coalesce("valid_edges", F.lit(0)).alias("valid_edges"),
        ((F.col("live_nodes") > 0) & (F.col("nodes_needing_text") == 0)).alias("publishable"),
    )


def export_selection(nodes: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live nodes with text (fields trimmed) and the valid edges between them, renumbered."""
    trimmed = none_if_empty(strip(F.col("text")))
    on_source = F.col("type") == "SourceDocument"
    kept = nodes.where(~F.col("dropped") & trimmed.isNotNull()).select(
        "graph_id",
        F.col("ord").alias("_ord"),
        "id",
        "type",
        trimmed.alias("text"),
        none_if_empty(strip(F.col("description"))).alias("description"),
        F.when(on_source, none_if_empty(F.col("doi"))).alias("doi"),
        F.when(on_source, none_if_empty(F.col("url"))).alias("url"),
        none_if_empty(strip(F.col("anchor"))).alias("anchor"),
    )
    ids = kept.select("graph_id", "id")
    linked = (
        status.where("valid")
        .join(ids.withColumnRenamed("id", "subject"), ["graph_id", "subject"], "left_semi")
        .join(ids.withColumnRenamed("id", "object"), ["graph_id", "object"], "left_semi")
        .select("graph_id", F.col("ord").alias("_ord"), "relation", "subject", "object", none_if_empty(F.col("anchor")).alias("anchor"))
    )
    return (
        number_rows(kept, ["graph_id"], "_ord", "ord").drop("_ord"),
        number_rows(linked, ["graph_id"], "_ord", "ord").drop("_ord"),
    )


def connect(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Choose the relation for drawn connections ``requests(graph_id, seq, subject, object)``.

    The first legal relation in rule order; otherwise ``notice`` says why there is none. Self-connections and unknown
    ends are ignored.
    """
    drawn = requests.where(F.col("subject") != F.col("object"))
    typed = with_end_types(drawn, nodes).where(F.col("subj_type").isNotNull() & F.col("obj_type").isNotNull())
    notice = F.concat(F.lit("nothing links "), "subj_type", F.lit(" to "), "obj_type")
    return typed.join(relations_by_pair(nodes), ["subj_type", "obj_type"], "left").select(
        "graph_id",
        "seq",
        "subject",
        "object",
        F.col("first_legal").alias("relation"),
        F.when(F.col("first_legal").isNull(), notice).alias("notice"),
    )


def repair_choices(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each edge, the relations legal for its current ends; a current illegal relation is listed first."""
    typed = with_end_types(edges, nodes).join(relations_by_pair(nodes), ["subj_type", "obj_type"], "left")
    legal = F.coalesce("legal_relations", F.array().cast("array<string>"))
    choices = F.when(F.array_contains(legal, F.col("relation")), legal).otherwise(
        F.concat(F.array("relation"), legal)
    )
    return typed.select("graph_id", "id", "relation", "subj_type", "obj_type", choices.alias("choices"))


def incident_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, id, edge_id, direction, other, other_text)`` of every kept edge, seen from each end.

    A self-loop is listed once, as outgoing.
    """
    kept = edges.where(~F.col("dropped"))
    out = kept.select("graph_id", F.col("subject").alias("id"), F.col("id").alias("edge_id"), "relation",
                      F.lit("→").alias("direction"), F.col("object").alias("other"))
    back = kept.where(F.col("subject") != F.col("object")).select(
        "graph_id", F.col("object").alias("id"), F.col("id").alias("edge_id"), "relation",
        F.lit("←").alias("direction"), F.col("subject").alias("other"))
    labels = nodes.select("graph_id", F.col("id").alias("other"), none_if_empty(F.col("text")).alias("_text"),
                          F.lit(True).alias("_known"))
    return (
        out.unionByName(back)
        .join(nodes.select("graph_id", "id"), ["graph_id", "id"], "left_semi")
        .join(labels, ["graph_id", "other"], "left")
        .withColumn("other_text", F.coalesce("_text", F.when(F.col("_known"), F.col("other")), F.lit("?")))
        .drop("_text", "_known")
    )


def rail_summary(
    nodes: DataFrame, edges: DataFrame, status: DataFrame, folds: DataFrame | None = None, rejects: DataFrame | None = None,
    proposed: DataFrame | None = None,
) -> DataFrame:
    """Long-form counts ``(graph_id, item, n)``: live by class, dropped, added and invalid records.

    And what happened before staging, as far as it is given: records folded into others, nodes refused, and relations across
    pieces that consolidation added (``proposed``, with ``accepted``).
    """

    def tally(df: DataFrame, item: Column) -> DataFrame:
        return df.groupBy("graph_id", item.alias("item")).agg(F.count(F.lit(1)).alias("n"))

    earlier = [
        tally(df, F.lit(item))
        for df, item in (
            (folds, "folded records"),
            (None if rejects is None else rejects.where(F.col("kind") == "node"), "refused nodes"),
            (None if proposed is None else proposed.where("accepted"), "relations across pieces"),
        )
        if df is not None
    ]
    now = (
        tally(nodes.where(~F.col("dropped")), F.concat(F.lit("live "), "type"))
        .unionByName(tally(nodes.where("dropped"), F.lit("dropped nodes")))
        .unionByName(tally(nodes.where("added"), F.lit("added nodes")))
        .unionByName(tally(edges.where("dropped"), F.lit("dropped edges")))
        .unionByName(tally(edges.where("added"), F.lit("added edges")))
        .unionByName(tally(status.where(~F.col("valid")), F.lit("invalid edges")))
    )
    return reduce(DataFrame.unionByName, earlier, now)
