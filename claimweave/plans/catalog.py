"""Named queries over the driver tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.operators import analytics, anchors, attempts, chunking, classify, conform, consolidate, edits, merge
from claimweave.operators import project, replies, report, requests, routing
from claimweave.plans.build import Merged, MergedStage, Projection, built, merged, projection_of
from claimweave.session import configure, settle
from claimweave.sources import fixtures, papers
from claimweave.streaming import deltas, incremental, runs

#: Parameters of the queries that differ from production, so that the small tables reach every branch.
ROUTE_LIMIT = 10_000
CHUNK_BUDGET = 2_000
MERGE_LIMIT = 34
READ_BACK_BYTES = 20_000
IDLE = 12 * 3600
PROGRESS = 24 * 3600
STAMP = "2026-01-01T00:00:00.000Z"
NAMING = project.Naming(generated_at=STAMP)
EDITOR_NAMING = project.Naming(generated_at=STAMP, creator="discourse-review")
PUBLISHED_CONTEXT = NAMING.context_iri
LOCAL_CONTEXT = "file:context.jsonld"

Query = Callable[[SparkSession, str], DataFrame]


class Corpus:
    """Inputs and shared stages of the queries over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir

    def view(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)

    @cached_property
    def lazy_graph(self) -> classify.Graph:
        return classify.classify(self.view("raw_nodes"), self.view("raw_edges"))

    @cached_property
    def graph(self) -> classify.Graph:
        return classify.classify(self.view("raw_nodes"), self.view("raw_edges"), durable=True)

    @cached_property
    def papers(self) -> DataFrame:
        author = lambda name, orcid: F.struct(F.col(name).alias("name"), orcid.cast("string").alias("orcid"))
        listed = F.filter(
            F.array(author("author_1", F.col("orcid_1")), author("author_2", F.lit(None))), lambda a: a["name"].isNotNull()
        )
        return self.view("paper_info").select("graph_id", "title", "doi", "license", listed.alias("authors"))

    @cached_property
    def projection(self) -> Projection:
        return projection_of(self.graph, self.papers, NAMING, durable=True)

    @cached_property
    def lazy_projection(self) -> Projection:
        """Projection tables that are read once, over the written graph."""
        return projection_of(self.graph, self.papers, NAMING)

    @cached_property
    def edit_log(self) -> DataFrame:
        """The edit rows with their patch as a map; a key is present only for a field the edit touches."""
        touched = [
            ("text", F.col("new_text"), F.col("new_text").isNotNull()),
            ("type", F.col("new_type"), F.col("new_type").isNotNull()),
            ("description", F.lit(None).cast("string"), F.col("clears_description") == 1),
            ("relation", F.col("new_relation"), F.col("new_relation").isNotNull()),
            ("subject", F.col("new_subject"), F.col("new_subject").isNotNull()),
            ("object", F.col("new_object"), F.col("new_object").isNotNull()),
            ("title", F.col("new_title"), F.col("new_title").isNotNull()),
            ("authors", F.to_json(F.array(F.struct(F.col("new_author").alias("name")))), F.col("new_author").isNotNull()),
        ]
        entries = F.array(
            *[F.struct(is_set.alias("set"), F.lit(key).alias("key"), value.alias("value")) for key, value, is_set in touched]
        )
        patch = F.map_from_entries(
            F.transform(F.filter(entries, lambda e: e["set"]), lambda e: F.struct(e["key"], e["value"]))
        )
        return self.view("edits").select("graph_id", "seq", "ts", "op", "target_id", patch.alias("patch"))

    @cached_property
    def edited(self) -> tuple[DataFrame, DataFrame]:
        nodes, edges = edits.edited_graph(self.graph, self.edit_log)
        return settle(nodes, "edited-nodes"), settle(edges, "edited-edges")

    @cached_property
    def merged(self) -> Merged:
        return merged(self.graph)

    @cached_property
    def merged_stage(self) -> MergedStage:
        return MergedStage(self.graph, self.merged, self.edit_log)

    @cached_property
    def edited_status(self) -> DataFrame:
        return edits.edge_status(*self.edited)

    @cached_property
    def calls(self) -> DataFrame:
        return attempts.resolved(self.view("attempts"))

    @cached_property
    def merge_groups(self) -> DataFrame:
        return self.view("merges").select("graph_id", "group_no", F.array("id_a", "id_b").alias("ids"))

    @cached_property
    def consolidated(self) -> dict[str, DataFrame]:
        return consolidate.consolidate(self.graph.nodes, self.graph.edges, self.merge_groups, self.view("proposed"))

    @cached_property
    def pieces(self) -> tuple[DataFrame, DataFrame]:
        graph = classify.classify(self.view("piece_nodes"), self.view("piece_edges"), durable=True)
        part = F.split("graph_id", "#")
        nodes, edges = merge.joined_pieces(graph.nodes, graph.edges, part[0], part[1].cast("bigint"))
        return settle(nodes, "joined-nodes"), edges


_REGISTRY: dict[str, Callable[[Corpus], DataFrame]] = {}


def query(build: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    _REGISTRY[build.__name__] = build
    return build


def queries() -> dict[str, Query]:
    def bind(build: Callable[[Corpus], DataFrame]) -> Query:
        return lambda spark, sf_dir: build(Corpus(spark, sf_dir))

    return {name: bind(build) for name, build in _REGISTRY.items()}


# ---- papers: routing and pieces ----


@query
def input_types(c: Corpus) -> DataFrame:
    gated = routing.gate_types(c.view("paper_rows"))
    slug = routing.run_slug(F.lit(None).cast("string"), F.col("name"), F.lit(None).cast("string"))
    return gated.select("paper_id", "name", "ext", "accepted", "web_accepted", "refusal", slug.alias("slug"))


@query
def run_names(c: Corpus) -> DataFrame:
    """Names and base addresses of runs: by an option, a file, or the title that the paper gives."""
    graphs = c.lazy_graph.nodes.select("graph_id").distinct()
    numbered = F.substring("graph_id", 4, 9)
    option = F.when(numbered.startswith("1"), F.concat(F.lit("Run of "), "graph_id"))
    file = F.when(numbered.startswith("2"), F.concat(F.lit("in/"), "graph_id", F.lit(".v1.txt")))
    runs_ = graphs.select("graph_id", option.alias("option"), file.alias("file"))
    return routing.run_names(runs_, c.papers).withColumn("base_iri", project.base_iri(NAMING, F.col("name")))


@query
def route_papers(c: Corpus) -> DataFrame:
    return routing.route(c.view("paper_rows"), ROUTE_LIMIT).select("paper_id", "chars", "route", "reason")


@query
def quarantine(c: Corpus) -> DataFrame:
    routed = routing.route(c.view("paper_rows"), ROUTE_LIMIT)
    contact = F.concat(F.lit("  reader "), F.col("paper_id").cast("string"), F.lit(" "))
    return routing.quarantine(routed, F.lit(STAMP), contact)


@query
def text_echo(c: Corpus) -> DataFrame:
    return c.view("paper_rows").select("paper_id", routing.echo(F.col("text")).alias("echo"))


@query
def sections(c: Corpus) -> DataFrame:
    rows = chunking.section_rows(c.view("marked_up"))
    return rows.withColumn("section_no", F.col("section_no").cast("bigint"))


@query
def chunks(c: Corpus) -> DataFrame:
    pieces = chunking.chunked(c.view("marked_up"), budget=CHUNK_BUDGET)
    return pieces.select(
        "paper_id", "title", F.col("index").cast("bigint").alias("index"), "text",
        F.array_join("sections", " | ").alias("sections"),
    )


@query
def chunk_coverage(c: Corpus) -> DataFrame:
    """Text characters per paper beside its pieces; a paper with text and no piece shows as uncovered."""
    papers_in = c.view("marked_up")
    pieces = chunking.chunked(papers_in, budget=CHUNK_BUDGET)
    counts = pieces.groupBy("paper_id").agg(F.count(F.lit(1)).alias("pieces"))
    missing = chunking.uncovered(papers_in, pieces).select("paper_id", F.lit(True).alias("uncovered"))
    return (
        papers_in.select("paper_id", F.length("text").cast("bigint").alias("chars"))
        .join(counts, "paper_id", "left")
        .join(missing, "paper_id", "left")
        .select("paper_id", "chars", F.coalesce("pieces", F.lit(0)).alias("pieces"),
                F.coalesce("uncovered", F.lit(False)).alias("uncovered"))
    )


# ---- requests and attempts ----


@query
def extraction_requests(c: Corpus) -> DataFrame:
    accepted = routing.route(c.view("paper_rows"), ROUTE_LIMIT).where(F.col("route") == "accepted")
    return requests.extraction_requests(accepted).select("paper_id", "system_message", "user_message")


@query
def consolidation_eligibility(c: Corpus) -> DataFrame:
    return requests.consolidation_eligibility(c.lazy_graph.admitted, MERGE_LIMIT)


@query
def consolidation_requests(c: Corpus) -> DataFrame:
    return requests.consolidation_requests(c.graph.nodes, c.graph.edges)


@query
def outcomes(c: Corpus) -> DataFrame:
    return attempts.outcome_counts(attempts.with_outcome(c.view("attempts")))


@query
def attempt_outcomes(c: Corpus) -> DataFrame:
    return attempts.with_outcome(c.view("attempts")).select("graph_id", "attempt", "status", "outcome", "retry")


@query
def attempt_winners(c: Corpus) -> DataFrame:
    return attempts.winners(c.calls).select("graph_id", "attempt", "parse")


@query
def models_first_use(c: Corpus) -> DataFrame:
    return attempts.models_by_first_use(c.calls)


@query
def cost_receipt(c: Corpus) -> DataFrame:
    return attempts.cost_receipts(c.calls)


@query
def failure_ledger(c: Corpus) -> DataFrame:
    return attempts.failures(c.view("attempts"), c.calls)


# ---- replies ----


@query
def parse_status(c: Corpus) -> DataFrame:
    return replies.parse_graphs(c.view("attempts")).select("graph_id", "attempt", "parse")


def _parsed(c: Corpus) -> DataFrame:
    """Every reply on its own: the call is the graph."""
    call = F.concat_ws("/", "graph_id", F.col("attempt").cast("string"))
    return replies.parse_graphs(c.view("attempts").withColumn("graph_id", call))


@query
def reply_nodes(c: Corpus) -> DataFrame:
    nodes = replies.raw_nodes(_parsed(c))
    narrowed = {name: text.text_or_empty(F.col(name)) for name in ("id", "type", "text")}
    return nodes.withColumns(narrowed).select("graph_id", "pos", "id", "type", "text")


@query
def reply_edges(c: Corpus) -> DataFrame:
    return replies.raw_edges(_parsed(c)).select("graph_id", "pos", "relation", "subject", "object")


@query
def authors_clean(c: Corpus) -> DataFrame:
    info = replies.paper_info(_parsed(c))
    people = F.array_join(
        F.transform("authors", lambda a: F.concat(a["name"], F.lit(" <"), F.coalesce(a["orcid"], F.lit("")), F.lit(">"))), "; "
    )
    return info.select("graph_id", "title", "doi", "license", people.alias("authors"))


@query
def verdict_status(c: Corpus) -> DataFrame:
    parsed = replies.parse_verdicts(c.view("verdict_replies"))
    keyed = parsed.withColumn("graph_id", F.concat_ws("/", "graph_id", F.col("pos").cast("string"))).drop("pos")
    groups = replies.merge_groups(keyed).groupBy("graph_id").agg(F.count(F.lit(1)).alias("merges"))
    ends = F.concat_ws(" ", "relation", "subject", "object")
    proposals = replies.proposed_edges(keyed).groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), F.max(ends).alias("last_edge"))
    return (
        keyed.select("graph_id", "parse")
        .join(groups, "graph_id", "left")
        .join(proposals, "graph_id", "left")
        .select("graph_id", "parse", F.coalesce("merges", F.lit(0)).alias("merges"), F.coalesce("edges", F.lit(0)).alias("edges"), "last_edge")
    )


@query
def reply_verdicts(c: Corpus) -> DataFrame:
    """Replies through the whole front: winning attempt, parsed records, classification."""
    won = attempts.winners(c.calls).select("graph_id", "parsed")
    graph = classify.classify(replies.raw_nodes(won), replies.raw_edges(won))
    return graph.judged_nodes.select("graph_id", "pos", "id", "type", "why")


# ---- classification ----


@query
def node_verdicts(c: Corpus) -> DataFrame:
    return c.lazy_graph.judged_nodes.select(
        "graph_id", "pos", "id", "type", F.coalesce("why", F.lit("ok")).alias("verdict")
    )


@query
def clean_nodes(c: Corpus) -> DataFrame:
    return c.lazy_graph.nodes.select(
        "graph_id", "ord", "id", "type", "text", "description", "doi", "url", "anchor"
    )


@query
def clean_anchors(c: Corpus) -> DataFrame:
    raw = c.view("raw_nodes")
    return raw.select("graph_id", "pos", text.quote(F.col("anchor")).alias("anchor"))


@query
def edge_verdicts(c: Corpus) -> DataFrame:
    judged = c.lazy_graph.judged_edges
    return classify.mark_folded(c.view("raw_edges"), judged).select(
        "graph_id", "pos", "relation", "subject", "object", "verdict", "why"
    )


@query
def verdict_counts(c: Corpus) -> DataFrame:
    """Admitted, rejected and folded records per graph; the counts add up to the raw rows."""
    judged_nodes, judged_edges = c.lazy_graph.judged_nodes, c.lazy_graph.judged_edges
    nodes = judged_nodes.select(
        "graph_id", F.when(F.col("why").isNull(), "node ok").otherwise("node rejected").alias("verdict"), F.lit(1).alias("n")
    )
    edges = judged_edges.select("graph_id", F.concat(F.lit("edge "), "verdict").alias("verdict"), F.lit(1).alias("n"))
    folded = judged_edges.where(F.col("copies") > 0).select("graph_id", F.lit("edge folded").alias("verdict"), F.col("copies").alias("n"))
    return nodes.unionByName(edges).unionByName(folded).groupBy("graph_id", "verdict").agg(F.sum("n").alias("n"))


@query
def clean_edges(c: Corpus) -> DataFrame:
    return c.lazy_graph.numbered_edges.select("graph_id", "ord", "relation", "subject", "object", "anchor")


@query
def reject_ledger(c: Corpus) -> DataFrame:
    return c.lazy_graph.rejects


@query
def reject_top8(c: Corpus) -> DataFrame:
    listed = classify.capped_rejects(c.lazy_graph.rejects)
    return listed.select("graph_id", "kind", F.col("rank").cast("bigint").alias("rank"), "pos", "why", "total")


@query
def legal_relations(c: Corpus) -> DataFrame:
    ends = c.lazy_graph.admitted
    pairs = classify.legal_relations(classify.distinct_edges(c.view("raw_edges")), ends)
    legal = F.coalesce(F.array_join("legal_relations", ","), F.lit(""))
    return pairs.select("graph_id", "subj_type", "obj_type", "n_edges", legal.alias("legal"))


# ---- merging and consolidation ----


@query
def joined_nodes(c: Corpus) -> DataFrame:
    nodes, _ = c.pieces
    return nodes.select("graph_id", "piece", "ord", "id", "type", "text")


@query
def joined_edges(c: Corpus) -> DataFrame:
    _, edges = c.pieces
    return edges.select("graph_id", "piece", "ord", "relation", "subject", "object", "anchor")


@query
def merge_exact(c: Corpus) -> DataFrame:
    nodes, _, _ = merge.fold_exact(*c.pieces)
    return nodes.select("graph_id", "id", "type", "description", "anchor")


@query
def merge_edges(c: Corpus) -> DataFrame:
    _, edges, _ = merge.fold_exact(*c.pieces)
    return edges.select("graph_id", "ord", "relation", "subject", "object", "anchor")


@query
def merge_stats(c: Corpus) -> DataFrame:
    nodes, edges = c.pieces
    return merge.collapsed_counts(nodes, merge.text_folds(nodes))


@query
def piece_lineage(c: Corpus) -> DataFrame:
    """From which pieces the records of each merged record come."""
    nodes, _ = c.pieces
    return merge.piece_lineage(nodes, merge.text_folds(nodes))


@query
def merge_groups(c: Corpus) -> DataFrame:
    applied = consolidate.applied_groups(c.merge_groups, c.graph.nodes).select("graph_id", "group_no").distinct()
    return c.merge_groups.join(applied.withColumn("applied", F.lit(True)), ["graph_id", "group_no"], "left").select(
        "graph_id", "group_no", F.coalesce("applied", F.lit(False)).alias("applied")
    )


@query
def fold_survivors(c: Corpus) -> DataFrame:
    return c.consolidated["nodes"].select("graph_id", "ord", "id", "type", "description", "anchor")


@query
def repointed_edges(c: Corpus) -> DataFrame:
    return c.consolidated["kept_edges"].select("graph_id", "ord", "relation", "subject", "object", "anchor")


@query
def proposed_edges(c: Corpus) -> DataFrame:
    return c.consolidated["proposals"]


@query
def consolidated_edges(c: Corpus) -> DataFrame:
    return c.consolidated["edges"].select("graph_id", "ord", "relation", "subject", "object", "anchor", "consolidated")


@query
def consolidation_stats(c: Corpus) -> DataFrame:
    return c.consolidated["stats"]


# ---- anchors ----


def _checked(c: Corpus) -> DataFrame:
    """Node quotes against the document each record was read from."""
    quotes = c.lazy_graph.nodes.select("graph_id", F.col("pos").alias("paper_id"), "pos", "id", "anchor")
    texts = fixtures.read_table(c.spark, c.sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    return anchors.check_anchors(quotes, texts)


@query
def anchor_match(c: Corpus) -> DataFrame:
    return _checked(c).select("graph_id", "pos", "id", "anchor", "match")


@query
def anchor_coverage(c: Corpus) -> DataFrame:
    return anchors.anchor_coverage(c.lazy_graph.nodes, c.lazy_graph.edges)


@query
def anchors_verified(c: Corpus) -> DataFrame:
    return anchors.verified_anchors(_checked(c).withColumn("dropped", F.lit(False)))


@query
def anchor_worklist(c: Corpus) -> DataFrame:
    return anchors.anchor_worklist(_checked(c)).select("graph_id", "pos", "id", "anchor")


# ---- projection ----


@query
def slugs(c: Corpus) -> DataFrame:
    name = F.col("name")
    return c.view("paper_rows").select(
        "paper_id",
        text.slug(name).alias("slug"),
        text.editor_slug(name).alias("editor_slug"),
        text.slug(text.editor_slug(name)).alias("exported_slug"),
        project.base_iri(NAMING, name).alias("base_iri"),
    )


@query
def accounts(c: Corpus) -> DataFrame:
    return project.accounts(c.lazy_graph.admitted.select("graph_id").distinct(), c.papers, NAMING)


@query
def node_iris(c: Corpus) -> DataFrame:
    return project.minted_nodes(c.lazy_graph.nodes).select("graph_id", "ord", "id", "iri")


@query
def source_index(c: Corpus) -> DataFrame:
    return project.source_index(project.minted_nodes(c.lazy_graph.nodes))


@query
def paper_document(c: Corpus) -> DataFrame:
    return c.lazy_projection.paper_docs


@query
def spine(c: Corpus) -> DataFrame:
    return project.spines(c.lazy_graph.edges).select("graph_id", "evidence", "study", "source")


@query
def evidence_stamps(c: Corpus) -> DataFrame:
    return c.lazy_projection.stamps.select("graph_id", "ord", "id", "source_document", "stamp")


@query
def node_objects(c: Corpus) -> DataFrame:
    return c.lazy_projection.node_objects.select(
        "graph_id", "ord", "iri", "type", "title", "content", F.array_join("creators", ",").alias("creators"), "item",
        "source_document",
    )


@query
def relation_objects(c: Corpus) -> DataFrame:
    return c.lazy_projection.relation_objects.select(
        "graph_id", "r", "iri", "relation", "source", "destination", "title", "item"
    )


@query
def anchor_items(c: Corpus) -> DataFrame:
    p = c.lazy_projection
    return project.anchor_items(p.node_objects, p.relation_objects).select("graph_id", "ord", "item", "content")


@query
def definitions(c: Corpus) -> DataFrame:
    p = c.lazy_projection
    return project.definitions(p.nodes, p.relation_objects).select("graph_id", "ord", "iri", "name")


@query
def projection_report(c: Corpus) -> DataFrame:
    return c.projection.report


@query
def omission_notes(c: Corpus) -> DataFrame:
    p = c.lazy_projection
    return project.omission_notes(c.papers, p.stamps, p.paper_docs)


@query
def linked_objects(c: Corpus) -> DataFrame:
    """Objects by id, with the size of each object's canonical text left to ``documents``."""
    return c.projection.objects.groupBy("graph_id", "section").agg(
        F.count(F.lit(1)).alias("objects"), F.min("obj_id").alias("first_id"), F.max("obj_id").alias("last_id")
    ).withColumn("section", F.col("section").cast("bigint"))


@query
def documents(c: Corpus) -> DataFrame:
    return c.projection.documents()


@query
def build_documents(c: Corpus) -> DataFrame:
    """Documents of the main build: records renumbered, equal ones folded, then projected."""
    return built(c.graph, c.papers, NAMING).documents()


# ---- conformance ----


def _triples(c: Corpus) -> conform.Triples:
    """Triples of the emitted objects and of some from elsewhere that break rules."""
    emitted = c.projection.object_rows.unionByName(c.view("foreign_objects"), allowMissingColumns=True)
    return conform.triples_of(emitted.select("graph_id", F.try_parse_json("obj_json").alias("obj")))


@query
def triple_counts(c: Corpus) -> DataFrame:
    return _triples(c).rows.groupBy("graph_id", "p").agg(F.count(F.lit(1)).alias("n"))


@query
def violations(c: Corpus) -> DataFrame:
    judged = conform.partition_quirks(conform.violations(_triples(c)))
    return judged.groupBy("graph_id", "component", "path", "known").agg(F.count(F.lit(1)).alias("n"))


@query
def violations_top20(c: Corpus) -> DataFrame:
    """The first twenty real violations per graph."""
    rows = _triples(c)
    shown = conform.shown_violations(conform.partition_quirks(conform.violations(rows)), rows)
    return shown.select("graph_id", F.col("rank").cast("bigint").alias("rank"), "component", "path", "focus", "value")


@query
def conformance(c: Corpus) -> DataFrame:
    rows = _triples(c)
    return conform.conformance(rows, conform.partition_quirks(conform.violations(rows)))


@query
def documents_read_back(c: Corpus) -> DataFrame:
    """Documents in parts read back: the objects' ids and classes, with the context address swapped for a local copy."""
    objects, contexts = conform.read_parts(c.projection.documents(part_bytes=READ_BACK_BYTES), PUBLISHED_CONTEXT, LOCAL_CONTEXT)
    named = objects.select("graph_id", F.variant_get("obj", '$["@id"]', "string").alias("obj_id"), F.variant_get("obj", "$.title", "string").alias("title"))
    return named.join(contexts, "graph_id")


# ---- review edits ----


@query
def staged_edges(c: Corpus) -> DataFrame:
    return edits.staged_edges(c.graph).select("graph_id", "ord", "id", "relation", "subject", "object", "anchor")


@query
def edited_nodes(c: Corpus) -> DataFrame:
    nodes, _ = c.edited
    return nodes.select("graph_id", "id", "type", "text", "description", "dropped", "added")


@query
def edited_edges(c: Corpus) -> DataFrame:
    _, edges = c.edited
    return edges.select("graph_id", "id", "relation", "subject", "object", "dropped", "added")


@query
def edited_papers(c: Corpus) -> DataFrame:
    people = F.array_join(F.col("authors")["name"], "; ").alias("authors")
    return edits.edited_papers(c.papers, c.edit_log).select("graph_id", "title", "doi", "license", people)


@query
def edge_status(c: Corpus) -> DataFrame:
    return c.edited_status.select("graph_id", "id", "relation", "subject", "object", "valid", "reason")


@query
def publishable(c: Corpus) -> DataFrame:
    return edits.publishable(c.edited[0], c.edited_status)


@query
def export_nodes(c: Corpus) -> DataFrame:
    nodes, _ = edits.export_selection(c.edited[0], c.edited_status)
    return nodes.select("graph_id", "ord", "id", "type", "text", "description", "doi", "url", "anchor")


@query
def export_edges(c: Corpus) -> DataFrame:
    _, edges = edits.export_selection(c.edited[0], c.edited_status)
    return edges.select("graph_id", "ord", "relation", "subject", "object", "anchor")


@query
def edited_documents(c: Corpus) -> DataFrame:
    """Documents of the reviewed graph, with the edited attribution and the editor as their creator."""
    nodes, edges = edits.export_selection(c.edited[0], c.edited_status)
    attribution = edits.edited_papers(c.papers, c.edit_log)
    return Projection(settle(nodes, "export-nodes"), settle(edges, "export-edges"), attribution, EDITOR_NAMING, durable=True).documents()


@query
def connect(c: Corpus) -> DataFrame:
    drawn = c.view("raw_edges").select("graph_id", F.col("pos").alias("seq"), "subject", "object")
    return edits.connect(drawn, c.lazy_graph.admitted)


@query
def repair_choices(c: Corpus) -> DataFrame:
    nodes, edges = c.edited
    return edits.repair_choices(edges, nodes).select("graph_id", "id", "relation", F.array_join("choices", ",").alias("choices"))


@query
def incident_edges(c: Corpus) -> DataFrame:
    return edits.incident_edges(*c.edited).select("graph_id", "id", "edge_id", "relation", "direction", "other", "other_text")


@query
def rail_summary(c: Corpus) -> DataFrame:
    folds = c.merged.folds.unionByName(c.consolidated["folds"])
    return edits.rail_summary(*c.edited, c.edited_status, folds, c.graph.rejects, c.consolidated["proposals"])


@query
def merged_edited_nodes(c: Corpus) -> DataFrame:
    """The review edits replayed on the merged graph: an edit of a folded record changes the one it was folded into."""
    nodes, _ = c.merged_stage.edited
    return nodes.select("graph_id", "id", "type", "text", "description", "dropped", "added")


@query
def merged_edited_edges(c: Corpus) -> DataFrame:
    _, edges = c.merged_stage.edited
    return edges.select("graph_id", "id", "relation", "subject", "object", "dropped", "added")


# ---- graph facts ----


def _drawable(c: Corpus) -> tuple[DataFrame, DataFrame]:
    nodes, _ = c.edited
    live = nodes.where(~F.col("dropped"))
    return live, analytics.drawable_edges(nodes, c.edited_status)


@query
def drawable_edges(c: Corpus) -> DataFrame:
    return _drawable(c)[1].select("graph_id", "id", "subject", "object")


@query
def degrees(c: Corpus) -> DataFrame:
    return analytics.degrees(*_drawable(c))


@query
def components(c: Corpus) -> DataFrame:
    return analytics.component_labels(c.graph.nodes, c.graph.edges).select("graph_id", "id", "component")


@query
def drawable_components(c: Corpus) -> DataFrame:
    """Connected parts of the reviewed graphs, over the edges that can be drawn."""
    nodes, edges = _drawable(c)
    return analytics.component_labels(settle(nodes, "live-nodes"), edges).select("graph_id", "id", "component")


@query
def corpus_components(c: Corpus) -> DataFrame:
    """Graphs connected through the sources they share: their own source records and the works they cite."""
    own = project.minted_nodes(c.graph.nodes).where((F.col("type") == "SourceDocument") & ~F.col("iri").startswith("x:"))
    return analytics.corpus_components(c.graph.nodes, own.select("graph_id", "iri").unionByName(c.view("cited_works")))


@query
def component_sizes(c: Corpus) -> DataFrame:
    return analytics.component_sizes(analytics.component_labels(c.graph.nodes, c.graph.edges))


@query
def structure_signature(c: Corpus) -> DataFrame:
    return analytics.structure_signatures(*_drawable(c))


@query
def structure_changes(c: Corpus) -> DataFrame:
    """Graphs whose structure the review edits changed."""
    before = analytics.structure_signatures(c.graph.nodes, c.graph.edges)
    return analytics.changed_structures(before, analytics.structure_signatures(*_drawable(c)))


@query
def orphans(c: Corpus) -> DataFrame:
    return analytics.orphans(c.lazy_graph.admitted, c.lazy_graph.edges)


# ---- reports ----


def _report(c: Corpus) -> DataFrame:
    return report.run_report(
        c.graph.nodes, c.graph.edges, c.lazy_projection.stamps, c.graph.rejects, c.graph.judged_edges
    )


@query
def run_report(c: Corpus) -> DataFrame:
    return _report(c)


@query
def corpus_totals(c: Corpus) -> DataFrame:
    source = F.split("graph_id", "-")[0]
    return report.corpus_totals(_report(c), source)


@query
def reply_report(c: Corpus) -> DataFrame:
    """The run report of the reply log: what each requested paper gave and cost."""
    # Several tables read the resolved calls, so replies are parsed once.
    calls = settle(c.calls, "calls")
    won = attempts.winners(calls).select("graph_id", "parsed")
    graph = classify.classify(replies.raw_nodes(won), replies.raw_edges(won))
    return report.run_summary(
        c.view("attempts"), graph.judged_nodes, attempts.cost_receipts(calls), attempts.models_by_first_use(calls),
        attempts.failures(c.view("attempts"), calls), replies.paper_info(won),
    )


@query
def paper_report(c: Corpus) -> DataFrame:
    """Everything about each requested paper of the reply log in one row."""
    calls = settle(c.calls, "calls")
    won = settle(attempts.winners(calls).select("graph_id", "parsed"), "won-replies")
    graph = classify.classify(replies.raw_nodes(won), replies.raw_edges(won), durable=True)
    papers_ = settle(replies.paper_info(won), "reply-papers")
    shown = projection_of(graph, papers_, NAMING)
    counted = report.measured(graph.nodes, graph.edges, shown.stamps, graph.rejects, graph.judged_edges)
    return report.paper_report(
        c.view("attempts"), counted, papers_, project.omission_notes(papers_, shown.stamps, shown.paper_docs),
        attempts.cost_receipts(calls), attempts.models_by_first_use(calls), attempts.failures(c.view("attempts"), calls),
    )


@query
def piece_failures(c: Corpus) -> DataFrame:
    """Failures by paper and piece; here the letter of a call's graph stands for the paper and its number for the piece."""
    failures = attempts.failures(c.view("attempts"), c.calls)
    return report.piece_failures(failures, F.substring("graph_id", 1, 1), F.substring("graph_id", 2, 20))


@query
def working_graphs(c: Corpus) -> DataFrame:
    """The working-graph artifact: every part of every graph, row by row."""
    return papers.working_graph_rows(papers.working_graph_parts(c.graph, c.papers, _report(c)))


# ---- streams, as batch ----


@query
def stream_lines(c: Corpus) -> DataFrame:
    return deltas.decode_lines(c.view("stream_lines"))


@query
def generation_facts(c: Corpus) -> DataFrame:
    return deltas.generation_facts(deltas.decode_lines(c.view("stream_lines")))


@query
def reassembled(c: Corpus) -> DataFrame:
    return deltas.reassembled(c.view("deltas"))


@query
def idle_stalls(c: Corpus) -> DataFrame:
    return deltas.idle_stalls(c.view("deltas"), c.view("generation_calls"), IDLE)


@query
def progress_stalls(c: Corpus) -> DataFrame:
    return deltas.progress_stalls(c.view("deltas"), c.view("generation_calls"), PROGRESS)


@query
def stall_reasons(c: Corpus) -> DataFrame:
    return deltas.stall_reasons(c.view("deltas"), c.view("generation_calls"), IDLE, PROGRESS)


@query
def latest_status(c: Corpus) -> DataFrame:
    return runs.latest_status(runs.run_events(c.view("run_log")))


@query
def run_results(c: Corpus) -> DataFrame:
    return runs.run_results(runs.run_events(c.view("run_log")))


@query
def latest_patches(c: Corpus) -> DataFrame:
    return incremental.latest_patches(c.edit_log)
