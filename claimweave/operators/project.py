"""Projection of a classified graph to linked-data objects and documents.

Names that belong to the published schema (context address, base IRI prefix, agent name) are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.ordering import number_rows
from claimweave.functions.text import clip, comparable, none_if_empty, slug, strip

#: Objects and bytes per document part; larger graphs come as several ordered parts of one document.
OBJECTS_PER_PART = 20_000
BYTES_PER_PART = 16 << 20

ACCOUNTS, CLASS_DEFS, RELATION_DEFS, CONTAINER, NODE_ITEMS, EDGE_ITEMS, NODES, RELATIONS = range(8)


@dataclass(frozen=True)
class Naming:
    """Run-wide values of the projection."""

    generated_at: str
    creator: str = "discourse-extraction"
    context_iri: str = "https://example.org/discourse/context.jsonld"
    base_prefix: str = "urn:discourse-extraction:"
    context_override: str | None = None  # JSON text of an inline context

    @property
    def stamp(self) -> Column:
        return F.lit(self.generated_at)


def base_iri(naming: Naming, name: Column) -> Column:
    return F.concat(F.lit(naming.base_prefix), slug(name), F.lit(":"))


def minted_nodes(nodes: DataFrame) -> DataFrame:
    """Add ``iri``: source documents by DOI, else web address, else local; all others local by position."""
    local = F.concat(F.lit("x:n"), F.col("ord").cast("string"))
    doi = F.coalesce(strip(F.col("doi")), F.lit(""))
    url = F.coalesce(strip(F.col("url")), F.lit(""))
    web = "(?i)^https?://"
    source = (
        F.when((doi != "") & doi.rlike(web), doi)
        .when(doi != "", F.concat(F.lit("https://doi.org/"), F.regexp_replace(doi, "(?i)^doi:", "")))
        .when(url.rlike(web), url)
        .otherwise(local)
    )
    return nodes.withColumn("iri", F.when(F.col("type") == "SourceDocument", source).otherwise(local))


def source_index(minted: DataFrame) -> DataFrame:
    """Cited works across the corpus: how many source records and graphs share an identifier."""
    return (
        minted.where((F.col("type") == "SourceDocument") & ~F.col("iri").startswith("x:"))
        .groupBy("graph_id", "iri")
        .agg(F.count(F.lit(1)).alias("records"))
        .groupBy("iri")
        .agg(F.sum("records").alias("records"), F.count(F.lit(1)).alias("graphs"))
    )


def paper_documents(minted: DataFrame, papers: DataFrame) -> DataFrame:
    """``(graph_id, paper_source, paper_iri, matched_by)``: the source record that stands for the paper itself.

    The first DOI match wins over any title match; both compare trimmed lower case.
    """
    wanted = papers.select(
        "graph_id",
        F.lower(F.coalesce(strip(F.col("doi")), F.lit(""))).alias("_doi"),
        comparable(F.coalesce("title", F.lit(""))).alias("_title"),
    )
    sources = minted.where(F.col("type") == "SourceDocument").join(wanted, "graph_id")
    by_doi = (F.col("_doi") != "") & (F.lower(F.coalesce(strip(F.col("doi")), F.lit(""))) == F.col("_doi"))
    by_title = (F.col("_title") != "") & (comparable(F.col("text")) == F.col("_title"))
    # A title match comes after every DOI match; the best one is fetched by its position.
    after = F.lit(1 << 62)
    placed = sources.where(by_doi | by_title).select("graph_id", "id", "iri", (F.when(by_doi, F.col("ord")).otherwise(F.col("ord") + after)).alias("_place"))
    best = placed.groupBy("graph_id").agg(F.min("_place").alias("_place"))
    return placed.join(best, ["graph_id", "_place"]).select(
        "graph_id",
        F.col("id").alias("paper_source"),
        F.col("iri").alias("paper_iri"),
        F.when(F.col("_place") < after, "doi").otherwise("title").alias("matched_by"),
    )


def first_links(edges: DataFrame, relation: str, source: str, target: str) -> DataFrame:
    """Per object of ``relation``: its first subject by edge order, which is unique within a graph."""
    linked = edges.where(F.col("relation") == relation).select("graph_id", "ord", F.col("subject").alias(source), F.col("object").alias(target))
    first = linked.groupBy("graph_id", target).agg(F.min("ord").alias("ord"))
    return linked.join(first, ["graph_id", target, "ord"]).select("graph_id", target, source)


def spines(edges: DataFrame) -> DataFrame:
    """``(graph_id, evidence, study, source)``: the first study of each grounded evidence and that study's first source."""
    return first_links(edges, "grounds", "study", "evidence").join(
        first_links(edges, "describesActivity", "source", "study"), ["graph_id", "study"], "left"
    )


def evidence_stamps(minted: DataFrame, edges: DataFrame, paper_docs: DataFrame) -> DataFrame:
    """``(graph_id, id, ord, source_document, stamp)`` per evidence; stamp is spine, paper or none."""
    iris = minted.select("graph_id", F.col("id").alias("source"), F.col("iri").alias("_spine_iri"))
    spine = (
        spines(edges)
        .where(F.col("source").isNotNull())
        .join(iris, ["graph_id", "source"])
        .select("graph_id", F.col("evidence").alias("id"), "_spine_iri")
    )
    return (
        minted.where(F.col("type") == "Evidence")
        .select("graph_id", "id", "ord")
        .join(spine, ["graph_id", "id"], "left")
        .join(paper_docs.select("graph_id", "paper_iri"), "graph_id", "left")
        .select(
            "graph_id",
            "id",
            "ord",
            F.coalesce("_spine_iri", "paper_iri").alias("source_document"),
            F.when(F.col("_spine_iri").isNotNull(), "spine")
            .when(F.col("paper_iri").isNotNull(), "paper")
            .otherwise("none")
            .alias("stamp"),
        )
    )


def accounts(graphs: DataFrame, papers: DataFrame, naming: Naming) -> DataFrame:
    """``(graph_id, ord, account_id, account_name)``: the extracting agent, then the paper's authors in list order."""
    agent = graphs.select(
        "graph_id",
        F.lit(0).cast("bigint").alias("ord"),
        F.lit("x:agent").alias("account_id"),
        clip(F.lit(naming.creator), 256).alias("account_name"),
    )
    authors = papers.select("graph_id", F.posexplode("authors").alias("i", "author")).select(
        "graph_id",
        (F.col("i") + 1).cast("bigint").alias("ord"),
        author_id(F.col("author"), F.col("i")).alias("account_id"),
        clip(F.col("author.name"), 256).alias("account_name"),
    )
    return agent.unionByName(authors)


def author_id(author: Column, position: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("https://orcid.org/"), none_if_empty(author["orcid"])),
        F.concat(F.lit("x:author-"), position.cast("string")),
    )


def node_objects(minted: DataFrame, stamps: DataFrame, papers: DataFrame, paper_docs: DataFrame) -> DataFrame:
    """The columns of each node object; ``creators`` lists the printed authors on the paper's own document only."""
    authors = papers.select(
        "graph_id", F.transform("authors", author_id).alias("_authors")
    )
    own = paper_docs.select("graph_id", F.col("paper_source").alias("id")).join(authors, "graph_id", "left")
    named = F.when(F.size("_authors") > 0, F.col("_authors"))
    return (
        minted.join(own, ["graph_id", "id"], "left")
        .join(stamps.select("graph_id", "id", "source_document"), ["graph_id", "id"], "left")
        .select(
            "graph_id",
            "ord",
            "iri",
            "type",
            clip(F.col("text"), 200).alias("title"),
            F.concat_ws("\n\n", "text", "description").alias("content"),
            F.coalesce(named, F.array(F.lit("x:agent"))).alias("creators"),
            F.when(F.col("anchor").isNotNull(), F.concat(F.lit("x:a-n"), F.col("ord").cast("string"))).alias("item"),
            "source_document",
            "anchor",
        )
    )


def relation_objects(edges: DataFrame, minted: DataFrame) -> DataFrame:
    """The columns of each reified relation, numbered over the edges whose two ends have an IRI."""
    ends = minted.select("graph_id", "id", "iri", clip(F.col("text"), 80).alias("snip"))
    subjects = ends.withColumnsRenamed({"id": "subject", "iri": "source", "snip": "_from"})
    objects = ends.withColumnsRenamed({"id": "object", "iri": "destination", "snip": "_to"})
    mapped = edges.join(subjects, ["graph_id", "subject"]).join(objects, ["graph_id", "object"])
    title = F.concat("_from", F.lit(" -"), "relation", F.lit("-> "), "_to")
    return number_rows(mapped, ["graph_id"], "ord", "r").select(
        "graph_id",
        "r",
        F.concat(F.lit("x:r"), F.col("r").cast("string")).alias("iri"),
        "relation",
        "source",
        "destination",
        title.alias("title"),
        F.when(F.col("anchor").isNotNull(), F.concat(F.lit("x:a-r"), F.col("r").cast("string"))).alias("item"),
        "anchor",
    )


def anchor_items(node_objs: DataFrame, relation_objs: DataFrame) -> DataFrame:
    """``(graph_id, section, ord, item, content)`` for every anchored node and relation."""
    of_nodes = node_objs.select("graph_id", F.lit(NODE_ITEMS).alias("section"), "ord", "item", F.col("anchor").alias("content"))
    of_edges = relation_objs.select(
        "graph_id", F.lit(EDGE_ITEMS).alias("section"), F.col("r").alias("ord"), "item", F.col("anchor").alias("content")
    )
    return of_nodes.unionByName(of_edges).where(F.col("item").isNotNull())


def definitions(nodes: DataFrame, relation_objs: DataFrame) -> DataFrame:
    """``(graph_id, section, ord, iri, name)``: one definition per used class and relation, by first use."""
    classes = nodes.groupBy("graph_id", F.col("type").alias("name")).agg(F.min("ord").alias("_first"))
    relations = relation_objs.groupBy("graph_id", F.col("relation").alias("name")).agg(F.min("r").alias("_first"))
    used = classes.withColumns({"section": F.lit(CLASS_DEFS), "_tag": F.lit("x:_schema_")}).unionByName(
        relations.withColumns({"section": F.lit(RELATION_DEFS), "_tag": F.lit("x:_rel_")})
    )
    # At most fifteen rows per graph reach this window.
    order = Window.partitionBy("graph_id", "section").orderBy("_first")
    return used.select(
        "graph_id",
        "section",
        (F.row_number().over(order) - 1).cast("bigint").alias("ord"),
        F.concat("_tag", "name").alias("iri"),
        "name",
    )


def projection_report(
    nodes: DataFrame, edges: DataFrame, node_objs: DataFrame, relation_objs: DataFrame, stamps: DataFrame
) -> DataFrame:
    """Long-form honesty report ``(graph_id, section, item, n)``: totals, by class, by relation, anchors, stamps."""

    def tally(df: DataFrame, section: str, item: Column) -> DataFrame:
        return df.groupBy("graph_id", item.alias("item")).agg(F.count(F.lit(1)).alias("n")).select(
            "graph_id", F.lit(section).alias("section"), "item", "n"
        )

    # Edges with an end that has no IRI have no object; admission leaves none, so the count says that nothing got lost.
    counted = edges.select("graph_id", F.lit(1).alias("n")).unionByName(relation_objs.select("graph_id", F.lit(-1).alias("n")))
    lost = counted.groupBy("graph_id").agg(F.sum("n").alias("n")).select(
        "graph_id", F.lit("edges").alias("section"), F.lit("dropped").alias("item"), "n"
    )
    anchored = F.col("anchor").isNotNull()
    parts = [
        tally(nodes, "nodes", F.lit("total")),
        tally(node_objs, "nodes", F.lit("mapped")),
        tally(node_objs, "class", F.col("type")),
        tally(edges, "edges", F.lit("total")),
        tally(relation_objs, "edges", F.lit("mapped")),
        lost,
        tally(relation_objs, "relation", F.col("relation")),
        tally(node_objs.where(anchored), "anchors", F.lit("nodes")),
        tally(relation_objs.where(anchored), "anchors", F.lit("edges")),
        tally(stamps, "stamps", F.col("stamp")),
    ]
    return reduce(DataFrame.unionByName, parts)


LICENSE_NOTE = "license has no slot in the schema; kept in this report only"
UNSTAMPED_NOTE = "the paper's own source record was not identified, so evidence without a study chain has no source"


def omission_notes(papers: DataFrame, stamps: DataFrame, paper_docs: DataFrame) -> DataFrame:
    """``(graph_id, note, detail)``: a printed license, and evidence left without a source."""
    licensed = papers.where(F.col("license").isNotNull()).select(
        "graph_id", F.lit(LICENSE_NOTE).alias("note"), F.col("license").alias("detail")
    )
    unstamped = (
        stamps.where(F.col("stamp") == "none")
        .groupBy("graph_id")
        .agg(F.count(F.lit(1)).cast("string").alias("detail"))
        .join(paper_docs.select("graph_id"), "graph_id", "left_anti")
        .select("graph_id", F.lit(UNSTAMPED_NOTE).alias("note"), "detail")
    )
    return licensed.unionByName(unstamped)


def linked_objects(
    nodes: DataFrame, papers: DataFrame, node_objs: DataFrame, relation_objs: DataFrame, naming: Naming
) -> DataFrame:
    """Every linked-data object as ``(graph_id, section, ord, obj_id, obj_json)``; absent keys are left out.

    An anchored record and its grounding item come from one row, so each big table is read once.
    """
    stamp, agent = naming.stamp, F.lit("x:agent")

    def obj(section: Column | int, order: str, iri: str, json: Column) -> Column:
        section = section if isinstance(section, Column) else F.lit(section)
        return F.struct(
            section.cast("int").alias("section"), F.col(order).alias("ord"), F.col(iri).alias("obj_id"), json.alias("obj_json")
        )

    def fields(iri: str, **values: Column) -> Column:
        return F.to_json(F.struct(F.col(iri).alias("@id"), *[v.alias(k.replace("type_", "@type")) for k, v in values.items()]))

    def item(section: int, order: str) -> Column:
        return obj(section, order, "item", fields(
            "item", type_=F.lit("Item"), format=F.lit("text/plain"), content=F.col("anchor"), has_container=F.lit("x:doc")
        ))

    def rows(df: DataFrame, *objects: Column) -> DataFrame:
        return df.select("graph_id", F.inline(F.array(*objects)))

    def with_items(df: DataFrame, own: Column, its_item: Column) -> DataFrame:
        both = F.when(F.col("item").isNull(), F.array(own)).otherwise(F.array(own, its_item))
        return df.select("graph_id", F.inline(both))

    account_json = fields("account_id", type_=F.lit("UserAccount"), accountName=F.col("account_name"))
    graphs = nodes.select("graph_id").distinct()
    account_rows = rows(accounts(graphs, papers, naming), obj(ACCOUNTS, "ord", "account_id", account_json))

    definition_json = fields(
        "iri",
        type_=F.when(F.col("section") == CLASS_DEFS, "NodeSchema").otherwise("AbstractRelationDef"),
        subClassOf=F.array("name"), label=F.col("name"), created=stamp, modified=stamp, creator=agent,
    )
    definition_rows = rows(definitions(nodes, relation_objs), obj(F.col("section"), "ord", "iri", definition_json))

    anchored = F.col("anchor").isNotNull()
    container = (
        nodes.where(anchored).select("graph_id")
        .unionByName(relation_objs.where(anchored).select("graph_id"))
        .distinct()
        .select("graph_id", F.lit(0).cast("bigint").alias("ord"), F.lit("x:doc").alias("doc"))
    )
    container_rows = rows(container, obj(CONTAINER, "ord", "doc", fields("doc", type_=F.lit("Container"))))

    # The creator is a list on the paper's own document and a plain id elsewhere, so it is joined in as JSON text.
    head = fields(
        "iri",
        type_=F.array(F.concat(F.lit("x:_schema_"), "type"), "type"),
        title=F.col("title"), content=F.col("content"), created=stamp, modified=stamp,
    )
    creator = F.when(F.col("creators") == F.array(agent), F.lit('"x:agent"')).otherwise(F.to_json("creators"))
    tail = F.to_json(F.struct(F.col("item").alias("description"), F.col("source_document").alias("sourceDocument")))
    node_json = F.concat(
        head.substr(F.lit(1), F.length(head) - 1), F.lit(',"creator":'), creator,
        F.when(tail == "{}", "}").otherwise(F.concat(F.lit(","), tail.substr(F.lit(2), F.length(tail)))),
    )
    node_rows = with_items(node_objs, obj(NODES, "ord", "iri", node_json), item(NODE_ITEMS, "ord"))

    relation_json = fields(
        "iri",
        type_=F.array(F.concat(F.lit("x:_rel_"), "relation"), F.col("relation"), F.lit("RelationInstance")),
        source=F.col("source"), destination=F.col("destination"), title=F.col("title"),
        created=stamp, modified=stamp, creator=agent, description=F.col("item"),
    )
    relation_rows = with_items(relation_objs, obj(RELATIONS, "r", "iri", relation_json), item(EDGE_ITEMS, "r"))
    return reduce(
        DataFrame.unionByName, [account_rows, definition_rows, container_rows, node_rows, relation_rows]
    )


def documents(
    objects: DataFrame, names: DataFrame, naming: Naming, width: int = OBJECTS_PER_PART, part_bytes: int = BYTES_PER_PART
) -> DataFrame:
    """``(graph_id, part, n_parts, context, body)``: objects in document order, joined to text.

    ``names(graph_id, name)`` gives each graph's short name. Objects are cut into blocks of ``width`` numbers, and a block
    where its objects' text passes another ``part_bytes``; so no task holds more than a part and no part more than that and one object.
    The parts in order make the whole document (see ``document_text``), and ``conform.read_parts`` reads any number.
    """
    sizes = objects.groupBy("graph_id", "section").agg((F.max("ord") + 1).alias("_size"))
    # At most eight rows per graph reach these windows.
    within = Window.partitionBy("graph_id").orderBy("section")
    starts = sizes.withColumns(
        {
            "_start": F.coalesce(
                F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
            "_total": F.sum("_size").over(Window.partitionBy("graph_id")),
        }
    ).drop("_size")
    placed = objects.join(starts, ["graph_id", "section"]).withColumn("_seq", F.col("_start") + F.col("ord"))
    # The largest sort is one block of ``width`` objects.
    in_block = Window.partitionBy("graph_id", "_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    sized = placed.withColumn("_block", F.floor(F.col("_seq") / F.lit(width)).cast("int")).withColumn(
        "_cut", F.floor(F.coalesce(F.sum(F.octet_length("obj_json")).over(in_block), F.lit(0)) / F.lit(part_bytes)).cast("int")
    )
    parts = sized.groupBy("graph_id", F.struct("_block", "_cut").alias("_slot")).agg(
        F.array_sort(F.collect_list(F.struct("_seq", "obj_json"))).alias("_objects")
    )
    # Numbers leave gaps, so parts are renumbered; one row per part reaches this window.
    by_slot = Window.partitionBy("graph_id").orderBy("_slot")
    context = F.lit(naming.context_override) if naming.context_override else F.to_json(F.array(F.lit(naming.context_iri)))
    if not naming.context_override:
        context = F.regexp_replace(context, r"^\[|\]$", "")
    return (
        parts.select(
            "graph_id",
            (F.row_number().over(by_slot) - 1).alias("part"),
            F.count(F.lit(1)).over(Window.partitionBy("graph_id")).cast("int").alias("n_parts"),
            F.array_join(F.col("_objects.obj_json"), ",").alias("body"),
        )
        .join(names, "graph_id", "left")
        .select(
            "graph_id",
            "part",
            "n_parts",
            F.concat(
                F.lit("["), context, F.lit(","), F.to_json(F.struct(base_iri(naming, F.col("name")).alias("x"))), F.lit("]")
            ).alias("context"),
            "body",
        )
    )


def document_text(docs: DataFrame) -> DataFrame:
    """``(graph_id, part, jsonld)``: text whose concatenation in part order is the document."""
    opening = F.when(
        F.col("part") == 0, F.concat(F.lit('{"@context":'), "context", F.lit(',"@graph":['))
    ).otherwise(F.lit(","))
    closing = F.when(F.col("part") == F.col("n_parts") - 1, F.lit("]}")).otherwise(F.lit(""))
    return docs.select("graph_id", "part", F.concat(opening, "body", closing).alias("jsonld"))
