"""Facts about graph structure: drawable edges, degrees, components, signatures, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.ordering import block_of
from claimweave.session import settle

#: Ids per digest when a structure signature is computed.
SIGNATURE_BLOCK = 10_000


def drawable_edges(nodes: DataFrame, status: DataFrame) -> DataFrame:
    """Valid, kept edges whose two ends are live."""
    live = nodes.where(~F.col("dropped")).select("graph_id", "id")
    return (
        status.where("valid")
        .join(live.withColumnRenamed("id", "subject"), ["graph_id", "subject"], "left_semi")
        .join(live.withColumnRenamed("id", "object"), ["graph_id", "object"], "left_semi")
    )


def edge_ends(edges: DataFrame) -> DataFrame:
    """Both ends of every edge as ``(graph_id, id)`` rows."""
    return edges.select("graph_id", F.explode(F.array("subject", "object")).alias("id"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree (a self-loop counts twice) and display radius of every node."""
    counts = edge_ends(edges).groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("degree"))
    base = F.when(F.col("type") == "Claim", 13).otherwise(9)
    return (
        nodes.select("graph_id", "id", "type")
        .join(counts, ["graph_id", "id"], "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0)))
        .withColumn("radius", base + F.least("degree", F.lit(8)) * F.lit(1.5))
    )


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, ord, id, component)`` where ``component`` is the lowest ``ord`` reachable over undirected edges.

    Alternating star contraction over (vertex, parent) pairs: every vertex links its larger, then its smaller,
    neighbours to its minimum. Rounds grow with the logarithm of the graph, not its diameter; each is two combined
    aggregates and one join, for all graphs at once, and ends in a written table.
    """
    index = nodes.select("graph_id", "id", "ord")
    pairs = (
        edges.where(F.col("subject") != F.col("object"))
        .join(index.withColumnsRenamed({"id": "subject", "ord": "a"}), ["graph_id", "subject"])
        .join(index.withColumnsRenamed({"id": "object", "ord": "b"}), ["graph_id", "object"])
        .select("graph_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    links = settle(pairs, "component-links")
    while not _unsettled(links).isEmpty():
        links = settle(_small_star(_large_star(links)), "component-links")
    labels = links.select("graph_id", F.col("u").alias("ord"), F.col("v").alias("component"))
    return index.join(labels, ["graph_id", "ord"], "left").withColumn("component", F.coalesce("component", "ord"))


def _unsettled(links: DataFrame) -> DataFrame:
    """Vertices that keep the links from being stars: several parents, or a parent that has one itself.

    Links always point to a smaller vertex and preserve components, so once none is left every vertex is linked
    straight to the smallest of its component.
    """
    several = links.groupBy("graph_id", "u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    parents = links.select("graph_id", F.col("v").alias("u")).distinct()
    return several.select("graph_id", "u").unionByName(
        parents.join(links.select("graph_id", "u"), ["graph_id", "u"], "left_semi")
    )


def _star(directed: DataFrame, keep) -> DataFrame:
    """Link the neighbours selected by ``keep`` to the minimum of each neighbourhood (centre included)."""
    lowest = directed.groupBy("graph_id", "x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
    return (
        directed.join(lowest, ["graph_id", "x"])
        .where(keep)
        .select("graph_id", F.col("y").alias("u"), F.col("m").alias("v"))
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("graph_id", F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
        links.select("graph_id", F.col("v").alias("x"), F.col("u").alias("y"))
    )
    return _star(both, F.col("y") > F.col("x")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select("graph_id", F.col("u").alias("x"), F.col("v").alias("y"))
    lowest = down.groupBy("graph_id", "x").agg(F.min("y").alias("m"))
    joined = down.join(lowest, ["graph_id", "x"])
    moved = joined.where(F.col("y") != F.col("m")).select("graph_id", F.col("y").alias("u"), F.col("m").alias("v"))
    own = lowest.select("graph_id", F.col("x").alias("u"), F.col("m").alias("v"))
    return own.unionByName(moved).distinct()


def corpus_components(graphs: DataFrame, sources: DataFrame) -> DataFrame:
    """``(graph_id, component, graphs, sources)``: graphs that are connected through sources they share.

    ``sources(graph_id, iri)`` says which graph has which source; ``component`` is the smallest graph of the component, ``graphs``
    and ``sources`` count its graphs and the sources in it. Each source links its graphs to one of them, so the links are no
    more than the rows of ``sources`` however many graphs share one. Graphs are told apart by 64-bit hashes.
    """
    known = graphs.select("graph_id").distinct().withColumn("ord", F.xxhash64("graph_id"))
    cited = settle(sources.select("graph_id", "iri").where("iri is not null").distinct().join(known, "graph_id"), "corpus-sources")
    head = cited.groupBy("iri").agg(F.min("ord").alias("head"))
    links = cited.join(head, "iri").where(F.col("ord") != F.col("head")).select("ord", "head").distinct()
    whole = F.lit("").alias("graph_id")
    vertices = settle(known.select(whole, F.col("ord").alias("id"), "ord"), "corpus-graphs")
    labels = component_labels(vertices, links.select(whole, F.col("ord").alias("subject"), F.col("head").alias("object")))
    named = settle(known.join(labels.select("ord", F.col("component").alias("_root")), "ord"), "corpus-labels")
    sizes = named.groupBy("_root").agg(F.min("graph_id").alias("component"), F.count(F.lit(1)).alias("graphs"))
    shared = head.join(named.select(F.col("ord").alias("head"), "_root"), "head").groupBy("_root").agg(F.count(F.lit(1)).alias("sources"))
    return named.join(sizes, "_root").join(shared, "_root", "left").select(
        "graph_id", "component", "graphs", F.coalesce("sources", F.lit(0)).alias("sources")
    )


def component_sizes(labels: DataFrame) -> DataFrame:
    """Size per component, and the main one per graph: the largest, the first in node order on ties."""
    sizes = labels.groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("graph_id").agg(F.max(F.struct("size", (-F.col("component")).alias("rank"))).alias("_top"))
    return (
        sizes.join(main, "graph_id")
        .withColumn("is_main", F.col("component") == -F.col("_top")["rank"])
        .drop("_top")
    )


def structure_signatures(nodes: DataFrame, edges: DataFrame, width: int = SIGNATURE_BLOCK) -> DataFrame:
    """A digest per graph of its live ids and drawable pairs in order; it changes only when the structure does.

    Blocks of ``width`` entries are digested first and the block digests again, so no task joins a whole hot graph.
    """
    entries = nodes.select("graph_id", F.lit("node").alias("part"), "ord", F.col("id").alias("entry")).unionByName(
        edges.select("graph_id", F.lit("pair").alias("part"), "ord", F.concat_ws(">", "subject", "object").alias("entry"))
    )

    def digest(order: str, value: str):
        ordered = F.array_sort(F.collect_list(F.struct(order, value)))
        return F.sha2(F.array_join(ordered[value], ","), 256)

    blocks = entries.groupBy("graph_id", "part", block_of(F.col("ord"), width).alias("block")).agg(
        digest("ord", "entry").alias("block_digest")
    )
    parts = blocks.groupBy("graph_id", "part").agg(digest("block", "block_digest").alias("part_digest"))
    empty = F.sha2(F.lit(""), 256)
    return parts.groupBy("graph_id").agg(
        F.sha2(
            F.concat_ws(
                "|",
                F.coalesce(F.max(F.when(F.col("part") == "node", F.col("part_digest"))), empty),
                F.coalesce(F.max(F.when(F.col("part") == "pair", F.col("part_digest"))), empty),
            ),
            256,
        ).alias("signature")
    )


def changed_structures(before: DataFrame, after: DataFrame) -> DataFrame:
    """Graphs whose signature differs between two snapshots, or that exist in only one."""
    old = before.select("graph_id", F.col("signature").alias("_old"))
    return (
        after.join(old, "graph_id", "full")
        .where(~F.col("signature").eqNullSafe(F.col("_old")))
        .select("graph_id")
    )


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes no edge touches, counted per graph and class beside the class total."""
    wired = edge_ends(edges).distinct()
    flagged = nodes.select("graph_id", "id", "type").join(
        wired.withColumn("_wired", F.lit(True)), ["graph_id", "id"], "left"
    )
    return flagged.groupBy("graph_id", "type").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("_wired").isNull()).alias("unwired")
    )
