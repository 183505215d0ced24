"""Reading text corpora and documents; writing tables, documents and working graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.classify import Graph
from claimweave.operators.project import document_text
from claimweave.operators.routing import run_slug
from claimweave.sources.commits import Store


def read_papers(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Whole UTF-8 text files as ``(paper_id, name, text)``; the path is the id."""
    reader = spark.readStream if streaming else spark.read
    return (
        reader.format("text")
        .option("wholetext", True)
        .load(path)
        .select(
            F.input_file_name().alias("paper_id"),
            F.regexp_extract(F.input_file_name(), r"[^/]+$", 0).alias("name"),
            F.col("value").alias("text"),
        )
    )


def write_documents(docs: DataFrame, path: str) -> None:
    """Linked-data documents as JSON lines ``{graph_id, part, jsonld}``, so file count follows data size, not graphs.

    The parts of a large graph, in order, make its document; an ordinary graph is a single line.
    """
    document_text(docs).write.mode("overwrite").json(path)


def read_document_text(spark: SparkSession, path: str) -> DataFrame:
    """``(graph_id, part, jsonld)`` as written by ``write_documents``."""
    return spark.read.schema("graph_id string, part int, jsonld string").json(path)


def working_graph_parts(graph: Graph, papers: DataFrame, report: DataFrame, **more: DataFrame) -> dict[str, DataFrame]:
    """The parts of the working-graph artifact by name: source, paper, nodes, edges, dropped and report.

    Failures, statistics, models and whatever else is kept per graph come as further tables.
    """
    slug = run_slug(F.lit(None).cast("string"), F.col("graph_id"), F.lit(None).cast("string"))
    names = graph.nodes.select("graph_id").distinct()
    edges = [name for name in ("ord", "relation", "subject", "object", "anchor", "consolidated") if name in graph.edges.columns]
    return {
        "source": names.select("graph_id", F.col("graph_id").alias("source"), slug.alias("slug")),
        "paper": papers.select("graph_id", "title", "doi", "license", "authors"),
        "nodes": graph.nodes.select("graph_id", "ord", "id", "type", "text", "description", "doi", "url", "anchor"),
        "edges": graph.edges.select("graph_id", *edges),
        "dropped": graph.rejects.select("graph_id", "kind", "pos", "why", "payload"),
        "report": report,
        **more,
    }


def working_graph_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """All parts of the working graphs as ``(graph_id, part, row_json)`` rows; a missing value is written as null."""
    rows = None
    for name, df in tables.items():
        own = F.struct(*[F.col(column) for column in df.columns if column != "graph_id"])
        part = df.select("graph_id", F.lit(name).alias("part"), F.to_json(own, {"ignoreNullFields": "false"}).alias("row_json"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def append_working_graphs(store: Store, run: str, tables: dict[str, DataFrame]) -> bool:
    """Add a run's working graphs to a store, one table per part; False if the run was added before."""
    return store.write(run, tables, kind="working graphs")


def append_quarantine(store: Store, run: str, rows: DataFrame) -> bool:
    """Add refused papers and their sidecar fields to the quarantine of a store; False if the run was added before."""
    return store.write(run, {"quarantine": rows}, kind="quarantine")
