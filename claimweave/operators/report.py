"""The corpus run report: one row per graph, and totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.vocab import NODE_CLASSES, RELATIONS


def _measures(df: DataFrame, measure: Column, amount: Column = None) -> DataFrame:
    amount = F.lit(1).cast("bigint") if amount is None else amount
    return df.select("graph_id", measure.alias("measure"), amount.cast("double").alias("amount"))


def _several(df: DataFrame, *measures: Column) -> DataFrame:
    """Each row counted under every measure that is not NULL, from one reading of ``df``."""
    return _measures(df.select("graph_id", F.explode(F.array_compact(F.array(*measures))).alias("measure")), F.col("measure"))


def measured(nodes: DataFrame, edges: DataFrame, stamps: DataFrame, rejects: DataFrame, judged_edges: DataFrame) -> DataFrame:
    """``(graph_id, measure, amount)``: everything that is counted, as one long table that reads each input once."""
    anchored = F.col("anchor").isNotNull()
    parts = [
        _several(nodes, F.lit("nodes"), F.concat(F.lit("class "), "type"), F.when(anchored, "node anchors")),
        _several(edges, F.lit("edges"), F.concat(F.lit("relation "), "relation"), F.when(anchored, "edge anchors")),
        _measures(stamps, F.concat(F.lit("stamp "), "stamp")),
        _measures(rejects, F.concat(F.lit("reject "), "kind")),
        _measures(judged_edges, F.lit("folded edges"), F.col("copies")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _column(measure: str) -> str:
    return measure.replace(" ", "_").lower()


COUNTS = (
    ["nodes", "edges", "node anchors", "edge anchors"]
    + [f"class {name}" for name in NODE_CLASSES]
    + [f"relation {name}" for name, _, _ in RELATIONS]
    + ["stamp spine", "stamp paper", "stamp none", "reject node", "reject dangling", "reject ungrammatical", "folded edges"]
)


def run_report(
    nodes: DataFrame, edges: DataFrame, stamps: DataFrame, rejects: DataFrame, judged_edges: DataFrame,
    receipts: DataFrame | None = None,
) -> DataFrame:
    """Counts per graph from one long table of measures and one pivoting aggregate: a single shuffle, combined map-side."""
    parts = [measured(nodes, edges, stamps, rejects, judged_edges)]
    if receipts is not None:
        parts += [
            _measures(receipts, F.lit("calls"), F.col("calls")),
            _measures(receipts, F.lit("cost"), F.col("cost")),
        ]
    measures = reduce(DataFrame.unionByName, parts)

    def total(measure: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("amount"))), F.lit(0.0))

    counted = [total(name).cast("bigint").alias(_column(name)) for name in COUNTS]
    if receipts is not None:
        counted += [total("calls").cast("bigint").alias("calls"), total("cost").alias("cost")]
    return measures.groupBy("graph_id").agg(*counted)


def corpus_totals(report: DataFrame, source: Column) -> DataFrame:
    """Report rows rolled up: per graph, per source, and the whole corpus (NULL keys)."""
    sums = [F.sum(name).alias(name) for name in report.columns if name != "graph_id"]
    return report.withColumn("source", source).rollup("source", "graph_id").agg(*sums)


def run_summary(
    requests: DataFrame, judged_nodes: DataFrame, receipts: DataFrame, models: DataFrame, failures: DataFrame,
    papers: DataFrame,
) -> DataFrame:
    """One row per requested graph: title, admitted and rejected nodes, calls, cost, models in order, failure reason.

    Every joined table has one row per graph; a graph has a handful of models, so their list is short.
    """
    counts = judged_nodes.groupBy("graph_id").agg(
        F.count_if(F.col("why").isNull()).alias("nodes"), F.count_if(F.col("why").isNotNull()).alias("rejected")
    )
    in_order = F.array_sort(F.collect_list(F.struct("use_no", "model")))["model"]
    named = models.groupBy("graph_id").agg(F.array_join(in_order, " + ").alias("models"))
    joined = requests.select("graph_id").distinct()
    for table in (papers.select("graph_id", "title"), counts, receipts.drop("billed"), named, failures):
        joined = joined.join(table, "graph_id", "left")
    zero = {name: F.coalesce(name, F.lit(0)) for name in ("nodes", "rejected", "calls")}
    return joined.withColumns(zero).withColumn("cost", F.coalesce("cost", F.lit(0.0)))


def paper_report(
    requests: DataFrame, counted: DataFrame, papers: DataFrame, notes: DataFrame, receipts: DataFrame, models: DataFrame,
    failures: DataFrame,
) -> DataFrame:
    """The whole report, one row per requested graph: attribution, counts, refusals, failure, notes, models, calls and cost.

    ``counted`` is the table of ``measured``. Its groups become one map per graph, of as many entries as there are measures;
    classes and relations are listed as ``name=count`` in their fixed order, authors as ``name <ORCID>``.
    """
    sums = counted.groupBy("graph_id", "measure").agg(F.sum("amount").cast("bigint").alias("n"))
    maps = sums.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("measure", "n"))).alias("_counts"))
    people = F.transform("authors", lambda a: F.concat(a["name"], F.lit(" <"), F.coalesce(a["orcid"], F.lit("")), F.lit(">")))
    whose = papers.select("graph_id", "title", "doi", "license", F.nullif(F.array_join(people, "; "), F.lit("")).alias("authors"))
    in_order = F.array_sort(F.collect_list(F.struct("use_no", "model")))["model"]
    named = models.groupBy("graph_id").agg(F.array_join(in_order, " + ").alias("models"))
    listed = F.array_sort(F.collect_list(F.concat_ws(": ", "note", "detail")))
    remarks = notes.groupBy("graph_id").agg(F.array_join(listed, " | ").alias("notes"))
    joined = requests.select("graph_id").distinct()
    for table in (maps, whose, remarks, receipts.select("graph_id", "calls", "cost"), named, failures.select("graph_id", "why")):
        joined = joined.join(table, "graph_id", "left")

    def count(measure: str) -> Column:
        return F.coalesce(F.col("_counts")[measure], F.lit(0)).alias(_column(measure))

    def listing(kind: str, names: list[str]) -> Column:
        entry = lambda name: F.concat(F.lit(f"{name}="), F.col("_counts")[f"{kind} {name}"].cast("string"))
        return F.concat_ws(", ", *[entry(name) for name in names])

    plain = [name for name in COUNTS if not name.startswith(("class ", "relation "))]
    return joined.select(
        "graph_id", "title", "authors", "doi", "license", *[count(name) for name in plain],
        listing("class", NODE_CLASSES).alias("classes"), listing("relation", [name for name, _, _ in RELATIONS]).alias("relations"),
        F.col("why").alias("failure"), "notes", "models", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("cost", F.lit(0.0)).alias("cost"),
    )


def piece_failures(failures: DataFrame, paper: Column, piece: Column) -> DataFrame:
    """``(graph_id, piece, why)``: the pieces of papers that gave no usable graph; both expressions are over the call's graph."""
    return failures.select(paper.alias("graph_id"), piece.cast("bigint").alias("piece"), "why")
