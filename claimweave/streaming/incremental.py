"""Incremental forms of classification and edit replay.

Both append micro-batches to a ``Store``: a batch becomes visible with its marker, and one that is retried after its marker is
there changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from claimweave.operators import replies
from claimweave.operators.classify import Graph, classify
from claimweave.session import passing, settle
from claimweave.sources.commits import Store


def classify_batch(batch: DataFrame, durable: bool = False) -> Graph:
    """Classify the graphs of one set of replies ``(graph_id, content)``."""
    parsed = replies.parse_graphs(batch)
    return classify(replies.raw_nodes(parsed), replies.raw_edges(parsed), durable)


def _version() -> Column:
    """What orders the replies for a graph: their time, and the digest of their text where times are equal."""
    return F.struct("ts", "digest")


def newest_replies(batch: DataFrame, heads: DataFrame | None) -> DataFrame:
    """``(graph_id, ts, digest, content)``: of each graph the newest reply, if it is newer than the one in ``heads``.

    A reply delivered again, and one older than what the graph already has, are so left out, however late they come.
    """
    dated = batch.where(F.col("graph_id").isNotNull()).withColumn("digest", F.sha2(F.coalesce("content", F.lit("")), 256))
    newest = dated.groupBy("graph_id").agg(F.max(_version()).alias("_new"))
    if heads is not None:
        known = heads.select("graph_id", F.struct("ts", "digest").alias("_known"))
        newest = newest.join(known, "graph_id", "left").where(F.col("_known").isNull() | (F.col("_new") > F.col("_known")))
    chosen = newest.select("graph_id", "_new.ts", "_new.digest")
    same = [dated["graph_id"] == chosen["graph_id"], dated["ts"].eqNullSafe(chosen["ts"]), dated["digest"] == chosen["digest"]]
    return dated.join(chosen, same, "left_semi").dropDuplicates(["graph_id"]).select("graph_id", "ts", "digest", "content")


def heads(store: Store) -> DataFrame:
    """``(graph_id, ts, digest, batch)``: the newest committed reply of each graph."""
    last = F.max(F.struct("ts", "digest", "batch")).alias("_last")
    return store.read("graphs").groupBy("graph_id").agg(last).select("graph_id", "_last.ts", "_last.digest", "_last.batch")


def classify_stream(reply_stream: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Classify replies as they arrive; each reply is a whole graph, so batches never split one.

    ``reply_stream(graph_id, ts, content)``. A graph is upserted by event time: ``current`` shows it as its newest reply left it,
    whatever the order and the batches of delivery. Replies without ``graph_id`` are ignored; one without ``ts`` is older than
    any other. Only the heads of the batch's own graphs are compared, and the parsed batch is written once and deleted, with all
    other intermediate tables, when the batch is done.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, out)
        if store.committed(batch_id):
            return
        with passing(batch.sparkSession):
            known = None
            if not store.is_empty():
                known = heads(store).join(batch.select("graph_id").distinct(), "graph_id", "left_semi")
            parsed = settle(replies.parse_graphs(newest_replies(batch, known)).drop("content"), "parsed-batch")
            graph = classify(replies.raw_nodes(parsed), replies.raw_edges(parsed), durable=True)
            tables = {"nodes": graph.nodes, "edges": graph.edges, "rejects": graph.rejects, "graphs": parsed.select("graph_id", "ts", "digest")}
            store.write(batch_id, tables)

    return reply_stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, out: str, table: str) -> DataFrame:
    """The rows of ``table`` (nodes, edges or rejects) that belong to the newest reply of their graph."""
    store = Store(spark, out)
    return store.read(table).join(heads(store), ["graph_id", "batch"], "left_semi").drop("batch")


def latest_patches(edit_log: DataFrame) -> DataFrame:
    """Edits folded to the last action per record and field: ``(graph_id, target_id, noun, field, seq, value)``.

    ``field`` is a patched field, or ``dropped`` with value ``true`` or ``false``. Folding is associative: folding
    folded batches gives the same rows as folding the whole log.
    """
    noun = F.regexp_extract("op", "(Node|Edge|Paper)$", 1)
    patched = edit_log.where(F.col("op").startswith("edit")).select(
        "graph_id", "target_id", noun.alias("noun"), "seq", F.explode("patch").alias("field", "value")
    )
    flagged = edit_log.where(F.col("op").rlike("^(drop|restore)")).select(
        "graph_id",
        "target_id",
        noun.alias("noun"),
        "seq",
        F.lit("dropped").alias("field"),
        F.col("op").startswith("drop").cast("string").alias("value"),
    )
    return fold_patches(patched.unionByName(flagged))


def fold_patches(patches: DataFrame) -> DataFrame:
    last = F.max(F.struct("seq", "value"))
    return (
        patches.groupBy("graph_id", "target_id", "noun", "field")
        .agg(last.alias("_last"))
        .select("graph_id", "target_id", "noun", "field", "_last.seq", "_last.value")
    )


def edit_stream(edits: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Fold each micro-batch of edits on its own; readers fold the batches again with ``fold_patches``.

    Nothing already written is read back, so the cost of a batch does not grow with the table.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        Store(batch.sparkSession, out).write(batch_id, {"patches": latest_patches(batch)})

    return edits.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
