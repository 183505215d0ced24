"""Edits merged into base tables as they arrive.

A base is two tables of editable records, ``nodes`` and ``edges``, in folders by a hash of the graph, and the table ``starts`` with
each graph's first free number. A batch of edits reads and replaces the buckets of its own graphs and no others.

Every row knows the log position of the last change of each of its fields, and added rows the position that made them. A change
counts if its position is later, and a position makes one row only; so a batch that is merged again, whole or in part, changes
nothing, and an executor or driver may be lost at any time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from claimweave.functions.ordering import number_rows
from claimweave.operators import edits
from claimweave.session import passing, settle

#: Folders of a base table.
BUCKETS = 64
FIELDS = {"Node": edits.NODE_FIELDS, "Edge": edits.EDGE_FIELDS}
_TABLE = {"Node": "nodes", "Edge": "edges"}


def bucket_of(graph_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(graph_id), F.lit(buckets)).cast("int")


def create_base(nodes: DataFrame, edges: DataFrame, out: str, buckets: int = BUCKETS) -> None:
    """Write the base of a corpus from its nodes and its staged edges; an existing one is replaced."""
    none = F.create_map().cast("map<string,bigint>")
    for noun, staged in (("Node", edits.staged_nodes(nodes)), ("Edge", edges.drop("branch", "pos"))):
        rows = staged.withColumns({"born": F.lit(-1).cast("bigint"), "changed": none, "bucket": bucket_of(F.col("graph_id"), buckets)})
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/{_TABLE[noun]}")
    edits.counter_starts(edges, nodes).write.mode("overwrite").parquet(f"{out}/starts")


def base_table(spark: SparkSession, out: str, table: str) -> DataFrame:
    """The records as they are now: ``nodes`` or ``edges``."""
    return _read(spark, out, table).drop("bucket", "born", "changed")


def _read(spark: SparkSession, out: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{table}")


def _changes(log: DataFrame, noun: str) -> DataFrame:
    """``(graph_id, id, field -> (seq, value))``: of each record and field the last change in the log."""
    own = log.where(F.col("op").isin(f"edit{noun}", f"drop{noun}", f"restore{noun}"))
    edited = F.col("op") == f"edit{noun}"
    listed = F.when(edited, F.col("patch")).otherwise(F.create_map(F.lit("dropped"), (F.col("op") == f"drop{noun}").cast("string")))
    rows = own.select("graph_id", F.col("target_id").alias("id"), "seq", F.explode(listed).alias("field", "value"))
    rows = rows.where(F.col("field").isin(*FIELDS[noun], "dropped"))
    last = rows.groupBy("graph_id", "id", "field").agg(F.max(F.struct("seq", "value")).alias("change"))
    return last.groupBy("graph_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("field", "change"))).alias("changes"))


def merged_rows(rows: DataFrame, log: DataFrame, noun: str) -> DataFrame:
    """Base rows after the changes of a log that are later than theirs; one before its record was made changes nothing."""
    joined = rows.join(_changes(log, noun), ["graph_id", "id"], "left")

    def later(field: str) -> Column:
        seq = F.col("changes")[field]["seq"]
        return F.coalesce((seq > F.coalesce(F.col("changed")[field], F.lit(-1))) & (seq > F.col("born")), F.lit(False))

    values, marks = {}, []
    for field in (*FIELDS[noun], "dropped"):
        kind = dict(rows.dtypes)[field]
        values[field] = F.when(later(field), F.col("changes")[field]["value"].cast(kind)).otherwise(F.col(field))
        marks.append(F.struct(F.lit(field).alias("key"), F.when(later(field), F.col("changes")[field]["seq"]).otherwise(F.col("changed")[field]).alias("value")))
    known = F.filter(F.array(*marks), lambda mark: mark["value"].isNotNull())
    return joined.withColumns(values | {"changed": F.map_from_entries(known)}).select(*rows.columns)


def _born(log: DataFrame, nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The added records of a log that the base does not have, with their ids: counted on over all that were added before."""
    mine = log.where(F.col("op").isin("addNode", "addEdge")).dropDuplicates(["graph_id", "seq"])
    known = nodes.where("added").select("graph_id", F.col("born").alias("seq")).unionByName(
        edges.where("added").select("graph_id", F.col("born").alias("seq"))
    )
    every = known.unionByName(mine.select("graph_id", "seq")).distinct()
    places = number_rows(settle(every, "added-positions"), ["graph_id"], "seq", "_k")
    fresh = mine.join(known, ["graph_id", "seq"], "left_anti")
    letter = F.when(F.col("op") == "addNode", "n").otherwise("e")
    number = F.col("_k") + F.coalesce("_start", F.lit(1))
    return fresh.join(places, ["graph_id", "seq"]).join(starts, "graph_id", "left").select(
        "graph_id", "seq", "op", "patch", F.concat(letter, number.cast("string")).alias("id")
    )


def merge_edits(spark: SparkSession, out: str, log: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Merge a batch of edits into the base and return the buckets it replaced.

    The edits of one graph must come in the order of the log over the batches, in any order within one.
    """
    with passing(spark):
        log = settle(log.withColumn("bucket", bucket_of(F.col("graph_id"), buckets)), "edit-batch")
        touched = [row[0] for row in log.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return []
        nodes, edges = (_read(spark, out, table).where(F.col("bucket").isin(touched)) for table in _TABLE.values())
        graphs = log.select("graph_id").distinct()
        starts = spark.read.parquet(f"{out}/starts").join(graphs, "graph_id", "left_semi")
        fresh = settle(_born(log, nodes, edges, starts), "fresh-records")
        for noun, rows in (("Node", nodes), ("Edge", edges)):
            grown = edits.with_added(rows.drop("changed", "bucket", "born"), fresh, f"add{noun}", FIELDS[noun])
            added = grown.where(F.col("born") >= 0).withColumns(
                {"changed": F.create_map().cast("map<string,bigint>"), "bucket": bucket_of(F.col("graph_id"), buckets)}
            )
            result = settle(merged_rows(rows.unionByName(added), log, noun), "merged-bucket")
            writer = result.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("bucket").parquet(f"{out}/{_TABLE[noun]}")
    return sorted(touched)


def edit_base_stream(log: DataFrame, out: str, checkpoint: str, buckets: int = BUCKETS) -> DataStreamWriter:
    """Merge edits into the base as they arrive; only the folders of the graphs in a batch are read and replaced."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        merge_edits(batch.sparkSession, out, batch, buckets)

    return log.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
