"""Small blocks stand in for hot graphs: results must not depend on block widths."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimweave.functions.ordering import number_rows
from claimweave.operators import analytics, anchors
from claimweave.streaming import deltas


def test_numbering_is_dense_across_blocks(spark):
    rows = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("graph_id"),
        (F.col("id") * 3).alias("pos"),
    )
    plain = F.row_number().over(Window.partitionBy("graph_id").orderBy("pos")) - 1
    both = number_rows(rows, ["graph_id"], "pos", "ord", width=16).withColumn("plain", plain)
    assert both.where("ord <> plain").isEmpty() and both.count() == 500


def test_quotes_of_one_paper_split_over_copies_of_its_text(spark):
    texts = spark.createDataFrame([(1, "The  Quick brown fox"), (2, "")], "paper_id long, text string")
    quotes = ["The  Quick", "the quick", "absent", "", None]
    rows = [(1, i, quotes[i % 5]) for i in range(50)] + [(2, 0, "x"), (3, 0, "x")]
    found = anchors.check_anchors(
        spark.createDataFrame(rows, "paper_id long, pos long, anchor string"), texts, width=7
    ).collect()
    want = {0: "exact", 1: "normalized", 2: "missing", 3: None, 4: None}
    assert len(found) == 52
    assert all(row["match"] == (want[row["pos"] % 5] if row["paper_id"] == 1 else None) for row in found)


def test_signature_tells_structures_apart(spark):
    nodes = spark.createDataFrame([("g", f"n{i}", i) for i in range(25)], "graph_id string, id string, ord long")
    edges = spark.createDataFrame([("g", 0, "n0", "n1"), ("g", 1, "n1", "n2")], "graph_id string, ord long, subject string, object string")
    sign = lambda n, e: analytics.structure_signatures(n, e, width=4)
    same = sign(nodes.repartition(5), edges.repartition(3))
    assert analytics.changed_structures(sign(nodes, edges), same).isEmpty()
    fewer = sign(nodes, edges.where("ord = 0"))
    assert analytics.changed_structures(sign(nodes, edges), fewer).count() == 1


def test_reassembly_blocks_concatenate_to_the_text(spark):
    rows = spark.range(40).select(
        F.lit(1).alias("gen_id"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"),
        F.when(F.col("id") % 4 == 3, "keepalive").otherwise("content").alias("kind"),
        F.when(F.col("id") % 4 == 3, "").otherwise(F.concat(F.col("id").cast("string"), F.lit(","))).alias("delta"),
    )
    blocks = deltas.reassembled(rows.repartition(6), width=9).orderBy("block").collect()
    assert "".join(row["content"] for row in blocks) == "".join(f"{i}," for i in range(40) if i % 4 != 3)
    assert not any(row["empty"] for row in blocks)


def test_gaps_cross_days(spark):
    times = [0, 50, 86_000, 3 * 86_400 + 5]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "gen_id long, seq long, s long").select(
        "gen_id", "seq", F.timestamp_seconds("s").alias("ts"), F.lit("content").alias("kind")
    )
    calls = calls_of(spark, [(1, 0, times[-1] + 200)])
    got = {row["since"].timestamp(): row["gap_seconds"] for row in deltas.idle_stalls(rows, calls, 120).collect()}
    assert got == {50: 85_950.0, 86_000: 3 * 86_400 + 5 - 86_000.0, times[-1]: 200.0}


def calls_of(spark, rows):
    return spark.createDataFrame(rows, "gen_id long, s long, e long").select(
        "gen_id", F.timestamp_seconds("s").alias("started"), F.timestamp_seconds("e").alias("ended")
    )


def test_the_earlier_watchdog_names_the_stall(spark):
    content, alive = "content", "keepalive"
    rows = [(1, 10, content), (1, 1210, content)]  # twenty silent minutes: idle ends it first
    rows += [(2, 100 * i, alive) for i in range(1, 12)]  # signs of life, but no token: progress
    rows += [(3, 5, content)]  # a normal end
    rows += [(4, 5, content)]  # trailing silence
    calls = calls_of(spark, [(1, 0, 1300), (2, 0, 1150), (3, 0, 6), (4, 0, 500), (5, 0, 121), (6, 0, 119)])
    frame = spark.createDataFrame(rows, "gen_id long, s long, kind string").select("gen_id", F.timestamp_seconds("s").alias("ts"), "kind")
    got = {r["gen_id"]: (r["stalled_at"].timestamp(), r["reason"]) for r in deltas.stall_reasons(frame, calls, 120, 900).collect()}
    assert got == {
        1: (130, "silent for 120s"),
        2: (900, "no tokens for 900s"),
        4: (125, "silent for 120s"),
        5: (120, "silent for 120s"),
    }
