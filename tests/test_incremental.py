"""Committed batches, replies by event time, and edits merged into base tables."""

import itertools
import json

import pytest

from claimweave.sources.commits import Store
from claimweave.streaming import incremental

REPLIES = "graph_id string, ts timestamp, content string"


def reply(text):
    return json.dumps({"nodes": [{"id": "a", "type": "Claim", "text": text}], "edges": []})


def run(spark, tmp_path, batches):
    """One micro-batch after the other, each in a run of its own."""
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))
    for batch in batches:
        frame = spark.createDataFrame(batch, "graph_id string, t string, content string")
        frame.selectExpr("graph_id", "timestamp(t) as ts", "content").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(REPLIES).parquet(source)
        assert incremental.classify_stream(stream, out, checkpoint).trigger(availableNow=True).start().awaitTermination(180)
    return {(r["graph_id"], r["text"]) for r in incremental.current(spark, out, "nodes").collect()}


def test_the_newest_reply_counts_not_the_last_batch(spark, tmp_path):
    at = lambda hour, text: ("g", f"2026-01-01 {hour}", reply(text))
    batches = [[at("00:00", "one")], [at("01:00", "two")], [at("02:00", "one")], [at("00:30", "old")], [at("02:00", "one")]]
    assert run(spark, tmp_path, batches) == {("g", "one")}
    store = Store(spark, str(tmp_path / "out"))
    # The late and the repeated reply are batches without graphs.
    sizes = {r["batch"]: json.loads(r["manifest"])["rows"]["graphs"] for r in store.batches().collect()}
    assert sizes == {"0": 1, "1": 1, "2": 1, "3": 0, "4": 0}


def test_order_of_delivery_changes_nothing(spark, tmp_path):
    rows = [("g", "2026-01-01 00:00", reply("x")), ("g", "2026-01-01 00:05", reply("y")), ("g", "2026-01-01 00:05", reply("z")),
            ("h", None, reply("undated")), (None, "2026-01-01 00:00", reply("lost"))]
    found = [
        run(spark, tmp_path / str(i), [[rows[k] for k in order[:2]], [rows[k] for k in order[2:]]])
        for i, order in enumerate([(0, 1, 2, 3, 4), (2, 4, 1, 0, 3)])
    ]
    assert found[0] == found[1] and ("h", "undated") in found[0] and len(found[0]) == 2


def test_batches_are_committed_once_and_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.is_empty() and store.batches().count() == 0
    frame = spark.range(3).toDF("x")
    frame.write.parquet(str(tmp_path / "store" / "rows" / "batch=half"))  # what a lost attempt left
    assert store.write("b.0", {"rows": frame}, note="n") and not store.write("b.0", {"rows": frame})
    assert sorted((r["x"], r["batch"]) for r in store.read("rows").collect()) == [(x, "b.0") for x in range(3)]
    assert store.write("half", {"rows": frame.where("x = 1")})
    assert store.read("rows").count() == 4
    manifest = {r["batch"]: json.loads(r["manifest"]) for r in store.batches().collect()}
    assert manifest["b.0"] == {"batch": "b.0", "rows": {"rows": 3}, "note": "n"}
    for name in ("", "a/b", "_x", ".x", "a=b"):
        with pytest.raises(ValueError):
            store.write(name, {"rows": frame})


SF = "/root/testdata/sf0.001"


def test_sinks_append_a_run_once(spark, tmp_path):
    from claimweave.operators import routing
    from claimweave.plans.catalog import Corpus, _report
    from claimweave.sources import papers
    from pyspark.sql import functions as F

    corpus, store = Corpus(spark, SF), Store(spark, str(tmp_path / "sinks"))
    refused = routing.quarantine(routing.route(corpus.view("paper_rows"), 2000), F.lit("2026-01-01T00:00:00.000Z"), F.lit(" me "))
    n = refused.count()
    assert n and papers.append_quarantine(store, "monday", refused) and not papers.append_quarantine(store, "monday", refused)
    assert store.read("quarantine").count() == n
    assert papers.append_quarantine(store, "tuesday", refused) and store.read("quarantine").count() == 2 * n
    parts = papers.working_graph_parts(corpus.graph, corpus.papers, _report(corpus))
    assert papers.append_working_graphs(store, "graphs-1", parts) and not papers.append_working_graphs(store, "graphs-1", parts)
    back = {name: store.read(name).where("batch = 'graphs-1'").drop("batch") for name in parts}
    text = lambda tables: sorted(tuple(row) for row in papers.working_graph_rows(tables).collect())
    assert text(back) == text(parts)
    manifest = json.loads(store.batches().where("batch = 'graphs-1'").first()["manifest"])
    assert manifest["kind"] == "working graphs" and manifest["rows"]["nodes"] == corpus.graph.nodes.count()


def test_edits_merged_into_a_base_equal_the_whole_log(spark, tmp_path):
    from claimweave.operators import edits
    from claimweave.plans.catalog import Corpus
    from claimweave.streaming import base

    corpus = Corpus(spark, SF)
    out, source = str(tmp_path / "base"), str(tmp_path / "log")
    base.create_base(corpus.graph.nodes, edits.staged_edges(corpus.graph), out, 8)
    log = corpus.edit_log.toPandas()
    seqs = sorted(log.seq)
    cuts = [seqs[0], seqs[len(seqs) // 3], seqs[len(seqs) // 2], seqs[-1] + 1]
    schema = corpus.edit_log.schema
    for low, high in zip(cuts, cuts[1:]):
        corpus.edit_log.where(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        assert base.edit_base_stream(stream, out, str(tmp_path / "cp"), 8).trigger(availableNow=True).start().awaitTermination(300)

    def rows(df, names):
        return sorted((tuple(row) for row in df.select(*names).collect()), key=str)

    whole = edits.edited_graph(corpus.graph, corpus.edit_log)
    nodes = ["graph_id", "ord", "id", "type", "text", "description", "dropped", "added"]
    edges = ["graph_id", "ord", "id", "relation", "subject", "object", "dropped", "added"]

    def equal():
        return rows(base.base_table(spark, out, "nodes"), nodes) == rows(whole[0], nodes) and rows(
            base.base_table(spark, out, "edges"), edges
        ) == rows(whole[1], edges)

    assert equal()
    # A batch merged again changes nothing, and only its own buckets are written.
    graph = log.graph_id.iloc[0]
    files = lambda: {f for t in ("nodes", "edges") for f in base._read(spark, out, t).inputFiles()}
    before = files()
    (touched,) = base.merge_edits(spark, out, corpus.edit_log.where(f"graph_id = '{graph}'"), 8)
    gone = before - files()
    assert gone and all(f"/bucket={touched}/" in f for f in gone)
    assert equal()
    assert base.merge_edits(spark, out, corpus.edit_log.limit(0), 8) == []
