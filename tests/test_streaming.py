"""Streaming forms give what their batch forms give."""

import json
import os

import pytest

from claimweave import session
from claimweave.sources import papers
from claimweave.streaming import deltas, incremental, runs


def finish(query):
    query.awaitTermination(120)


def test_replies_classified_as_they_arrive(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [
        (f"g{i}", f"2026-01-01 00:00:{i:02d}",
         json.dumps({"nodes": [{"id": "a", "type": "Claim", "text": "t"}, {"id": "a", "type": "Claim", "text": "u"}],
                     "edges": [{"relation": "supports", "subject": "a", "object": "a"}]}))
        for i in range(4)
    ]
    schema = "graph_id string, ts timestamp, content string"
    frame = spark.createDataFrame(rows + rows[:1], "graph_id string, t string, content string").selectExpr(
        "graph_id", "timestamp(t) as ts", "content"
    )
    frame.write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    writer = incremental.classify_stream(stream, out, str(tmp_path / "cp"))
    finish(writer.trigger(availableNow=True).start())
    read = lambda table: incremental.current(spark, out, table)
    assert read("nodes").count() == 4  # the repeated reply is dropped
    assert read("edges").count() == 4
    assert {r["why"] for r in read("rejects").collect()} == {'duplicate id "a"'}
    # A different reply of one graph replaces it.
    again = spark.createDataFrame(
        [("g1", "2026-01-01 00:05:00", json.dumps({"nodes": [{"id": "z", "type": "Question", "text": "q"}], "edges": []}))],
        "graph_id string, t string, content string",
    )
    again.selectExpr("graph_id", "timestamp(t) as ts", "content").write.mode("append").parquet(source)
    finish(incremental.classify_stream(stream, out, str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert {(r["graph_id"], r["type"]) for r in read("nodes").collect()} == {("g0", "Claim"), ("g1", "Question"), ("g2", "Claim"), ("g3", "Claim")}
    assert {r["graph_id"] for r in read("edges").collect()} == {"g0", "g2", "g3"}


def test_tables_of_a_block_pass(spark):
    with session.passing(spark):
        kept = session.settle(spark.range(3).toDF("x"), "three")
        path = kept.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
        assert kept.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_latest_status_in_update_mode(spark, tmp_path):
    lines = ['{"type":"status","message":"one"}', "", "junk", '{"type":"ping"}', '{"type":"status","message":"two"}',
             '{"type":"result","data":{"a":1}}', '{"type":"error"}']
    log = spark.createDataFrame([("r", i, line) for i, line in enumerate(lines)], "run_id string, seq long, line string")
    source = str(tmp_path / "log")
    log.write.parquet(source)
    stream = spark.readStream.schema(log.schema).parquet(source)
    query = (
        runs.latest_status(runs.run_events(stream)).writeStream.outputMode("update").format("memory")
        .queryName("latest").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    finish(query)
    assert [tuple(row) for row in spark.table("latest").collect()] == [("r", "two")]
    result = runs.run_results(runs.run_events(log)).first()
    assert (result["state"], result["error"], result["data"]) == ("error", runs.FAILED, None)


def test_sessions_end_in_silence(spark, tmp_path):
    rows = [(1, s, "content") for s in (0, 60, 100, 400, 450)] + [(1, 99_999, "content")]
    rows += [(2, 0, "content"), (2, 50, "end")]  # a normal end is no stall
    frame = spark.createDataFrame(rows, "gen_id long, s long, kind string").selectExpr("gen_id", "timestamp_seconds(s) as ts", "kind")
    source = str(tmp_path / "deltas")
    frame.write.parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    query = (
        deltas.stream_activity(stream, 120).writeStream.outputMode("append").format("memory").queryName("stalls")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    finish(query)
    ended = sorted((row["active_from"].timestamp(), row["deltas"]) for row in spark.table("stalls").collect())
    assert [n for _, n in ended] == [3, 2]


def test_text_files_and_documents_round_trip(spark, tmp_path):
    folder = tmp_path / "papers"
    folder.mkdir()
    (folder / "one.txt").write_text("line\r\nnext — é", encoding="utf-8")
    read = papers.read_papers(spark, str(folder)).first()
    assert (read["name"], read["text"]) == ("one.txt", "line\r\nnext — é")
    docs = spark.createDataFrame(
        [("g", 0, 2, '["c"]', '{"@id":"a"}'), ("g", 1, 2, '["c"]', '{"@id":"b"}')],
        "graph_id string, part int, n_parts int, context string, body string",
    )
    papers.write_documents(docs, str(tmp_path / "docs"))
    parts = papers.read_document_text(spark, str(tmp_path / "docs")).orderBy("part").collect()
    assert json.loads("".join(p["jsonld"] for p in parts)) == {"@context": ["c"], "@graph": [{"@id": "a"}, {"@id": "b"}]}


def test_streamed_blocks_keep_a_long_generation_whole(spark, tmp_path):
    rows = [(1, i, 60 * i, "content", f"{i},") for i in range(150)] + [(1, 150, 9000, "end", ""), (9, 0, 99_999, "content", "x")]
    frame = spark.createDataFrame(rows, "gen_id long, seq long, s long, kind string, delta string").selectExpr(
        "gen_id", "seq", "timestamp_seconds(s) as ts", "kind", "delta"
    )
    source = str(tmp_path / "in")
    frame.write.parquet(source)
    stream = spark.readStream.schema(frame.schema).parquet(source)
    query = (
        deltas.stream_reassembled(stream, width=40).writeStream.outputMode("append").format("memory").queryName("blocks")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    finish(query)
    blocks = [r for r in spark.table("blocks").orderBy("block").collect() if r["gen_id"] == 1]
    assert [r["block"] for r in blocks] == [0, 1, 2, 3]
    assert "".join(r["content"] for r in blocks) == "".join(f"{i}," for i in range(150))
    assert [r["ended"] for r in blocks] == [False, False, False, True]


@pytest.mark.parametrize("streaming", [False, True])
def test_logs_are_read_from_files_in_order(spark, tmp_path, streaming):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.ndjson").write_text('{"type":"status","message":"one"}\n\n{"type":"status","message":"two"}\r\n{"type":"result","data":{"x":1}}\n')
    (folder / "b.ndjson").write_text('{"type":"status","message":"start"}')
    events = runs.run_events(runs.read_log(spark, str(folder), streaming))
    latest = runs.latest_status(events)
    if streaming:
        query = (
            latest.writeStream.outputMode("complete").format("memory").queryName("from_files")
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        finish(query)
        latest = spark.table("from_files")
    else:
        assert {r["run_id"]: r["state"] for r in runs.run_results(events).collect()} == {"a": "result", "b": "ended early"}
    assert {r["run_id"]: r["status"] for r in latest.collect()} == {"a": "two", "b": "start"}
