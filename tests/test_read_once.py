"""Steps that read their rows twice get stored ones."""

from claimweave.functions.ordering import number_rows
from claimweave.operators import classify, edits
from claimweave.plans.build import MergedStage, merged

from tests.conftest import edge_rows, node_rows
from tests.test_merged_stage import LOG


def test_edges_and_edits_are_numbered_from_stored_rows(spark, monkeypatch):
    numbered = []

    def watched(df, keys, pos, out):
        numbered.append((out, df._jdf.queryExecution().optimizedPlan().toString()))
        return number_rows(df, keys, pos, out)

    monkeypatch.setattr(edits, "number_rows", watched)
    nodes = node_rows(spark, [{"id": "c", "type": "Claim", "text": "c"}, {"id": "e", "type": "Evidence", "text": "e"}])
    edges = edge_rows(spark, [("supports", "e", "c"), ("cites", "e", "zz"), ("cites", "c", "e")])
    log = spark.createDataFrame([("g", 1, None, "addNode", None, {"type": "Claim", "text": "new"}), ("g", 2, None, "editNode", "n4", {"text": "newer"})], LOG)
    graph = classify.classify(nodes, edges, durable=True)
    nodes_now, edges_now = MergedStage(graph, merged(graph), log).edited
    assert sorted(row["text"] for row in nodes_now.collect()) == ["c", "e", "newer"] and edges_now.count() == 3
    assert sorted(out for out, _ in numbered) == ["_k", "_k", "ord", "ord"]  # places of new records: for the log's names and for its replay
    assert not [plan for _, plan in numbered if "Join" in plan]
