"""Edits of a classified graph carried over to the merged one, and where merged records come from."""

from claimweave.operators import classify, merge
from claimweave.plans.build import MergedStage, merged
from pyspark.sql import functions as F

from tests.conftest import edge_rows, node_rows

LOG = "graph_id string, seq long, ts timestamp, op string, target_id string, patch map<string,string>"


def test_edits_of_folded_records_change_the_survivor(spark):
    nodes = node_rows(
        spark,
        [{"id": "c", "type": "Claim", "text": "Same  text"}, {"id": "d", "type": "Claim", "text": "same text"},
         {"id": "e", "type": "Evidence", "text": "e"}, {"id": "n9", "type": "Question", "text": "q"}],
    )
    edges = edge_rows(spark, [("supports", "e", "c"), ("supports", "e", "d"), ("cites", "d", "zz"), ("opposes", "e", "d"), ("cites", "c", "g1"), ("cites", "e", "g1")])
    graph = classify.classify(nodes, edges, durable=True)
    log = spark.createDataFrame(
        [
            ("g", 1, None, "editNode", "d", {"description": "on the folded one"}),
            ("g", 2, None, "editEdge", "x1", {"relation": "opposes"}),  # folded into x0
            ("g", 3, None, "addNode", None, {"type": "Claim", "text": "new"}),  # n10 there, n4 here
            ("g", 4, None, "addEdge", None, {"relation": "opposes", "subject": "e", "object": "n10"}),
            ("g", 5, None, "editNode", "n10", {"text": "newer"}),
            ("g", 6, None, "dropEdge", "e11", {}),
            ("g", 7, None, "editEdge", "x4", {"object": "d"}),
            ("g", 8, None, "editNode", "unknown", {"text": "nothing"}),
            ("g", 9, None, "dropNode", "n9", {}),
        ],
        LOG,
    )
    stage = MergedStage(graph, merged(graph), log)
    nodes_now, edges_now = stage.edited
    found = {row["id"]: row for row in nodes_now.collect()}
    assert set(found) == {"g0", "g2", "g3", "n6"}
    assert (found["g0"]["description"], found["g3"]["dropped"], found["n6"]["text"]) == ("on the folded one", True, "newer")
    rows = {row["id"]: row for row in edges_now.collect()}
    assert {i: (r["relation"], r["subject"], r["object"]) for i, r in rows.items()} == {
        "x0": ("opposes", "g2", "g0"), "x1": ("opposes", "g2", "g0"), "x2": ("cites", "g0", "zz"), "x3": ("cites", "g0", "g0"),
        "x4": ("cites", "g2", "?g1"), "e7": ("opposes", "g2", "n6"),
    }
    assert [i for i, r in rows.items() if r["dropped"]] == ["e7"]


def test_lineage_of_pieces(spark):
    texts = [["a", "b"], ["A ", "c"], ["a", "a"]]
    nodes = None
    for piece, own in enumerate(texts):
        rows = node_rows(spark, [{"id": f"k{i}", "type": "Claim", "text": t} for i, t in enumerate(own)], f"p#{piece}")
        nodes = rows if nodes is None else nodes.unionByName(rows)
    graph = classify.classify(nodes, edge_rows(spark, [("supports", "x", "y")], "p#0"), durable=True)
    part = F.split("graph_id", "#")
    joined, _ = merge.joined_pieces(graph.nodes, graph.edges, part[0], part[1].cast("bigint"))
    found = {(r["id"], r["piece"]): r["records"] for r in merge.piece_lineage(joined, merge.text_folds(joined)).collect()}
    assert found == {("g0", 0): 1, ("g0", 1): 1, ("g0", 2): 2, ("g1", 0): 1, ("g3", 1): 1}
