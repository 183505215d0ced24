"""Edit log replay and live validation."""

import random

from pyspark.sql import functions as F

from claimweave.operators import analytics, classify, edits
from claimweave.streaming import incremental
from tests.conftest import edge_rows, node_rows

LOG = "graph_id string, seq long, op string, target_id string, patch map<string,string>"


def graph_of(spark):
    nodes = node_rows(
        spark,
        [{"id": "c", "type": "Claim", "text": "c", "description": "d"}, {"id": "e", "type": "Evidence", "text": "e"},
         {"id": "q", "type": "Question", "text": "q"}],
    )
    edges = edge_rows(spark, [("supports", "e", "c"), ("cites", "e", "zz"), ("supports", "q", "zz"), ("addresses", "e", "q")])
    return classify.classify(nodes, edges, durable=True)


def test_replay_and_status(spark):
    log = spark.createDataFrame(
        [
            ("g", 1, "editNode", "c", {"text": "new", "description": None}),
            ("g", 2, "editNode", "c", {"text": "newer"}),
            ("g", 3, "editNode", "n5", {"text": "too early"}),  # n5 does not exist yet
            ("g", 4, "addNode", None, {"type": "Claim"}),
            ("g", 5, "addEdge", None, {"relation": "supports", "subject": "e", "object": "n5"}),
            ("g", 6, "dropNode", "q", {}),
            ("g", 7, "dropNode", "e", {}),
            ("g", 8, "restoreNode", "e", {}),
            ("g", 9, "editEdge", "x1", {"relation": "opposes", "object": "c"}),
            ("g", 10, "dropEdge", "x0", {}),
        ],
        LOG,
    )
    nodes, edges = edits.edited_graph(graph_of(spark), log)
    found = {row["id"]: row for row in nodes.collect()}
    assert (found["c"]["text"], found["c"]["description"]) == ("newer", None)
    assert (found["n5"]["text"], found["n5"]["type"], found["n5"]["added"]) == ("", "Claim", True)
    assert found["q"]["dropped"] and not found["e"]["dropped"]
    status = edits.edge_status(nodes, edges)
    reasons = {row["id"]: row["reason"] for row in status.collect()}
    # Staged order: accepted (x0), dangling (x1), ungrammatical (x2, x3); the shared counter goes on at 5.
    assert reasons == {
        "x1": "the subject end is gone",
        "x2": "the object end is gone",
        "x3": "the object end is gone",
        "e6": None,
    }
    gate = edits.publishable(nodes, status).first()
    assert (gate["live_nodes"], gate["nodes_needing_text"], gate["publishable"]) == (3, 1, False)
    kept, linked = edits.export_selection(nodes, status)
    assert {row["id"] for row in kept.collect()} == {"c", "e"}
    assert linked.where(F.col("object") == "n5").count() == 0


def test_connect_uses_rule_order(spark):
    graph = graph_of(spark)
    drawn = spark.createDataFrame(
        [("g", 1, "e", "c"), ("g", 2, "c", "c"), ("g", 3, "q", "c"), ("g", 4, "e", "zz")],
        "graph_id string, seq long, subject string, object string",
    )
    got = {row["seq"]: (row["relation"], row["notice"]) for row in edits.connect(drawn, graph.nodes).collect()}
    assert got == {1: ("supports", None), 3: (None, "nothing links Question to Claim")}


def test_folding_batches_equals_folding_the_log(spark):
    rng = random.Random(5)
    ops = ["editNode", "dropNode", "restoreNode", "editEdge"]
    rows = [
        ("g", seq, rng.choice(ops), f"n{rng.randint(0, 3)}", {rng.choice(["text", "type"]): rng.choice(["a", "b", None])})
        for seq in range(60)
    ]
    log = spark.createDataFrame(rows, LOG)
    whole = incremental.latest_patches(log)
    halves = incremental.latest_patches(log.where("seq < 25")).unionByName(incremental.latest_patches(log.where("seq >= 25")))
    assert sorted(map(str, whole.collect())) == sorted(map(str, incremental.fold_patches(halves).collect()))


def test_components_against_union_find(spark):
    rng = random.Random(9)
    ids = [f"n{i}" for i in range(60)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(45)] + [(f"n{i}", f"n{i + 1}") for i in range(20)]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    lowest = {}
    for i, name in enumerate(ids):
        lowest.setdefault(root(name), i)
    nodes = spark.createDataFrame([("g", name, i) for i, name in enumerate(ids)], "graph_id string, id string, ord long")
    edges = spark.createDataFrame([("g", a, b) for a, b in pairs], "graph_id string, subject string, object string")
    labels = analytics.component_labels(nodes, edges)
    assert {row["id"]: row["component"] for row in labels.collect()} == {name: lowest[root(name)] for name in ids}


def test_new_ids_keep_clear_of_records(spark):
    nodes = node_rows(spark, [{"id": "n2", "type": "Claim", "text": "two"}, {"id": "n40", "type": "Claim", "text": "forty"}, {"id": "q", "type": "Question", "text": "q"}])
    graph = classify.classify(nodes, edge_rows(spark, [("addresses", "n2", "q")]), durable=True)
    log = spark.createDataFrame([("g", 1, "addNode", None, {"type": "Claim", "text": "new"}), ("g", 2, "addEdge", None, {"relation": "supports", "subject": "n41", "object": "n2"})], LOG)
    now, edges = edits.edited_graph(graph, log)
    ids = [row["id"] for row in now.collect()]
    assert sorted(ids) == ["n2", "n40", "n41", "q"]
    status = edits.edge_status(now, edges).collect()
    assert {(row["id"], row["valid"]) for row in status} == {("x0", True), ("e42", True)} and len(status) == 2
