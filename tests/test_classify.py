"""Admission rules and their order."""

from claimweave.operators import classify, replies
from tests.conftest import edge_rows, node_rows


def whys(df, key="pos"):
    return {row[key]: row["why"] for row in df.collect()}


def test_node_reasons_in_order(spark):
    raw = node_rows(
        spark,
        [
            {"id": " ", "type": "Nope", "text": ""},
            {"id": "a", "type": "Nope", "text": " "},
            {"id": "a", "type": "Nope", "text": "x"},
            {"id": " a ", "type": "Claim", "text": "x"},
            {"id": "a", "type": "Claim", "text": "y"},
        ],
    )
    assert whys(classify.judge_nodes(raw)) == {
        0: "missing id",
        1: "missing text",
        2: 'invalid type "Nope"',
        3: None,  # rejected records do not reserve the id
        4: 'duplicate id "a"',
    }


def test_edge_verdicts(spark):
    nodes = node_rows(spark, [{"id": "c", "type": "Claim", "text": "c"}, {"id": "e", "type": "Evidence", "text": "e"}])
    edges = edge_rows(
        spark,
        [
            ("cites", "zz", "c"),  # unknown relation is reported before unresolved ends
            ("supports", "e", "zz"),
            ("supports", "c", "e"),
            ("supports", "e", "c", '"first"'),
            ("supports", " e", "c", "second"),
            ("supports", "c", "c"),
            ("constructor", "c", "c"),
        ],
    )
    graph = classify.classify(nodes, edges, durable=True)
    judged = {row["pos"]: row["verdict"] for row in classify.mark_folded(edges, graph.judged_edges).collect()}
    assert judged == {
        0: "ungrammatical", 1: "dangling", 2: "ungrammatical", 3: "ok", 4: "folded", 5: "ok", 6: "ungrammatical",
    }
    reasons = whys(graph.judged_edges)
    assert reasons[2] == "supports wants Evidence|Claim→Claim, got Claim→Evidence"
    assert reasons[0] == 'unknown relation "cites"'
    kept = {row["ord"]: row["anchor"] for row in graph.edges.collect()}
    assert kept == {3: "first", 5: None}


def test_every_record_is_accounted_for(spark):
    nodes = node_rows(spark, [{"id": f"n{i % 3}", "type": "Claim", "text": "t"} for i in range(7)])
    edges = edge_rows(spark, [("supports", f"n{i % 3}", f"n{i % 4}") for i in range(20)])
    graph = classify.classify(nodes, edges, durable=True)
    judged = graph.judged_edges.collect()
    assert sum(row["copies"] + 1 for row in judged) == 20
    assert graph.nodes.count() + graph.judged_nodes.where("why is not null").count() == 7
    assert graph.rejects.count() == 4 + sum(row["verdict"] != "ok" for row in judged)


def test_classification_is_idempotent(spark):
    nodes = node_rows(spark, [{"id": "c", "type": "Claim", "text": " c ", "anchor": '"q"', "doi": "d"},
                              {"id": "s", "type": "SourceDocument", "text": "s", "doi": " 10.1/x "}])
    edges = edge_rows(spark, [("supports", "c", "c", "“a”")])
    once = classify.classify(nodes, edges)
    again = classify.classify(
        once.nodes.drop("ord"), once.edges.withColumnRenamed("ord", "pos").drop("consolidated")
    )
    assert sorted(once.nodes.collect()) == sorted(again.nodes.collect())
    assert once.edges.collect() == again.edges.collect()
    assert [row["doi"] for row in once.nodes.orderBy("pos").collect()] == [None, "10.1/x"]


def test_untyped_records_from_a_reply(spark):
    content = '{"nodes":[{"id":"a","type":"Claim","text":5},null,7,{"id":"b","type":"Claim","text":"t"}],"edges":[{"relation":1}]}'
    parsed = replies.parse_graphs(spark.createDataFrame([("g", content)], "graph_id string, content string"))
    graph = classify.classify(replies.raw_nodes(parsed), replies.raw_edges(parsed))
    assert whys(graph.judged_nodes) == {0: "missing text", 1: "missing id", 2: "missing id", 3: None}
    assert whys(graph.judged_edges) == {0: 'unknown relation ""'}


def test_reject_listing_shows_the_first_and_the_total(spark):
    nodes = node_rows(spark, [{"id": "", "type": "Claim", "text": "t"}] * 11)
    graph = classify.classify(nodes, edge_rows(spark, [("x", "y", "z")]))
    listed = classify.capped_rejects(graph.rejects).where("kind = 'node'").orderBy("rank").collect()
    assert [row["pos"] for row in listed] == list(range(8))
    assert {row["total"] for row in listed} == {11}
