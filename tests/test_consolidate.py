"""Judged merges: greedy claims, survivors, re-pointing and added relations."""

import random

from claimweave.operators import classify, consolidate, merge
from tests.conftest import edge_rows, node_rows

GROUPS = "graph_id string, group_no long, ids array<string>"
PROPOSED = "graph_id string, pos long, relation string, subject string, object string"


def claims(spark, texts, **extra):
    return node_rows(spark, [{"id": i, "type": "Claim", "text": t, **extra.get(i, {})} for i, t in texts.items()])


def graph_of(spark, nodes, edges=()):
    return classify.classify(nodes, edge_rows(spark, list(edges) or [("x", "y", "z")]), durable=True)


def test_rejected_groups_claim_nothing(spark):
    nodes = graph_of(spark, claims(spark, dict.fromkeys("abcd", "t"))).nodes
    groups = spark.createDataFrame(
        [("g", 0, ["a", "b"]), ("g", 1, ["b", "c"]), ("g", 2, ["c", "d"]), ("g", 3, ["a"]), ("g", 4, ["c", "zz"])], GROUPS
    )
    applied = consolidate.applied_groups(groups, nodes).select("group_no").distinct().collect()
    assert sorted(row[0] for row in applied) == [0, 2]


def test_claims_equal_a_sequential_pass(spark):
    rng = random.Random(3)
    ids = [f"n{i}" for i in range(30)]
    nodes = graph_of(spark, claims(spark, dict.fromkeys(ids, "t"))).nodes
    groups = [("g", k, rng.sample(ids, rng.randint(1, 4))) for k in range(60)]
    taken, expected = set(), []
    for _, k, members in groups:
        if len(members) > 1 and not taken & set(members):
            taken |= set(members)
            expected.append(k)
    applied = consolidate.applied_groups(spark.createDataFrame(groups, GROUPS), nodes)
    assert sorted(row[0] for row in applied.select("group_no").distinct().collect()) == expected


def test_fold_and_proposals(spark):
    nodes = claims(
        spark, {"a": "1", "b": "2", "c": "3"}, a={"description": "mm"}, b={"description": "longer", "anchor": "q"},
        c={"description": "longes"},
    )
    graph = graph_of(spark, nodes, [("supports", "a", "b", "lost"), ("supports", "a", "c"), ("supports", "b", "c", "kept?")])
    groups = spark.createDataFrame([("g", 0, ["b", "a"])], GROUPS)
    proposed = spark.createDataFrame(
        [
            ("g", 0, "supports", "b", "c"),  # exists once mapped
            ("g", 1, "opposes", "b", "c"),
            ("g", 2, "opposes", "a", "c"),  # the same once mapped
            ("g", 3, "supports", "a", "b"),  # self-loop once mapped
            ("g", 4, "addresses", "a", "c"),  # illegal
            ("g", 5, "supports", "c", "zz"),
        ],
        PROPOSED,
    )
    out = consolidate.consolidate(graph.nodes, graph.edges, groups, proposed)
    kept = {row["id"]: row for row in out["nodes"].collect()}
    assert set(kept) == {"a", "c"}
    assert (kept["a"]["description"], kept["a"]["anchor"]) == ("longer", "q")
    edges = [(e["relation"], e["subject"], e["object"], e["anchor"], e["consolidated"]) for e in out["edges"].orderBy("ord").collect()]
    assert edges == [("supports", "a", "c", None, False), ("opposes", "a", "c", None, True)]
    assert out["stats"].drop("graph_id").first().asDict() == {
        "groups_applied": 1, "groups_rejected": 0, "records_folded": 1, "edges_added": 1, "proposed_rejected": 5,
        "edges_dropped_by_fold": 2,
    }


def test_empty_verdict_changes_nothing(spark):
    graph = graph_of(spark, claims(spark, {"a": "1", "b": "2"}), [("supports", "a", "b", "q")])
    out = consolidate.consolidate(
        graph.nodes, graph.edges, spark.createDataFrame([], GROUPS), spark.createDataFrame([], PROPOSED)
    )
    assert sorted(out["nodes"].select(*graph.nodes.columns).collect()) == sorted(graph.nodes.collect())
    assert out["edges"].select("relation", "subject", "object", "anchor").collect() == graph.edges.select(
        "relation", "subject", "object", "anchor"
    ).collect()


def test_pieces_share_one_namespace_and_fold_by_text(spark):
    from pyspark.sql import functions as F

    first = node_rows(spark, [{"id": "a", "type": "Claim", "text": "Same  text"}, {"id": "b", "type": "Claim", "text": "x"}], "p#0")
    second = node_rows(spark, [{"id": "a", "type": "Claim", "text": "same text", "description": "d"},
                               {"id": "b", "type": "Evidence", "text": "same text"}], "p#1")
    edges = edge_rows(spark, [("supports", "a", "b")], "p#0").unionByName(
        edge_rows(spark, [("supports", "b", "a"), ("supports", "a", "a")], "p#1")
    )
    graph = classify.classify(first.unionByName(second), edges, durable=True)
    part = F.split("graph_id", "#")
    nodes, links = merge.joined_pieces(graph.nodes, graph.edges, part[0], part[1].cast("bigint"))
    assert [row["id"] for row in nodes.orderBy("ord").collect()] == ["g0", "g1", "g2", "g3"]
    kept, repointed, folds = merge.fold_exact(nodes, links)
    assert [(r["id"], r["survivor"]) for r in folds.collect()] == [("g2", "g0")]
    assert {r["id"]: r["description"] for r in kept.collect()} == {"g0": "d", "g1": None, "g3": None}
    assert sorted((r["subject"], r["object"]) for r in repointed.collect()) == [("g0", "g0"), ("g0", "g1"), ("g3", "g0")]


def jobs_of(spark, work):
    tracker, group = spark.sparkContext.statusTracker(), "counted-jobs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def sequential(groups):
    taken, won = set(), []
    for _, k, members in sorted(groups, key=lambda g: g[1]):
        if not taken & set(members):
            taken |= set(members)
            won.append(k)
    return won


def test_a_long_chain_takes_a_bounded_number_of_jobs(spark):
    def applied(n):
        ids = [f"n{i}" for i in range(n + 1)]
        nodes = graph_of(spark, claims(spark, dict.fromkeys(ids, "t"))).nodes
        groups = [("g", k, [ids[k], ids[k + 1]]) for k in range(n)]
        out = []
        jobs = jobs_of(spark, lambda: out.extend(consolidate.applied_groups(spark.createDataFrame(groups, GROUPS), nodes).select("group_no").distinct().collect()))
        assert sorted(row[0] for row in out) == sequential(groups)
        return jobs

    assert applied(200) <= applied(4) + 2


def test_large_graphs_by_component_and_in_rounds(spark):
    """The same groups folded as one graph, by component, and with a component above the size."""
    rng = random.Random(6)
    ids = [f"n{i}" for i in range(120)]
    nodes = graph_of(spark, claims(spark, dict.fromkeys(ids, "t"))).nodes
    groups = [("g", k, rng.sample(ids[: 40 if k % 3 else 120], 2)) for k in range(70)]
    frame = spark.createDataFrame(groups, GROUPS)
    expected = sequential(groups)
    for rows in (1024, 100, 3):
        found = consolidate.applied_groups(frame, nodes, rows).select("group_no").distinct().collect()
        assert sorted(row[0] for row in found) == expected
