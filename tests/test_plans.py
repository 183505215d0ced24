"""Physical plans: pruned scans, no cross joins, no Python in the hot path, group limits below the shuffle."""

import re

import pytest

from claimweave.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
LAZY = [
    "route_papers", "sections", "chunks", "attempt_winners", "models_first_use", "cost_receipt", "reply_nodes",
    "node_verdicts", "edge_verdicts", "reject_top8", "legal_relations", "anchor_match", "source_index", "connect",
    "generation_facts", "reassembled", "progress_stalls", "run_results", "latest_patches",
]


def plan(spark, name):
    return catalog.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    assert not re.search(r"CartesianProduct|NestedLoopJoin|EvalPython|MapInPandas|FlatMapGroups", text)


def test_scans_read_only_what_is_used(spark):
    text = plan(spark, "edge_verdicts")
    orders = [line for line in text.splitlines() if "orders.parquet" in line]
    assert orders and all("o_totalprice" not in line and "o_orderdate" not in line for line in orders)
    nodes = plan(spark, "connect")
    assert all("n_chars" not in line for line in nodes.splitlines() if "documents.parquet" in line)


def test_listing_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "reject_top8")


def test_verdicts_need_no_window(spark):
    """First occurrences are combined aggregates, so no task sorts a whole graph or a reused id."""
    assert "Window [" not in plan(spark, "node_verdicts") + plan(spark, "edge_verdicts")


def test_the_report_reads_its_tables_once(spark, tmp_path):
    """Nodes and edges are counted under all their measures in one scan each."""
    from claimweave.operators import report

    tables = {}
    for name, schema in {"nodes": "graph_id string, type string, anchor string", "edges": "graph_id string, relation string, anchor string",
                         "stamps": "graph_id string, stamp string", "rejects": "graph_id string, kind string",
                         "judged": "graph_id string, copies bigint"}.items():
        path = str(tmp_path / name)
        spark.createDataFrame([], schema).write.parquet(path)
        tables[name] = spark.read.schema(schema).parquet(path)
    counted = report.measured(*tables.values()).groupBy("graph_id", "measure").sum("amount")
    text = counted._jdf.queryExecution().executedPlan().toString()
    for column in ("type:string", "relation:string", "stamp:string", "kind:string", "copies:bigint"):
        assert len(re.findall(rf"ReadSchema: struct<[^>]*{column}", text)) == 1


def test_folds_aggregate_positions_only(spark):
    """Whole rows and strings are not aggregated, which would sort them."""
    from claimweave.operators import consolidate, merge, project
    from tests.conftest import NODE_SCHEMA

    node = spark.createDataFrame([], NODE_SCHEMA + ", ord bigint, iri string, piece bigint")
    edge = spark.createDataFrame([], "graph_id string, ord bigint, relation string, subject string, object string, anchor string, consolidated boolean")
    members = spark.createDataFrame([], "graph_id string, group_no bigint, id string")
    info = spark.createDataFrame([], "graph_id string, title string, doi string")
    plans = {
        "M2": merge.text_folds(node), "Co3": consolidate.fold_map(members, node), "triples": merge.first_triples(edge, "anchor", "consolidated"),
        "J6": project.paper_documents(node, info), "J8": project.evidence_stamps(node, edge, project.paper_documents(node, info)),
    }
    for name, df in plans.items():
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString(), name


def test_triples_write_no_table_of_objects(spark, monkeypatch):
    from claimweave.plans import build

    names = []
    real = build.settle
    monkeypatch.setattr(build, "settle", lambda df, name: names.append(name) or real(df, name))
    found = catalog.queries()["triple_counts"](spark, "/root/testdata/sf0.001")
    assert "relation-objects" in names and "objects" not in names
    assert found.count() > 0
