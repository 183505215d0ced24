"""One literal paper through classification, projection, documents and checks."""

import json

import pytest
from pyspark.sql import functions as F

from claimweave.operators import classify, conform, project
from claimweave.plans.build import merged, projection_of
from tests.conftest import edge_rows, node_rows

STAMP = "2031-05-17T08:30:00.000Z"
NAMING = project.Naming(generated_at=STAMP, creator="swift desk")
OWN, ATLAS = "https://doi.org/10.4321/swift.7", "https://birds.example/atlas"

NODES = [
    {"id": "own", "type": "SourceDocument", "text": "Ringing swifts in city towers", "doi": "doi:10.4321/swift.7"},
    {"id": "atlas", "type": "SourceDocument", "text": "Atlas of urban birds", "url": ATLAS},
    {"id": "where", "type": "Question", "text": "Which towers should get boxes first?"},
    {"id": "counts", "type": "Study", "text": "Two summers of counts on nine towers", "anchor": "nine towers, two summers"},
    {"id": "dusk", "type": "Protocol", "text": "Watch each box for an hour at dusk"},
    {"id": "broods", "type": "Evidence", "text": "North boxes held twice the broods", "description": "Counted per box.", "anchor": "twice the broods"},
    {"id": "hot", "type": "Evidence", "text": "South boxes passed 40 degrees"},
    {"id": "cool", "type": "Claim", "text": "Swifts prefer cool boxes", "anchor": "they prefer the cool side"},
    {"id": "high", "type": "Claim", "text": "Swifts pick boxes by height", "anchor": "height was thought to decide"},
    {"id": "noise", "type": "Claim", "text": "Street noise drives swifts off"},
    {"id": "log", "type": "Request", "text": "Log the temperature of all boxes", "anchor": "loggers are wanted"},
    {"id": "ring", "type": "Request", "text": "Ring the adults as well"},
]
EDGES = [
    ("request_for", "log", "counts"),
    ("describesActivity", "atlas", "counts"),
    ("describesActivity", "own", "counts", "as this paper reports"),
    ("grounds", "counts", "broods"),
    ("opposes", "cool", "high", "not height but shade"),
    ("opposes", "hot", "noise"),
    ("supports", "broods", "cool", "so they choose the cool side"),
    ("addresses", "cool", "where"),
    ("request_target", "ring", "noise"),
    ("follows", "counts", "dusk"),
    ("supports", "high", "noise"),
]
PAPERS = "graph_id string, title string, doi string, license string, authors array<struct<name: string, orcid: string>>"
AUTHORS = [("Nadia Oke", None), ("Tom Vael", "0000-0009-8765-4321"), ("R. Im", None)]


@pytest.fixture(scope="module")
def golden(spark):
    graph = classify.classify(node_rows(spark, NODES), edge_rows(spark, EDGES), durable=True)
    papers = spark.createDataFrame([("g", "Ringing swifts in city towers", " doi:10.4321/SWIFT.7", "MIT", AUTHORS)], PAPERS)
    return graph, projection_of(graph, papers, NAMING, durable=True)


@pytest.fixture(scope="module")
def document(golden):
    _, projection = golden
    parts = project.document_text(projection.documents()).orderBy("part").collect()
    assert len(parts) == 1
    return json.loads(parts[0]["jsonld"])


def test_input_classifies_clean(golden):
    graph, _ = golden
    assert graph.rejects.count() == 0
    assert [row["id"] for row in graph.nodes.orderBy("ord").collect()] == [n["id"] for n in NODES]


def test_object_counts_and_order(document):
    objects = document["@graph"]
    kinds = [o["@type"] if isinstance(o["@type"], str) else o["@type"][-1] for o in objects]
    anchored = sum("anchor" in n for n in NODES) + sum(len(e) == 4 for e in EDGES)
    assert kinds == (
        ["UserAccount"] * 4 + ["NodeSchema"] * 7 + ["AbstractRelationDef"] * 8 + ["Container"] + ["Item"] * anchored
        + [n["type"] for n in NODES] + ["RelationInstance"] * len(EDGES)
    )
    assert [o["@id"] for o in objects[-len(EDGES) :]] == [f"x:r{i}" for i in range(len(EDGES))]
    assert [o["@id"] for o in objects[1:4]] == ["x:author-0", "https://orcid.org/0000-0009-8765-4321", "x:author-2"]
    assert document["@context"] == [NAMING.context_iri, {"x": NAMING.base_prefix + "g:"}]


def by_id(document):
    return {o["@id"]: o for o in document["@graph"]}


def test_node_objects(document):
    objects = by_id(document)
    assert objects["x:n8"] == {
        "@id": "x:n8", "@type": ["x:_schema_Claim", "Claim"], "title": NODES[8]["text"], "content": NODES[8]["text"],
        "created": STAMP, "modified": STAMP, "creator": "x:agent", "description": "x:a-n8",
    }
    assert objects["x:n5"]["content"] == "North boxes held twice the broods\n\nCounted per box."
    # The first source of the grounding study; the paper itself where no study grounds the evidence.
    assert (objects["x:n5"]["sourceDocument"], objects["x:n6"]["sourceDocument"]) == (ATLAS, OWN)
    assert objects[OWN]["creator"] == ["x:author-0", "https://orcid.org/0000-0009-8765-4321", "x:author-2"]
    assert objects[ATLAS]["creator"] == "x:agent"
    assert objects["x:r4"]["title"] == "Swifts prefer cool boxes -opposes-> Swifts pick boxes by height"
    assert (objects["x:r4"]["description"], "description" in objects["x:r0"]) == ("x:a-r4", False)


def test_stamps_and_notes(golden):
    _, projection = golden
    stamps = {row["id"]: row["stamp"] for row in projection.stamps.collect()}
    assert stamps == {"broods": "spine", "hot": "paper"}
    notes = project.omission_notes(projection.papers, projection.stamps, projection.paper_docs).collect()
    assert [(n["note"], n["detail"]) for n in notes] == [(project.LICENSE_NOTE, "MIT")]


@pytest.mark.parametrize("limits", [{"width": 5}, {"part_bytes": 600}, {"width": 7, "part_bytes": 300}])
def test_parts_make_the_same_document_and_are_read_back_whole(golden, document, limits):
    _, projection = golden
    docs = projection.documents(**limits)
    parts = project.document_text(docs).orderBy("part").collect()
    assert len(parts) > 5
    assert json.loads("".join(row["jsonld"] for row in parts)) == document
    assert [row["part"] for row in parts] == list(range(len(parts)))

    def read(these):
        objects, contexts = conform.read_parts(these, NAMING.context_iri, "file:local.jsonld")
        return sorted(r[0] for r in objects.select(F.to_json("obj")).collect()), [r["context"] for r in contexts.collect()]

    objects, contexts = read(docs)
    assert (objects, contexts) == read(projection.documents())
    assert len(objects) == len(document["@graph"])
    assert json.loads(contexts[0]) == ["file:local.jsonld", {"x": NAMING.base_prefix + "g:"}]


def test_emitted_document_conforms(golden):
    _, projection = golden
    rows = conform.triples_of(conform.objects_of(projection.documents()))
    judged = conform.partition_quirks(conform.violations(rows))
    verdict = conform.conformance(rows, judged).first()
    assert (verdict["verdict"], verdict["real"], verdict["known"]) == ("CONFORMS modulo quirks", 0, 2 * len(EDGES) + 2)


def test_each_rule_has_a_failing_case(spark):
    objects = [
        {"@id": "x:n0", "@type": ["x:_schema_Claim", "Claim"], "supports": "x:n1"},
        {"@id": "x:n1", "@type": ["x:_schema_Claim", "Claim"], "description": "x:nope", "sourceDocument": "x:n0"},
        {"@id": "x:a", "@type": "Item", "has_container": "x:n0"},
        {"@id": "x:r0", "@type": ["supports", "RelationInstance"], "source": "x:n0", "destination": "x:gone", "predicate": "p"},
    ]
    body = ",".join(json.dumps(o) for o in objects)
    docs = spark.createDataFrame([("g", body)], "graph_id string, body string")
    rows = conform.triples_of(conform.objects_of(docs))
    judged = conform.partition_quirks(conform.violations(rows))
    spelled = conform.spelled_out(judged.where("not known"), rows)
    real = {(v["component"], v["path"], v["focus"]) for v in spelled.collect()}
    assert real == {
        ("ClosedConstraintComponent", "supports", "x:n0"),
        ("ClassConstraintComponent", "description", "x:n1"),
        ("ClosedConstraintComponent", "sourceDocument", "x:n1"),
        ("ClassConstraintComponent", "has_container", "x:a"),
        ("ClassConstraintComponent", "destination", "x:r0"),
        ("ClosedConstraintComponent", "predicate", "x:r0"),
    }
    assert conform.conformance(rows, judged).first()["verdict"] == "DOES NOT CONFORM"
    assert conform.shown_violations(judged, rows, limit=2).count() == 2


def test_triples_are_told_apart_by_digests(spark, golden):
    """Texts stay where they are written: what is moved to make triples distinct has none."""
    _, projection = golden
    texts = conform.occurrences(conform.objects_of(projection.documents()))
    rows = conform.encoded(texts)
    plain = texts.distinct()
    assert rows.rows.count() == plain.count() < texts.union(texts).count()
    stored = rows.terms.inputFiles()[0].rpartition("/")[0]
    plan = conform.once(spark.read.parquet(stored))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "value" not in plan and "subject" not in plan
    back = rows.rows.join(rows.terms.dropDuplicates(["term"]).toDF("s", "subject"), "s").select("graph_id", "subject", "p")
    assert sorted(map(tuple, back.distinct().collect())) == sorted(map(tuple, plain.select("graph_id", "s", "p").distinct().collect()))
    without = conform.occurrences(conform.objects_of(projection.documents()), mixins=False)
    assert without.where("o = 'NodeSchema'").count() < texts.where("o = 'NodeSchema'").count()


def test_quirks_are_told_by_their_whole_address(spark):
    spaces = conform.Namespaces(base="http://a/base#", own="http://a/own#")
    paths = {
        "base:source": True, "<http://a/base#destination>": True, "source": True, "own:sourceDocument": True,
        "own:source": False, "<http://a/other#source>": False, "http://a/base#sourceDocument": False, "title": False,
    }
    rows = spark.createDataFrame(
        [("g", "InConstraintComponent", path, "f", "v") for path in paths] + [("g", "ClosedConstraintComponent", "source", "c", "v")],
        "graph_id string, component string, path string, focus string, value string",
    )
    known = {(row["path"], row["focus"]): row["known"] for row in conform.partition_quirks(rows, spaces).collect()}
    assert known == {(path, "f"): value for path, value in paths.items()} | {("source", "c"): False}


def test_contexts_are_swapped_by_whole_members(spark, document):
    inline = {"p": NAMING.context_iri, "q": [NAMING.context_iri]}
    cases = {
        "list": (document["@context"], ["file:l", document["@context"][1]]),
        "alone": (NAMING.context_iri, "file:l"),
        "inline": (inline, inline),
        "mixed": ([inline, NAMING.context_iri], [inline, "file:l"]),
    }
    rows = [(name, json.dumps({"@context": given, "@graph": document["@graph"]})) for name, (given, _) in cases.items()]
    objects, contexts = conform.read_documents(spark.createDataFrame(rows, "graph_id string, jsonld string"), NAMING.context_iri, "file:l")
    assert objects.count() == len(cases) * len(document["@graph"])
    assert {r["graph_id"]: json.loads(r["context"]) for r in contexts.collect()} == {name: wanted for name, (_, wanted) in cases.items()}


def test_title_match_yields_to_a_later_doi_match(spark):
    sources = [
        {"id": "a", "type": "SourceDocument", "text": "Swift  towers"},
        {"id": "b", "type": "SourceDocument", "text": "Another", "doi": "10.4321/other"},
    ]
    graph = classify.classify(node_rows(spark, sources), edge_rows(spark, []), durable=True)
    papers = spark.createDataFrame([("g", "swift TOWERS", "10.4321/other", None, [])], PAPERS)
    found = project.paper_documents(project.minted_nodes(graph.nodes), papers).first()
    assert (found["paper_source"], found["matched_by"]) == ("b", "doi")


def test_account_names_are_clipped(spark):
    papers = spark.createDataFrame([("g", None, None, None, [("n" * 300, None)])], PAPERS)
    rows = project.accounts(papers.select("graph_id"), papers, NAMING).where(F.col("ord") == 1).first()
    assert len(rows["account_name"]) == 256


def test_the_build_folds_equal_records(spark):
    nodes = [
        {"id": "n2", "type": "Claim", "text": "Cool boxes win"},
        {"id": "x", "type": "Evidence", "text": "Counts"},
        {"id": "n5", "type": "Claim", "text": "cool  BOXES win", "description": "Said again.", "anchor": "they win"},
        {"id": "n7", "type": "Question", "text": "Cool boxes win"},
    ]
    edges = [("supports", "x", "n5"), ("supports", "x", "n2", "first"), ("addresses", "n5", "n7")]
    whole = merged(classify.classify(node_rows(spark, nodes), edge_rows(spark, edges), durable=True))
    got = [tuple(r) for r in whole.nodes.select("ord", "id", "type", "description", "anchor").orderBy("ord").collect()]
    assert got == [(0, "g0", "Claim", "Said again.", "they win"), (1, "g1", "Evidence", None, None), (2, "g3", "Question", None, None)]
    links = {(r["relation"], r["subject"], r["object"]) for r in whole.edges.collect()}
    assert links == {("supports", "g1", "g0"), ("addresses", "g0", "g3")}
