"""Checking emitted objects with rule joins over their triples.

The published shape file is not available here, so the rules cover what its users document: typed relation ends,
closed key sets, grounding items inside a container, and source stamps on evidence only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions.replies import is_array, member, strict_json
from claimweave.session import settle
from claimweave.vocab import NODE_CLASSES, RELATIONS

# ---- fixed values: keys allowed on each kind of object ----

NODE_KEYS = ["@id", "@type", "title", "content", "created", "modified", "creator", "description"]
ALLOWED_KEYS = {
    "UserAccount": ["@id", "@type", "accountName"],
    "NodeSchema": ["@id", "@type", "subClassOf", "label", "created", "modified", "creator"],
    "AbstractRelationDef": ["@id", "@type", "subClassOf", "label", "created", "modified", "creator"],
    "Container": ["@id", "@type"],
    "Item": ["@id", "@type", "format", "content", "has_container"],
    "Question": NODE_KEYS,
    "Claim": NODE_KEYS,
    "Evidence": NODE_KEYS + ["sourceDocument"],
    "Study": NODE_KEYS,
    "Protocol": NODE_KEYS,
    "SourceDocument": NODE_KEYS,
    "Request": NODE_KEYS,
    "RelationInstance": NODE_KEYS[:3] + NODE_KEYS[4:] + ["source", "destination"],
}

# Constraints that the published shapes break by construction: component, namespace (base or own), term.
KNOWN_QUIRKS = [
    ("InConstraintComponent", "base", "source"),
    ("InConstraintComponent", "base", "destination"),
    ("InConstraintComponent", "own", "sourceDocument"),
]

# ---- end of fixed values ----

#: Ids of the objects that stand for the schema itself.
SCHEMA_PREFIX = "x:_schema_"


@dataclass(frozen=True)
class Namespaces:
    """Addresses of the two published vocabularies; set them to those of the shapes in use."""

    base: str = "https://example.org/base#"
    own: str = "https://example.org/discourse#"

    def full(self, path: Column) -> Column:
        """The whole address of a path: ``<address>``, ``prefix:term`` with the prefixes base and own, or one of the emitted terms."""
        bare = F.regexp_replace(path, "^<|>$", "")
        terms = {term: getattr(self, space) + term for _, space, term in KNOWN_QUIRKS}
        out = F.when(bare.startswith("base:"), F.concat(F.lit(self.base), F.substring(bare, 6, 1 << 30))).when(
            bare.startswith("own:"), F.concat(F.lit(self.own), F.substring(bare, 5, 1 << 30))
        )
        for term, address in terms.items():
            out = out.when(bare == term, F.lit(address))
        return out.otherwise(bare)

RELATION_NAMES = [name for name, _, _ in RELATIONS]


def objects_of(docs: DataFrame) -> DataFrame:
    """``(graph_id, obj VARIANT)`` from document parts."""
    parsed = docs.select("graph_id", F.try_parse_json(F.concat(F.lit("["), "body", F.lit("]"))).alias("_objects"))
    return explode_variant(parsed, "_objects", "graph_id").select("graph_id", F.col("value").alias("obj"))


def explode_variant(df: DataFrame, column: str, *kept: str) -> DataFrame:
    """``kept`` columns plus ``pos, key, value`` of every element or member of a variant column."""
    return df.select(*kept, column).lateralJoin(df.sparkSession.tvf.variant_explode(F.col(column).outer())).drop(column)


@dataclass(frozen=True)
class Triples:
    """Triples of dictionary-encoded terms.

    ``rows(graph_id, s, p, o, of_schema)``, each once in its graph; ``s`` and ``o`` are 64-bit digests, compared within a graph,
    and ``of_schema`` tells subjects of the schema itself. ``terms(term, text)`` has the texts as often as they occur, from
    the stored occurrences: no text is moved to tell triples apart.
    """

    rows: DataFrame
    terms: DataFrame


def term(text: Column) -> Column:
    return F.when(text.isNotNull(), F.xxhash64(text))


def occurrences(objects: DataFrame, mixins: bool = True) -> DataFrame:
    """``(graph_id, s, p, o)`` texts, one row per value as it stands; ``objects(graph_id, obj VARIANT)``.

    Terms stay in their compact form since the context file is not part of the data. With ``mixins`` a class implies the
    schema type for every node and relation instance, and for nothing else.
    """
    keyed = objects.select("graph_id", F.variant_get("obj", '$["@id"]', "string").alias("s"), "obj")
    pairs = explode_variant(keyed, "obj", "graph_id", "s").where(F.col("key") != "@id")
    many = is_array(F.col("value"))
    values = F.when(many, F.try_variant_get("value", "$", "array<string>")).otherwise(
        F.array(F.try_variant_get("value", "$", "string"))
    )
    if mixins:
        mixes = (F.col("key") == "@type") & F.arrays_overlap(values, F.array(*[F.lit(name) for name in NODE_CLASSES + ["RelationInstance"]]))
        values = F.when(mixes, F.array_append(values, "NodeSchema")).otherwise(values)
    return pairs.select("graph_id", "s", F.col("key").alias("p"), F.explode(values).alias("o"))


def encoded(texts: DataFrame) -> Triples:
    """Occurrences ``(graph_id, s, p, o)`` as encoded triples; the occurrences are written once, texts beside digests."""
    stored = settle(
        texts.select(
            "graph_id", term(F.col("s")).alias("s"), "p", term(F.col("o")).alias("o"),
            F.coalesce(F.col("s").startswith(SCHEMA_PREFIX), F.lit(False)).alias("of_schema"),
            F.col("s").alias("subject"), F.col("o").alias("value"),
        ),
        "triple-occurrences",
    )
    terms = stored.select(F.col("s").alias("term"), F.col("subject").alias("text")).unionByName(
        stored.select(F.col("o").alias("term"), F.col("value").alias("text"))
    )
    return Triples(settle(once(stored), "triples"), terms.where(F.col("term").isNotNull()))


def once(stored: DataFrame) -> DataFrame:
    """Each triple once in its graph; only digests are moved."""
    return stored.select("graph_id", "s", "p", "o", "of_schema").distinct()


def triples_of(objects: DataFrame) -> Triples:
    return encoded(occurrences(objects))


def allowed_pairs(spark: SparkSession) -> DataFrame:
    """``(kind, p)`` pairs of the closed key sets (under a hundred rows), the kind as a term."""
    rows = ", ".join(f"('{kind}', '{key}')" for kind, keys in ALLOWED_KEYS.items() for key in keys)
    return F.broadcast(spark.sql(f"select * from values {rows} as allowed(kind, p)").withColumn("kind", term(F.col("kind"))))


def violations(triples: Triples) -> DataFrame:
    """``(graph_id, component, path, focus, value)`` for each broken rule; focus and value are terms."""
    rows = triples.rows
    types = rows.where(F.col("p") == "@type").select("graph_id", F.col("s").alias("node"), F.col("o").alias("kind"), "of_schema")

    def points_to(path: str, kind: str) -> DataFrame:
        """Values of ``path`` that are not an object of class ``kind`` in the same graph."""
        targets = types.where(F.col("kind") == term(F.lit(kind))).select("graph_id", F.col("node").alias("o"))
        return broken(
            rows.where(F.col("p") == path).join(targets, ["graph_id", "o"], "left_anti"),
            "ClassConstraintComponent",
        )

    def broken(rows: DataFrame, component: str) -> DataFrame:
        return rows.select(
            "graph_id",
            F.lit(component).alias("component"),
            F.col("p").alias("path"),
            F.col("s").alias("focus"),
            F.col("o").alias("value"),
        )

    # Closed key sets: a subject is judged by its own kinds, where the schema type added by the mixin says nothing.
    known = [term(F.lit(kind)) for kind in ALLOWED_KEYS]
    kinds = types.where(F.col("kind").isin(*known) & ((F.col("kind") != term(F.lit("NodeSchema"))) | F.col("of_schema")))
    stray = (
        rows.join(kinds.select("graph_id", F.col("node").alias("s"), "kind"), ["graph_id", "s"])
        .join(allowed_pairs(rows.sparkSession), ["kind", "p"], "left_anti")
    )
    always = ["source", "destination", "sourceDocument"]
    in_lists = broken(rows.where(F.col("p").isin(always)), "InConstraintComponent")
    return (
        points_to("source", "NodeSchema")
        .unionByName(points_to("destination", "NodeSchema"))
        .unionByName(points_to("description", "Item"))
        .unionByName(points_to("has_container", "Container"))
        .unionByName(broken(stray, "ClosedConstraintComponent"))
        .unionByName(in_lists)
    )


def spelled_out(judged: DataFrame, triples: Triples) -> DataFrame:
    """Violations with the texts of focus and value; only the texts of their terms are fetched."""
    wanted = judged.select(F.explode(F.array("focus", "value")).alias("term")).where(F.col("term").isNotNull()).distinct()
    texts = settle(triples.terms.join(wanted, "term", "left_semi").dropDuplicates(["term"]), "violation-terms")
    out = judged
    for name in ("focus", "value"):
        own = texts.select(F.col("term").alias(name), F.col("text").alias(f"_{name}"))
        out = out.join(own, name, "left").drop(name).withColumnRenamed(f"_{name}", name)
    return out


def partition_quirks(violation_rows: DataFrame, namespaces: Namespaces = Namespaces()) -> DataFrame:
    """Add ``known``: the violation is one of the published shapes' own artefacts. Whole addresses are compared."""
    full = namespaces.full(F.col("path"))
    known = F.lit(False)
    for component, space, term in KNOWN_QUIRKS:
        known = known | ((F.col("component") == component) & (full == getattr(namespaces, space) + term))
    return violation_rows.withColumn("known", F.coalesce(known, F.lit(False)))


def conformance(triples: Triples, judged: DataFrame) -> DataFrame:
    """One verdict per graph: CONFORMS, CONFORMS modulo quirks, or DOES NOT CONFORM, with the counts."""
    sizes = triples.rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias("triples"))
    counts = judged.groupBy("graph_id").agg(
        F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("real")
    )
    known, real = F.coalesce("known", F.lit(0)), F.coalesce("real", F.lit(0))
    verdict = (
        F.when(real > 0, "DOES NOT CONFORM").when(known > 0, "CONFORMS modulo quirks").otherwise("CONFORMS")
    )
    return sizes.join(counts, "graph_id", "left").select(
        "graph_id", "triples", known.alias("known"), real.alias("real"), verdict.alias("verdict")
    )


def shown_violations(judged: DataFrame, triples: Triples, limit: int = 20) -> DataFrame:
    """The first ``limit`` real violations per graph, spelled out; the rank is limited map-side."""
    order = Window.partitionBy("graph_id").orderBy("component", "path", "focus", "value")
    return spelled_out(judged.where(~F.col("known")), triples).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _local_context(context: Column, published: str, local: str) -> Column:
    """Context JSON with the published address, alone or as a member of a list, replaced; inline contexts stay as they are."""
    quoted = F.to_json(F.array(F.lit(published))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(published)))) - 2)
    swap = lambda text: F.when(text == quoted, F.to_json(F.array(F.lit(local))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(local)))) - 2)).otherwise(text)
    members = F.try_variant_get(context, "$", "array<variant>")
    listed = F.concat(F.lit("["), F.array_join(F.transform(members, lambda m: swap(F.to_json(m))), ","), F.lit("]"))
    return F.when(is_array(context), listed).otherwise(swap(F.to_json(context)))


def read_parts(docs: DataFrame, published: str, local: str) -> tuple[DataFrame, DataFrame]:
    """Objects and contexts of documents in any number of parts, ``docs(graph_id, part, context, body)``.

    Returns ``(graph_id, obj VARIANT)`` and ``(graph_id, context)``, where the published context address is replaced by the local copy.
    """
    first = docs.where(F.col("part") == 0).select("graph_id", F.try_parse_json("context").alias("_context"))
    return objects_of(docs), first.select("graph_id", _local_context(F.col("_context"), published, local).alias("context"))


def read_documents(texts: DataFrame, published: str, local: str) -> tuple[DataFrame, DataFrame]:
    """As ``read_parts``, from whole documents ``texts(graph_id, jsonld)``."""
    parsed = texts.select("graph_id", strict_json(F.col("jsonld")).alias("_doc"))
    contexts = parsed.select("graph_id", _local_context(member(F.col("_doc"), "@context"), published, local).alias("context"))
    listed = parsed.select("graph_id", member(F.col("_doc"), "@graph").alias("_graph"))
    objects = explode_variant(listed, "_graph", "graph_id").select("graph_id", F.col("value").alias("obj"))
    return objects, contexts
