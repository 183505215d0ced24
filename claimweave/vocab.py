"""Closed vocabularies and limits of the discourse graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: node classes, relations with their legal ends, limits ----

NODE_CLASSES = ["Question", "Claim", "Evidence", "Study", "Protocol", "SourceDocument", "Request"]

# relation, subject classes, object classes
RELATIONS = [
    ("addresses", ["Claim"], ["Question"]),
    ("supports", ["Evidence", "Claim"], ["Claim"]),
    ("opposes", ["Evidence", "Claim"], ["Claim"]),
    ("describesActivity", ["SourceDocument"], ["Study"]),
    ("grounds", ["Study"], ["Evidence"]),
    ("follows", ["Study"], ["Protocol"]),
    ("request_for", ["Request"], ["Study"]),
    ("request_target", ["Request"], ["Claim"]),
]

MERGEABLE_CLASSES = ["Claim", "Question", "Evidence"]

ACCEPTED_EXTENSIONS = [".pdf", ".txt", ".md"]

SINGLE_CALL_LIMIT = 400_000
PIECE_BUDGET = 350_000
PIECE_OVERLAP = 600
ECHO_LIMIT = 400_000
CONSOLIDATION_LIMIT = 250
CONSOLIDATION_TEXT_LIMIT = 2_000
UPLOAD_BYTES_LIMIT = 100 * 1024 * 1024
IDLE_SECONDS = 120
PROGRESS_SECONDS = 900

# opens every further piece of a section that was cut
CONTINUED = "(section continued)"
# the code fence some replies come in
FENCE = r"(?s)\A```[^\n]*\n(.*?)\n```\z"

# ---- end of fixed values ----


def _sql_array(items: list[str]) -> str:
    return "array(" + ", ".join(f"'{item}'" for item in items) + ")"


def relation_rules(spark: SparkSession) -> DataFrame:
    """One row per relation: ``rule_relation, rel_ord, subj_classes, obj_classes, wants`` (8 rows, always broadcast)."""
    rows = ", ".join(
        f"('{name}', {ordinal}, {_sql_array(subj)}, {_sql_array(obj)}, '{'|'.join(subj)}→{'|'.join(obj)}')"
        for ordinal, (name, subj, obj) in enumerate(RELATIONS)
    )
    return spark.sql(
        f"select * from values {rows} as rules(rule_relation, rel_ord, subj_classes, obj_classes, wants)"
    )


def legal_triples(spark: SparkSession) -> DataFrame:
    """The rules flattened to ``(legal_relation, rel_ord, subj_type, obj_type)`` (10 rows)."""
    return spark.sql(
        """
        select rule_relation as legal_relation, rel_ord, subj_type, obj_type
        from {rules}
        lateral view explode(subj_classes) s as subj_type
        lateral view explode(obj_classes) o as obj_type
        """,
        rules=relation_rules(spark),
    )
