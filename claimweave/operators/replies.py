"""From reply text to typed raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.plans import pinned
from claimweave.functions.replies import is_array, is_object, member, outer_span, raw_string_field, strict_json, string_field, unfence
from claimweave.functions.text import AUTHOR_CAP, FIELD_CAP, TITLE_CAP, none_if_empty, orcid
from claimweave.operators.conform import explode_variant

AUTHORS_TYPE = "array<struct<name: string, orcid: string>>"


def _parsed_as(replies: DataFrame, valid) -> DataFrame:
    """Parse the unfenced reply, or else its outer brace span, as a value that passes ``valid``.

    Each step is computed once per reply, and the span only where the whole reply failed.
    """
    bare = pinned(replies, _bare=unfence(F.col("content")))
    whole = pinned(bare, _whole=strict_json(F.col("_bare")))
    judged = pinned(whole, _whole_ok=valid(F.col("_whole")))
    span = pinned(judged, _span=strict_json(F.when(~F.col("_whole_ok"), outer_span(F.col("_bare")))))
    whole_ok, span_ok = F.col("_whole_ok"), valid(F.col("_span"))
    return pinned(
        span,
        parsed=F.when(whole_ok, F.col("_whole")).when(span_ok, F.col("_span")),
        parse=F.when(whole_ok, "whole").when(span_ok, "span").otherwise("none"),
    ).drop("_bare", "_whole", "_whole_ok", "_span")


def parse_graphs(replies: DataFrame) -> DataFrame:
    """Add ``parsed VARIANT`` (NULL when the reply holds no graph) and ``parse`` (whole, span, none).

    A graph has arrays under both ``nodes`` and ``edges``.
    """
    return _parsed_as(replies, lambda v: is_array(member(v, "nodes")) & is_array(member(v, "edges")))


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """Add ``parsed`` and ``parse`` for consolidation replies: an object with an array under ``merges`` or ``edges``."""
    return _parsed_as(
        replies, lambda v: is_object(v) & (is_array(member(v, "merges")) | is_array(member(v, "edges")))
    )


def record_rows(parsed: DataFrame, name: str, *kept: str) -> DataFrame:
    """``kept`` columns plus ``pos`` and ``rec VARIANT`` for each entry of the array member ``name``.

    A missing or other member is an empty list.
    """
    found = pinned(parsed, _member=member(F.col("parsed"), name))
    lists = pinned(found, _list=F.when(is_array(F.col("_member")), F.col("_member")))
    return explode_variant(lists, "_list", *kept).select(
        *kept, F.col("pos").cast("bigint").alias("pos"), F.col("value").alias("rec")
    )


def raw_nodes(parsed: DataFrame) -> DataFrame:
    """Raw node records of winning replies, in the input shape of classification.

    Non-string fields read as empty and are never coerced; entries that are not objects become empty records, which
    admission then rejects with a reason. ``type`` keeps its raw spelling for the reject message.
    """
    raw_type = F.coalesce(raw_string_field(F.col("rec"), "type"), F.try_variant_get("rec", "$.type", "string"))
    fields = [raw_string_field(F.col("rec"), name).alias(name) for name in ("text", "description", "doi", "url", "anchor")]
    return record_rows(parsed, "nodes", "graph_id").select(
        "graph_id", "pos", raw_string_field(F.col("rec"), "id").alias("id"), raw_type.alias("type"), *fields
    )


def raw_edges(parsed: DataFrame) -> DataFrame:
    """Raw edge records of winning replies, in the input shape of classification."""
    fields = [raw_string_field(F.col("rec"), name).alias(name) for name in ("relation", "subject", "object", "anchor")]
    return record_rows(parsed, "edges", "graph_id").select("graph_id", "pos", *fields)


def proposed_edges(parsed: DataFrame) -> DataFrame:
    """Edges that consolidation replies propose; their fields are coerced to text, as the ids of merge groups are."""
    fields = [
        F.coalesce(raw_string_field(F.col("rec"), name), F.try_variant_get("rec", f"$.{name}", "string"), F.lit("")).alias(name)
        for name in ("relation", "subject", "object")
    ]
    return record_rows(parsed, "edges", "graph_id").select("graph_id", "pos", *fields)


def merge_groups(parsed: DataFrame) -> DataFrame:
    """``(graph_id, group_no, ids)`` of verdict replies; an entry that is not a list is an empty group."""
    ids = F.when(is_array(F.col("rec")), F.try_variant_get("rec", "$", "array<string>"))
    return record_rows(parsed, "merges", "graph_id").select(
        "graph_id", F.col("pos").alias("group_no"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids")
    )


def paper_info(parsed: DataFrame) -> DataFrame:
    """Clean attribution ``(graph_id, title, doi, license, authors)``; graphs with nothing usable have no row.

    Authors need a name; the first 64 with one are kept; a malformed ORCID is dropped, never repaired.
    """
    raw = pinned(parsed.select("graph_id", "parsed"), _paper=member(F.col("parsed"), "paper"))

    def field(name: str, cap: int) -> Column:
        return none_if_empty(F.substring(string_field(F.col("_paper"), name), 1, cap))

    listed = member(F.col("_paper"), "authors")
    entries = F.when(is_array(listed), F.try_variant_get(listed, "$", "array<variant>"))
    people = F.filter(
        F.transform(
            entries,
            lambda a: F.struct(
                F.substring(string_field(a, "name"), 1, FIELD_CAP).alias("name"),
                orcid(raw_string_field(a, "orcid")).alias("orcid"),
            ),
        ),
        lambda a: a["name"] != "",
    )
    clean = pinned(
        raw.where(is_object(F.col("_paper"))),
        title=field("title", TITLE_CAP),
        doi=field("doi", FIELD_CAP),
        license=field("license", FIELD_CAP),
        authors=F.slice(F.coalesce(people, F.array().cast(AUTHORS_TYPE)), 1, AUTHOR_CAP),
    )
    usable = F.coalesce("title", "doi", "license").isNotNull() | (F.size("authors") > 0)
    return clean.where(usable).select("graph_id", "title", "doi", "license", "authors")
