"""Strict JSON parsing of model replies, and narrowing of untyped fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimweave.functions.text import strip, text_or_empty
from claimweave.vocab import FENCE

SPAN = r"(?s)\{.*\}"
_END = "claimweave:end"


def strict_json(text: Column) -> Column:
    """Parse ``text`` as exactly one JSON value, else NULL.

    The variant parser stops after the first value and ignores what follows. Parsing the text as the first element
    of an array that must end in a marker rejects trailing prose in the same single pass.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    closed = (F.try_variant_get(wrapped, "$[1]", "string") == _END) & F.variant_get(
        wrapped, "$[2]", "variant"
    ).isNull()
    return F.when(closed, F.variant_get(wrapped, "$[0]", "variant"))


def unfence(content: Column) -> Column:
    """Trim, and drop a single code fence that wraps the whole reply."""
    bare = strip(content)
    return F.when(bare.rlike(FENCE), strip(F.regexp_extract(bare, FENCE, 1))).otherwise(bare)


def outer_span(text: Column) -> Column:
    """From the first ``{`` to the last ``}``."""
    return F.regexp_extract(text, SPAN, 0)


def member(value: Column, name: str) -> Column:
    return F.variant_get(value, f'$["{name}"]', "variant")


def kind(value: Column) -> Column:
    """Type name of a variant value per row, such as ``STRING`` or ``ARRAY<...>``."""
    return F.schema_of_variant(value)


def is_array(value: Column) -> Column:
    """Whether a variant is an array; the cast stops at its elements, where a schema would go through all they hold."""
    return F.try_variant_get(value, "$", "array<variant>").isNotNull()


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def string_field(value: Column, name: str) -> Column:
    """Trimmed string member; numbers, nulls and nested values count as empty and are never coerced."""
    field = member(value, name)
    return F.when(kind(field) == "STRING", text_or_empty(F.try_variant_get(field, "$", "string"))).otherwise("")


def raw_string_field(value: Column, name: str) -> Column:
    """String member as written, or NULL when it is not a string."""
    field = member(value, name)
    return F.when(kind(field) == "STRING", F.try_variant_get(field, "$", "string"))
