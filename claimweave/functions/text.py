"""Text rules shared by all operators.

The pipeline's trimming, white space and length rules are the Unicode ones of the annotation tools that write the
records, which differ from Spark's defaults: ``trim`` only strips U+0020 and the regex class ``\\s`` is ASCII.
Slices count code points; only the refusal limit counts UTF-16 units.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: white space set, quote marks, caps ----

SPACE_CHARS = (
    "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_CLASS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# The same characters, the rare ones inside one range: most others are told by one comparison and not by nine.
SPACE_IN_RANGE = r"[\t\n\x0B\f\r \u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]]"
QUOTE_CHARS = "\"'‘’“”"
ANCHOR_CAP = 256
TITLE_CAP = 512
FIELD_CAP = 256
AUTHOR_CAP = 64
ORCID_PREFIX = r"(?i)^https?://(www\.)?orcid\.org/"
ORCID_SHAPE = r"(?i)^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]\z"

# ---- end of fixed values ----


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def strip(col: Column) -> Column:
    """Trim every Unicode white space character and the byte order mark."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def text_or_empty(col: Column) -> Column:
    """Trimmed text, with NULL read as the empty string."""
    return F.coalesce(strip(col), F.lit(""))


def none_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def squeeze(col: Column) -> Column:
    """White space runs become one space; ends trimmed. A lone plain space is no match, which spares most of a text."""
    # One test a character: only behind white space it matters which.
    return strip(F.regexp_replace(col, f"{SPACE_IN_RANGE}(?:(?<! ){SPACE_IN_RANGE}*+|{SPACE_IN_RANGE}++)", " "))


def comparable(col: Column) -> Column:
    """Key for case- and spacing-insensitive comparison."""
    return squeeze(F.lower(col))


def clip(col: Column, limit: int) -> Column:
    """Squeezed text of at most ``limit`` characters, the last one an ellipsis when cut."""
    flat = squeeze(F.coalesce(col, F.lit("")))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 units: astral characters count twice."""
    return (F.length(F.encode(col, "UTF-16BE")) / 2).cast("bigint")


def slug(col: Column, default: str = "extraction") -> Column:
    """ASCII letters and digits joined by single dashes, lower case."""
    dashed = F.regexp_replace(F.coalesce(none_if_empty(col), F.lit(default)), "[^a-zA-Z0-9]+", "-")
    return F.coalesce(none_if_empty(F.lower(F.btrim(dashed, F.lit("-")))), F.lit(default))


def editor_slug(col: Column, default: str = "paper") -> Column:
    """File-name slug of the review editor: extension cut, other characters to ``_``."""
    base = F.regexp_replace(F.regexp_replace(col, r"\.[^.]+\z", ""), "(?i)[^a-z0-9._-]+", "_")
    return F.coalesce(none_if_empty(F.btrim(base, F.lit("_"))), F.lit(default))


def extension(name: Column) -> Column:
    """Lower-case last extension with its dot, or the empty string."""
    return F.regexp_extract(F.lower(name), r"\.[^.]+\z", 0)


def quote(col: Column) -> Column:
    """Grounding quote: control characters to spaces, wrapping quote marks peeled, at most 256 characters; '' if none.

    Pairs are peeled as long as both ends are quote marks. The number of leading quote marks bounds the number of
    rounds, so the fold below is exact.
    """

    def peel(text: Column, _: Column) -> Column:
        inside = (
            (F.length(text) > 1)
            & F.lit(QUOTE_CHARS).contains(F.substring(text, 1, 1))
            & F.lit(QUOTE_CHARS).contains(F.substring(text, -1, 1))
        )
        return F.when(inside, strip(text.substr(F.lit(2), F.length(text) - 2))).otherwise(text)

    def peeled(flat: Column) -> Column:
        lead = F.regexp_extract(flat, f"^(?:[{QUOTE_CHARS}]|{SPACE_CLASS})+", 0)
        rounds = F.length(F.regexp_replace(lead, f"[^{QUOTE_CHARS}]", ""))
        return F.when(
            F.lit(QUOTE_CHARS).contains(F.substring(flat, 1, 1)) & (flat != ""),
            F.aggregate(F.sequence(F.lit(1), rounds), flat, peel),
        ).otherwise(flat)

    def capped(text: Column) -> Column:
        return F.when(F.length(text) > ANCHOR_CAP, strip(F.substring(text, 1, ANCHOR_CAP))).otherwise(text)

    flat = strip(F.regexp_replace(F.regexp_replace(col, r"\p{Cc}+", " "), " {2,}", " "))
    return F.when(col.isNull(), "").otherwise(bind(bind(flat, peeled), capped))


def orcid(col: Column) -> Column:
    """Canonical ORCID, or NULL for anything malformed."""
    bare = F.regexp_replace(text_or_empty(col), ORCID_PREFIX, "")
    return F.when(bare.rlike(ORCID_SHAPE), F.upper(bare))
