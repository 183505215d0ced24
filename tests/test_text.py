"""Text rules that differ from Spark's defaults."""

from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.functions.replies import strict_json, string_field, unfence


def one(spark, value, rule):
    return spark.createDataFrame([(value,)], "v string").select(rule(F.col("v")).alias("r")).first()["r"]


def test_trim_covers_unicode_spaces_and_byte_order_mark(spark):
    assert one(spark, "﻿  a b 　\n", text.strip) == "a b"


def test_squeeze_collapses_mixed_space_runs(spark):
    assert one(spark, " a \t\n b ", text.squeeze) == "a b"


def test_utf16_length_counts_astral_characters_twice(spark):
    assert one(spark, "a\U0001f600", text.utf16_length) == 3


def test_clip_ends_with_an_ellipsis_only_when_cut(spark):
    assert one(spark, "abcdef", lambda c: text.clip(c, 6)) == "abcdef"
    assert one(spark, "abcdefg", lambda c: text.clip(c, 6)) == "abcde…"


def test_quote_peels_nested_and_mixed_marks(spark):
    assert one(spark, "“ ‘it holds’ \"", text.quote) == "it holds"
    assert one(spark, '""""a""""', text.quote) == "a"
    assert one(spark, '"a', text.quote) == '"a'
    assert one(spark, '"', text.quote) == '"'
    assert one(spark, '""', text.quote) == ""
    assert one(spark, None, text.quote) == ""
    assert one(spark, "a\u0007\u0085  b", text.quote) == "a b"


def test_quote_is_capped_and_trimmed_again(spark):
    assert one(spark, "x" * 255 + " yz", text.quote) == "x" * 255


def test_orcid_shapes(spark):
    assert one(spark, "HTTPS://www.orcid.org/0000-0002-1825-009x", text.orcid) == "0000-0002-1825-009X"
    assert one(spark, "0000-0002-1825-00977", text.orcid) is None


def test_slugs(spark):
    assert one(spark, "--A  b.C--", text.slug) == "a-b-c"
    assert one(spark, "", text.slug) == "extraction"
    assert one(spark, "__My paper (v2).PDF", text.editor_slug) == "My_paper_v2"
    assert one(spark, "().pdf", text.editor_slug) == "paper"


def test_json_must_be_one_whole_value(spark):
    kept = lambda c: F.to_json(strict_json(c))
    assert one(spark, '{"a":1}', kept) == '{"a":1}'
    for broken in ('{"a":1} x', '{"a":1},{"b":2}', '{"a":1}] x [', '{"a":', ""):
        assert one(spark, broken, kept) is None


def test_last_duplicate_key_wins(spark):
    assert one(spark, '{"a":"1","a":"2"}', lambda c: string_field(strict_json(c), "a")) == "2"


def test_only_strings_count_as_text(spark):
    for raw in ('{"a":5}', '{"a":null}', '{"a":["x"]}', "{}"):
        assert one(spark, raw, lambda c: string_field(strict_json(c), "a")) == ""


def test_fences(spark):
    assert one(spark, " ```json\n{}\n``` ", unfence) == "{}"
    assert one(spark, "```{}```", unfence) == "```{}```"
