"""Sections and pieces of long papers.

Everything here is row-local: a paper's text is never exploded into lines and never shuffled. Sections come from
regular-expression splits, and the two greedy folds (packing sections, windowing paragraphs) carry only lengths and
offsets, not text; pieces are then slices of the sections, and windows slices of a body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.plans import cut_up, emitted, from_pieces, pinned, runs
from claimweave.functions.text import SPACE_CLASS, bind, strip
from claimweave.vocab import CONTINUED, PIECE_BUDGET, PIECE_OVERLAP

_SPACE = SPACE_CLASS.replace(r"\n", "")  # within a line
_WORD = "[^" + SPACE_CLASS[1:]
_REST = r"[^\n\r\u2028\u2029]*"
# (?dm): lines end at \n only. A marked line needs white space after its marks.
_TITLE_LINE = rf"(?dm)^#{_SPACE}+({_WORD}{_REST})$\n?"
_BLANK_TITLE_LINE = rf"(?dm)^#{_SPACE}+$\n?"
_SECTION_LINE = rf"#{{2,3}}{_SPACE}+{_REST}$"
#: Where a window begins and ends.
_SPAN = "struct<start: int, end: int>"
#: Characters in the pieces that long bodies are read from.
_CUT = 1 << 15
_SECTION_START = rf"(?dm)(?=^{_SECTION_LINE})"


def sectioned(papers: DataFrame) -> DataFrame:
    """Add ``title`` and ``sections ARRAY<STRUCT<heading, body, text>>`` in reading order.

    The first ``# `` line is the title; ``## `` and ``### `` start sections; lines before the first heading form a
    section without heading; a section without any text is left out.
    """
    unix = pinned(papers, _text=F.regexp_replace("text", "\r\n", "\n"))
    # Around the first non-blank title; blank title lines before it go too.
    titled = pinned(
        unix,
        title=strip(F.regexp_extract("_text", _TITLE_LINE, 1)),
        _around=F.split("_text", _TITLE_LINE, 2),
    )
    before = F.regexp_replace(F.col("_around")[0], _BLANK_TITLE_LINE, "")
    rest = F.concat(before, F.coalesce(F.get("_around", F.lit(1)), F.lit("")))
    first_line = rf"(?dm)\A{_SECTION_LINE}"

    def section(raw: Column) -> Column:
        def named(line: Column) -> Column:
            heading = strip(line)
            return bind(
                strip(F.substring(raw, F.length(line) + 1, F.length(raw))),
                lambda body: F.struct(
                    heading.alias("heading"),
                    body.alias("body"),
                    F.when(heading == "", body).otherwise(strip(F.concat(heading, F.lit("\n\n"), body))).alias("text"),
                ),
            )

        return bind(F.regexp_extract(raw, first_line, 0), named)

    pieces = F.transform(F.split(rest, _SECTION_START), section)
    return pinned(titled, sections=F.filter(pieces, lambda s: s["text"] != "")).drop("_text", "_around")


def section_rows(papers: DataFrame) -> DataFrame:
    """One row per section: ``paper_id, section_no, heading, text``."""
    return (
        sectioned(papers)
        .select("paper_id", F.posexplode("sections").alias("section_no", "s"))
        .select("paper_id", "section_no", "s.heading", "s.text")
    )


def _windows(section: Column, room: Column, overlap: int) -> Column:
    """Texts of an oversized section, cut at paragraph breaks; each starts with the end of the one before.

    With breaks normalised to one blank line, every window is a slice of the body: the fold only moves offsets.
    """
    return bind(F.regexp_replace(section["body"], r"\n{2,}", "\n\n"), lambda body: _body_windows(section, body, room, overlap))


def _body_windows(section: Column, body: Column, room: Column, overlap: int) -> Column:
    lengths = F.transform(F.split(body, "\n\n"), lambda p: F.length(p))
    # The first paragraph has no break before it.
    begin = F.struct(F.lit(0).alias("start"), F.lit(-2).alias("end"))

    def step(state: Column, length: Column) -> tuple[Column, Column]:
        filled = state["end"] > state["start"]
        cut = filled & (state["end"] - state["start"] + 2 + length > room)
        after = F.struct(
            F.when(cut, F.greatest(state["start"], state["end"] - overlap)).otherwise(state["start"]).alias("start"),
            (state["end"] + 2 + length).alias("end"),
        )
        return after, F.when(cut, F.array(state)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    spans = emitted(lengths, begin, _SPAN, _SPAN, step, lambda state: F.array(state))
    sliced = lambda parts: F.transform(spans, lambda w: strip(from_pieces(parts, _CUT, w["start"], w["end"] - w["start"])))
    whole = F.transform(spans, lambda w: strip(F.substring(body, w["start"] + 1, w["end"] - w["start"])))
    texts = F.filter(F.when(F.length(body) > 2 * _CUT, bind(cut_up(body, _CUT), sliced)).otherwise(whole), lambda t: t != "")
    head = F.when(section["heading"] == "", "").otherwise(F.concat(section["heading"], F.lit("\n\n")))
    return F.transform(
        texts,
        lambda t, i: F.concat(head, F.when(i > 0, f"{CONTINUED}\n\n").otherwise(""), t),
    )


def chunked(papers: DataFrame, budget: int = PIECE_BUDGET, overlap: int = PIECE_OVERLAP) -> DataFrame:
    """One row per piece: ``paper_id, title, index, text, sections ARRAY<STRING>``.

    Whole sections are packed greedily while they fit the budget less the title; a section that alone does not fit is
    cut into windows. Every piece starts with the title. No piece is dropped or capped.
    """
    split = sectioned(papers).withColumn(
        "_title_line", F.when(F.col("title") == "", "").otherwise(F.concat(F.lit("# "), "title", F.lit("\n\n")))
    )
    room = F.lit(budget) - F.length("_title_line")
    begin = F.struct(F.lit(0).alias("group"), F.lit(0).alias("held"))

    def place(state: Column, length: Column) -> tuple[Column, Column]:
        alone = length > room
        flush = (state["held"] > 0) & (alone | (state["held"] + length + 2 > room))
        group = F.when(flush, state["group"] + 1).otherwise(state["group"])
        after = F.struct(
            F.when(alone, group + 1).otherwise(group).alias("group"),
            F.when(alone, 0).when(flush, length + 2).otherwise(state["held"] + length + 2).alias("held"),
        )
        return after, F.array(group)

    lengths = F.transform("sections", lambda s: F.length(s["text"]))
    packed = emitted(lengths, begin, "struct<group: int, held: int>", "int", place)
    grouped = pinned(split, _runs=runs(packed))

    def label(section: Column) -> Column:
        return F.when(section["heading"] == "", "(preamble)").otherwise(section["heading"])

    def pieces_of(run: Column) -> Column:
        return bind(F.slice("sections", run["start"] + 1, run["count"]), pieces_from)

    def pieces_from(members: Column) -> Column:
        only = members[0]
        together = F.array(
            F.struct(
                F.array_join(F.transform(members, lambda s: s["text"]), "\n\n").alias("text"),
                F.transform(members, label).alias("sections"),
            )
        )
        windows = F.transform(
            _windows(only, room, overlap),
            lambda text, i: F.struct(
                text.alias("text"),
                F.array(
                    F.concat(label(only), F.when((i > 0) | (F.size("sections") > 1), " [split]").otherwise(""))
                ).alias("sections"),
            ),
        )
        return F.when((F.size(members) == 1) & (F.length(only["text"]) > room), windows).otherwise(together)

    pieces = F.flatten(F.transform("_runs", pieces_of))
    return grouped.select("paper_id", "title", "_title_line", F.posexplode(pieces).alias("index", "_piece")).select(
        "paper_id",
        "title",
        "index",
        F.concat("_title_line", "_piece.text").alias("text"),
        F.col("_piece.sections").alias("sections"),
    )


def uncovered(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Papers with text but no piece, such as a title alone."""
    return papers.where(strip(F.col("text")) != "").join(chunks.select("paper_id"), "paper_id", "left_anti")
