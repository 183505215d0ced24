"""Plan-shaping helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.text import bind

#: Items folded before what they emitted is put aside.
FOLD_BLOCK = 128


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The optimizer moves filters and merges projections by repeating their expressions, which multiplies long parsing
    chains. A generator over a one-row array is a step it does not look through.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def emitted(
    items: Column, begin: Column, state: str, item: str, step: Callable[[Column, Column], tuple[Column, Column]],
    last: Callable[[Column], Column] | None = None, block: int = FOLD_BLOCK,
) -> Column:
    """The list that an ordered fold over ``items`` emits.

    ``step`` gives the next state (of type ``state``) and an array of what it emits (of type ``item``); ``last`` does so for the
    final state. Arrays are immutable, so appending to one list copies it each time. Here an inner fold fills the list of one
    block and the lists are joined at the end, so copying does not grow with the square of the items.
    """
    inner, outer = f"struct<state: {state}, out: array<{item}>>", f"struct<state: {state}, out: array<array<{item}>>>"
    none = F.array().cast(f"array<{item}>")

    def taken(acc: Column, one: Column) -> Column:
        after, out = step(acc["state"], one)
        return F.struct(after.cast(state).alias("state"), F.concat(acc["out"], out.cast(f"array<{item}>")).alias("out")).cast(inner)

    def filled(acc: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")).cast(inner), taken)
        return bind(own, lambda done: F.struct(done["state"].alias("state"), F.array_append(acc["out"], done["out"]).alias("out")).cast(outer))

    def finish(acc: Column) -> Column:
        return F.flatten(acc["out"] if last is None else F.array_append(acc["out"], last(acc["state"]).cast(f"array<{item}>")))

    def over(listed: Column) -> Column:
        count = F.greatest((F.size(listed) - 1) / block, F.lit(0)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(listed, i * block + 1, block))
        return F.aggregate(parts, F.struct(begin.alias("state"), F.array().cast(f"array<array<{item}>>").alias("out")).cast(outer), filled, finish)

    return bind(items, over)


def runs(numbers: Column) -> Column:
    """``(start, count)`` of each run of equal numbers, from 0."""

    def of(listed: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(listed) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(listed, i) != F.get(listed, i - 1)))
        ended = lambda begun: F.transform(
            begun, lambda s, k: F.struct(s.alias("start"), (F.coalesce(F.get(begun, k + 1), F.size(listed)) - s).alias("count"))
        )
        return F.when(F.size(listed) > 0, bind(starts, ended))

    return bind(numbers, of)


def cut_up(text: Column, size: int) -> Column:
    """The text in pieces of ``size`` characters; reading from the middle of a text costs its length, from a piece the piece's."""

    def pieces(whole: Column, width: int) -> Column:
        count = F.greatest((F.length(whole) - 1) / width, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda i: F.substring(whole, i * width + 1, F.lit(width)))

    return F.flatten(F.transform(pieces(text, size * 32), lambda part: pieces(part, size)))


def from_pieces(pieces: Column, size: int, start: Column, count: Column) -> Column:
    """``count`` characters from ``start`` (from 0) of a text cut up in pieces of ``size``."""
    first = (start / size).cast("int")
    some = F.slice(pieces, first + 1, ((start + count) / size).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), start - first * size + 1, count)
