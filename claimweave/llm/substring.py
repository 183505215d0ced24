"""Substring de-duplication on words by level-wise doubling.

A window of ``width`` words can only repeat if the shorter windows inside it do, so only windows that repeated at one length
are extended to twice that length. The first level (8 words) covers the whole corpus: of every target window the
8-word window with the smallest hash is looked up, and target windows below one that occurs once are out. The levels
above (16, 32, ... words, at last the target length) extend the survivors around their 8-word window, until the target
is reached or no candidate is left.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimweave.llm import blocks
from claimweave.llm.common import expand
from claimweave.llm.windows import CLASS_LIMIT, Units, covered, marked_runs, with_runs

WIDTH = 35
FIRST_LEVEL = 8


def units(width: int = WIDTH) -> Units:
    """Word windows of at least 16 words, of which all copies are marked."""
    if width < 2 * FIRST_LEVEL:
        raise ValueError("the width must be at least 16 words")
    return Units(width=width, gram=FIRST_LEVEL, words=True, all_copies=True)


def doubled_repeats(width: int):
    """Windows that occur more than once among the blocks below one 8-word window, by doubling.

    At each level the windows of ``length`` words that hold a repeated window of half that length at either end of
    their reach are counted; the last level has the target length.
    """

    def match(members: list[tuple[int, int, int, int, bytes]]) -> Iterable[tuple[int, int]]:
        texts = [(content, *blocks.word_starts(np.frombuffer(content, np.uint8)), count) for *_, count, content in members]
        alive: dict[int, set[int]] | None = None  # per member the starts that repeated at the level before
        length = 2 * FIRST_LEVEL
        while True:
            length = min(length, width)
            reach = width - length
            windows = []
            for i, (content, begin, end, count) in enumerate(texts):
                starts = range(min(count + reach, len(begin) - length + 1))
                if alive is not None:
                    below = alive.get(i, ())
                    half = length - last
                    starts = [s for s in starts if s in below and s + half in below]
                windows += [(i, s, content[begin[s] : end[s + length - 1]]) for s in starts]
            times = Counter(window for _, _, window in windows)
            repeated = [(i, s) for i, s, window in windows if times[window] > 1]
            if length == width or not repeated:
                return [(i, s) for i, s in repeated if s < texts[i][3]] if length == width else []
            alive = {}
            for i, s in repeated:
                alive.setdefault(i, set()).add(s)
            last, length = length, 2 * length

    return match


def repeated_runs(docs: DataFrame, width: int = WIDTH, class_limit: int = CLASS_LIMIT) -> DataFrame:
    return marked_runs(docs, units(width), doubled_repeats(width), class_limit)


def deduplicate(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ("doc_id",), text: bool = True, class_limit: int = CLASS_LIMIT) -> DataFrame:
    """Remove every word covered by a ``width``-word window that also starts anywhere else, the same document included.

    Words are maximal runs of characters other than ASCII white space, compared unchanged; windows are judged on the
    input. Returns the columns in ``keep`` with ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by
    one space) and, if asked for, ``kept`` (those words as a string).

    A null text has no words; texts below ``width`` words stay whole. Input rows with equal id and text are one document
    and do not repeat each other; a null ``doc_id`` is an id like any other. Other columns play no part. No rows in, no
    rows out.
    """
    rows = with_runs(docs, repeated_runs(docs, width, class_limit), list(keep))
    row_type = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, digests, kept = [], [], [], []
            for packed, runs in zip(batch["packed"], batch["runs"]):
                words = expand(packed.as_py()).split()
                drop = covered(runs, len(words), width)
                left = b" ".join(w for w, gone in zip(words, drop.tolist()) if not gone) if drop.any() else b" ".join(words)
                sizes.append(len(words))
                removed.append(int(drop.sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode())
            columns = {
                "row": batch["row"],
                "n_words": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()),
            }
            if text:
                columns["kept"] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"row {row_type}, n_words long, n_removed long, kept_sha256 string{', kept string' if text else ''}"
    return rows.mapInArrow(run, schema).select("row.*", "n_words", "n_removed", "kept_sha256", *(["kept"] if text else []))
