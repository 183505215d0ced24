"""Suffix-array de-duplication by prefix-free parsing.

The minimum of a rolling 16-byte hash over each window triggers a phrase end, which parses every text into phrases that
overlap by ``width - 1`` bytes: each ``width``-byte string lies in exactly one phrase, at a place its own bytes decide. The
*dictionary* holds the different phrases, the *parse* their occurrences in corpus order. Later occurrences of a phrase
need no closer look. For the first ones, the dictionary's suffixes are sorted (to a depth of ``width`` bytes, which is
all that repeats of that length depend on; suffixes can only meet below one trigger, so the array is built trigger by
trigger) and suffixes that agree so far stand next to each other; among them the sort, being stable, keeps the
order of the parse, so that the first is the first of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimweave.llm.common import expand, releasing
from claimweave.llm.windows import CLASS_LIMIT, Units, covered, marked_runs, with_runs

WIDTH = 100


def units(width: int = WIDTH) -> Units:
    """Byte windows of at least 32 bytes, of which all but the first copy are marked."""
    if width < 32:
        raise ValueError("the width must be at least 32 bytes")
    return Units(width=width, gram=16, words=False, all_copies=False)


def dictionary_repeats(width: int):
    """Windows of one trigger's phrases that also start earlier, from the sorted suffixes of the phrases.

    Phrases must come in corpus order.
    """

    def match(phrases: list[tuple[int, int, int, int, bytes]]) -> Iterable[tuple[int, int]]:
        suffixes, origin = [], []
        for i, (_, _, _, count, content) in enumerate(phrases):
            suffixes += [content[j : j + width] for j in range(count)]
            origin += [(i, j) for j in range(count)]
        order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
        later = [b for a, b in zip(order, order[1:]) if suffixes[a] == suffixes[b]]
        return [origin[x] for x in sorted(later)]

    return match


def repeated_runs(docs: DataFrame, width: int = WIDTH, class_limit: int = CLASS_LIMIT) -> DataFrame:
    return marked_runs(docs, units(width), dictionary_repeats(width), class_limit)


def spans_of(drop: np.ndarray) -> list[tuple[int, int]]:
    """Maximal dropped runs as ``(start, end)``."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], drop.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> str:
    """The characters of UTF-8 ``data`` that no span touches."""
    edges = [0, *(edge for span in spans for edge in span), len(data)]
    return "".join(data[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2]))


def deduplicate(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ("doc_id",), text: bool = True, class_limit: int = CLASS_LIMIT) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts earlier in the corpus.

    Earlier means a smaller ``doc_id``, or the same document and an earlier start; strings are judged on the input and
    matches never cross documents. Returns the columns in ``keep`` with ``n_bytes``, ``n_removed``, ``spans`` (maximal
    removed runs), ``kept_sha256`` and, if asked for, ``kept_text``: the remaining characters, without those of which the
    removed runs took some bytes.

    A null text is empty; texts below ``width`` bytes stay whole. A null ``doc_id`` comes before all others. Input rows
    with equal id and text are one document and get equal results; rows that share an id alone are different documents,
    ordered by a hash of the text. Other columns play no part. No rows in, no rows out.
    """
    rows = with_runs(docs, repeated_runs(docs, width, class_limit), list(keep))
    extra = ", kept_text string" if text else ""
    row_type = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for packed, runs in zip(batch["packed"], batch["runs"]):
                data = expand(packed.as_py())
                drop = covered(runs, len(data), width)
                left = np.frombuffer(data, np.uint8)[~drop].tobytes() if drop.any() else data
                sizes.append(len(data))
                removed.append(len(data) - len(left))
                runs_of = spans_of(drop)
                spans.append([{"start": a, "end": b} for a, b in runs_of])
                digests.append(hashlib.sha256(left).hexdigest())
                if text:
                    kept.append(whole_characters(data, runs_of))
            columns = {
                "row": batch["row"],
                "n_bytes": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept_sha256": pa.array(digests, pa.string()),
            }
            if text:
                columns["kept_text"] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"row {row_type}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string{extra}"
    return rows.mapInArrow(releasing(run), schema).select("row.*", "n_bytes", "n_removed", "spans", "kept_sha256", *(["kept_text"] if text else []))
