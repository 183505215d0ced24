"""Repeated windows of a corpus, found block by block and, only where blocks differ, window by window.

Steps, each a partitioned job (``blocks.py`` explains blocks and anchors):

1. ``outline``: every document is cut into blocks; a row per block carries the anchor's hash and a digest of the block's
   content. Equal blocks within a stretch of the input are combined before the shuffle, so a block that a third of the
   corpus shares costs one row per stretch.
2. ``compare``: rows are dealt by anchor and read in sorted order. Equal blocks are settled here; where one anchor has
   several different blocks (partial overlaps), one copy of each goes on.
3. ``contents``: those blocks fetch their bytes from the documents and meet again by anchor, and ``resolve`` compares the windows
   of one anchor. An anchor with more than ``CLASS_LIMIT`` different blocks would make one heavy task: its windows become
   rows of their own instead, combined per stretch like blocks and dealt by the hash of the window.
4. ``marked_runs``: runs of marked window starts per document.

Rows carry a document as ``(doc, text_hash)``, so that rows sharing an id but not a text stay apart; rows that repeat
both are one document. Only narrow rows and compressed texts are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm import blocks
from claimweave.llm.common import HELD_BYTES, NO_ID, expand, mapped, releasing, settle, squeeze, text_bytes

#: Different blocks of one anchor that a task compares in memory; beyond it windows become rows. Any value gives the same result.
CLASS_LIMIT = 1024

# Kinds of rows between the steps.
ASKS, TWICE, MARK, NEED = 0, 1, 2, 3

ROW = "kind byte, key long, digest long, doc long, text_hash long, start long, count long"
_NAMES = [field.split()[0] for field in ROW.split(", ")]


@dataclass(frozen=True)
class Units:
    """What a window consists of. ``split`` gives the bytes to work on with begin and end of every unit (None: bytes)."""

    width: int
    gram: int
    words: bool
    #: True: every copy of a repeated window is marked; False: every copy but the first of the corpus.
    all_copies: bool

    def prepare(self, data: bytes) -> tuple[bytes, np.ndarray | None, np.ndarray | None]:
        if not self.words:
            return data, None, None
        data = b" ".join(data.split())
        return data, *blocks.word_starts(np.frombuffer(data, np.uint8))

    def cut(self, data: bytes) -> tuple[bytes, np.ndarray | None, np.ndarray | None, blocks.Blocks]:
        data, begin, end = self.prepare(data)
        raw = np.frombuffer(data, np.uint8)
        grams = blocks.word_grams(blocks.word_hashes(raw, begin, end), self.gram) if self.words else blocks.byte_grams(raw, self.gram)
        return data, begin, end, blocks.find_blocks(grams, self.gram, self.width)

    def span(self, begin, end, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte range of the windows from ``start``."""
        last = start + count + self.width - 2
        return (start, last + 1) if begin is None else (begin[start], end[last])

    def window_slices(self, content: bytes, count: int) -> list[bytes]:
        if not self.words:
            return [content[i : i + self.width] for i in range(count)]
        begin, end = blocks.word_starts(np.frombuffer(content, np.uint8))
        return [content[b:e] for b, e in zip(begin[:count].tolist(), end[self.width - 1 : self.width - 1 + count].tolist())]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def keyed_columns() -> list[Column]:
    """``doc, text_hash, text`` with the text as bytes; a missing id comes before all others."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        text_bytes().alias("text"),
    ]


# ---- step 1 ----


def _outline(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for doc, text_hash, data in zip(batch["doc"].to_pylist(), batch["text_hash"].to_pylist(), batch["text"]):
                data = data.as_py()
                data, begin, end, found = units.cut(data)
                n = len(found.start)
                if not n:
                    continue
                low, high = units.span(begin, end, found.start, found.count)
                digest = xxhash.xxh3_64_intdigest
                digests = np.fromiter((digest(data[a:b]) for a, b in zip(low.tolist(), high.tolist())), np.uint64, n)
                held.append((found.key, digests.view(np.int64), np.full(n, doc), np.full(n, text_hash), found.start, found.count))
                size += len(data) + 48 * n
                if size >= 2 * HELD_BYTES:
                    yield from _combined(held, units.all_copies)
                    held, size = [], 0
        if held:
            yield from _combined(held, units.all_copies)

    return run


def _combined(held: list[tuple[np.ndarray, ...]], all_copies: bool) -> Iterator[pa.RecordBatch]:
    """Equal blocks of one stretch become one row; the marks this already settles pass on as contiguous runs."""
    key, digest, doc, text_hash, start, count = (np.concatenate(column) for column in zip(*held))
    order = np.lexsort((start, text_hash, doc, digest, key))
    key, digest, doc, text_hash, start, count = (x[order] for x in (key, digest, doc, text_hash, start, count))
    row = np.stack((key, digest, doc, text_hash, start))
    same = np.zeros(len(key), bool)
    same[1:] = (row[:2, 1:] == row[:2, :-1]).all(axis=0)
    again = np.zeros(len(key), bool)
    again[1:] = (row[:, 1:] == row[:, :-1]).all(axis=0)  # the same document twice
    keep = ~again
    key, digest, doc, text_hash, start, count, same = (x[keep] for x in (key, digest, doc, text_hash, start, count, same))
    repeated = same.copy()
    repeated[:-1] |= same[1:]
    first = ~same
    kind = np.where(first & repeated, TWICE, ASKS)[first]
    yield _rows(kind, *(x[first] for x in (key, digest, doc, text_hash, start, count)))
    settled = repeated if all_copies else same
    if settled.any():
        doc, text_hash, start, count = (x[settled] for x in (doc, text_hash, start, count))
        order = np.lexsort((start, text_hash, doc))
        doc, text_hash, start, count = (x[order] for x in (doc, text_hash, start, count))
        opens = np.ones(len(doc), bool)
        opens[1:] = (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1]) | (start[1:] != start[:-1] + count[:-1])
        heads = np.flatnonzero(opens)
        count = np.add.reduceat(count, heads)
        doc, text_hash, start = doc[heads], text_hash[heads], start[heads]
        spread = blocks.mix(doc.view(np.uint64) + start.view(np.uint64)).view(np.int64)
        yield _rows(np.full(len(doc), MARK), spread, np.zeros(len(doc), np.int64), doc, text_hash, start, count)


def _rows(kind, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(kind, np.int8)), *(pa.array(np.asarray(x, np.int64)) for x in columns)], _NAMES)


def outline(texts: DataFrame, units: Units) -> DataFrame:
    """A row per different block of each stretch of the input."""
    return texts.mapInArrow(releasing(_outline(units)), ROW)


# ---- step 2 ----


class _Comparison:
    """Reads rows sorted by key, digest, document and start, and holds one row between calls.

    ``windows``: rows are single windows, so different digests of one key are of no further interest.
    """

    def __init__(self, all_copies: bool, windows: bool):
        self.all_copies, self.windows = all_copies, windows
        self.last = np.empty((len(_NAMES), 0), np.int64)  # the last row so far, not settled yet
        self.run_before = False
        self.head = np.empty((len(_NAMES), 0), np.int64)  # first row of the last run so far
        self.head_mixed = False

    def _settled(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Marks of all rows but the last, which stays for the next call; ``run_before``: row 0 goes on with an earlier run."""
        same = np.zeros(rows.shape[1], bool)
        same[0] = self.run_before
        same[1:] = (rows[1:3, 1:] == rows[1:3, :-1]).all(axis=0)
        marked = same.copy()
        if self.all_copies:
            marked[:-1] |= same[1:]
            marked |= rows[0] == TWICE
        passed = rows[0] == MARK
        out = (marked & ~passed)[:-1] | passed[:-1]
        if out.any():
            yield _rows(np.full(int(out.sum()), MARK), *rows[1:, :-1][:, out])

    def push(self, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not new.shape[1]:
            return
        rows = np.concatenate((self.last, new), axis=1)
        twin = np.zeros(rows.shape[1], bool)
        twin[1:] = (rows[1:6, 1:] == rows[1:6, :-1]).all(axis=0) & (rows[0, 1:] != MARK)  # the same document twice
        if twin.any():
            rows = rows[:, ~twin]
        yield from self._settled(rows)
        if not self.windows:
            begun = np.ones(rows.shape[1], bool)
            begun[1:] = (rows[1:3, 1:] != rows[1:3, :-1]).any(axis=0)
            begun[: self.last.shape[1]] = False  # its run is the held head's
            heads = np.concatenate((self.head, rows[:, begun & (rows[0] != MARK)]), axis=1)
            linked = np.zeros(heads.shape[1] + 1, bool)
            if heads.shape[1]:
                linked[0] = self.head_mixed
                linked[1:-1] = heads[1, 1:] == heads[1, :-1]
                need = linked[:-1] | linked[1:]
                need[-1] = False
                if need.any():
                    yield _rows(np.full(int(need.sum()), NEED), *heads[1:, need])
                self.head, self.head_mixed = heads[:, -1:], bool(linked[-2])
        at = rows.shape[1] - 1
        self.run_before = bool((rows[1:3, at] == rows[1:3, at - 1]).all()) if at else self.run_before
        self.last = rows[:, at:]

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.last.shape[1]:
            other = np.bitwise_not(self.last)  # a row that agrees with the last one in nothing
            yield from self._settled(np.concatenate((self.last, other), axis=1))
        if self.head.shape[1] and self.head_mixed:
            yield _rows([NEED], *self.head[1:])


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch[name].to_numpy(zero_copy_only=False).astype(np.int64) for name in _NAMES])


def _compare(all_copies: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Comparison(all_copies, windows=False)
        for batch in batches:
            yield from rows.push(_numbers(batch))
        yield from rows.finish()

    return run


def compare(rows: DataFrame, all_copies: bool) -> DataFrame:
    """Marks of equal blocks, and a request for the content of one copy of each block that shares its anchor with others."""
    dealt = rows.repartition("key").sortWithinPartitions("key", "digest", "doc", "text_hash", "start")
    return dealt.mapInArrow(releasing(_compare(all_copies)), ROW)


# ---- step 3 ----

CONTENT = ROW + ", content binary"
#: Windows gathered before equal ones are combined.
_WINDOWS_HELD = 100_000


def _contents(units: Units) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def windows(data: bytes, doc: int, text_hash: int, start: int, count: int) -> tuple[np.ndarray, ...]:
        slices = units.window_slices(data, count)
        keys = np.array([xxhash.xxh3_64_intdigest(x) for x in slices], np.uint64).view(np.int64)
        digests = np.array([xxhash.xxh64_intdigest(x) for x in slices], np.uint64).view(np.int64)
        return keys, digests, np.full(count, doc), np.full(count, text_hash), start + np.arange(count), np.ones(count, np.int64)

    def combined(held: list) -> Iterator[pa.RecordBatch]:
        for rows in _combined(held, units.all_copies):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(rows.num_rows, pa.binary())], [*_NAMES, "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for doc, text_hash, packed, wanted in zip(*(batch[name] for name in ("doc", "text_hash", "packed", "wanted"))):
                doc, text_hash = doc.as_py(), text_hash.as_py()
                data, begin, end = units.prepare(expand(packed.as_py()))
                asked = wanted.values
                key, start, count = (asked.field(name).to_numpy() for name in ("key", "start", "count"))
                crowded = asked.field("crowded").to_numpy(zero_copy_only=False)
                low, high = units.span(begin, end, start, count)
                for i in np.flatnonzero(crowded).tolist():
                    held.append(windows(data[low[i] : high[i]], doc, text_hash, int(start[i]), int(count[i])))
                    size += int(count[i])
                if size >= _WINDOWS_HELD:
                    yield from combined(held)
                    held, size = [], 0
                plain = np.flatnonzero(~crowded)
                n = len(plain)
                if n:
                    numbers = _rows(np.full(n, NEED), key[plain], np.zeros(n), np.full(n, doc), np.full(n, text_hash), start[plain], count[plain])
                    content = pa.array([data[low[i] : high[i]] for i in plain.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([*numbers.columns, content], [*_NAMES, "content"])
        if held:
            yield from combined(held)

    return run


def contents(texts: DataFrame, needs: DataFrame, units: Units, limit: int) -> DataFrame:
    """The bytes of the requested blocks; of anchors with more than ``limit`` requests, rows of single windows instead.

    Requests of one document meet its text once. Equal windows of a stretch are combined like equal blocks.
    """
    crowded = needs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("key", F.lit(True).alias("crowded"))
    told = needs.join(crowded, "key", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    wanted = told.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "count", "key", "crowded")).alias("wanted"))
    return packed_texts(texts).join(wanted, ["doc", "text_hash"]).mapInArrow(releasing(_contents(units)), CONTENT)


def packed_texts(texts: DataFrame) -> DataFrame:
    """Texts in the compressed form that is shuffled."""

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        yield {"doc": batch["doc"], "text_hash": batch["text_hash"], "packed": pa.array([squeeze(x.as_py()) for x in batch["text"]], pa.binary())}

    return mapped(texts, step, "doc long, text_hash long, packed binary")


#: (doc, text_hash, start, count, content) of the blocks of one anchor -> indices and offsets of marked windows.
Matcher = Callable[[list[tuple[int, int, int, int, bytes]]], Iterable[tuple[int, int]]]


def _resolve(units: Units, match: Matcher) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def marks(members: list) -> Iterator[pa.RecordBatch]:
        if len(members) < 2:  # windows of one block differ in where they hold the anchor
            return
        runs: list[list[int]] = []
        for i, offset in match(members):
            doc, text_hash, start, _, _ = members[i]
            if runs and runs[-1][0] == doc and runs[-1][1] == text_hash and runs[-1][2] + runs[-1][3] == start + offset:
                runs[-1][3] += 1
            else:
                runs.append([doc, text_hash, start + offset, 1])
        if runs:
            found = np.array(runs, np.int64).T
            zero = np.zeros(len(runs), np.int64)
            yield _rows(np.full(len(runs), MARK), zero, zero, *found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Comparison(units.all_copies, windows=True)
        current, members = None, []
        for batch in batches:
            numbers = _numbers(batch)
            blocks_at = np.flatnonzero(numbers[0] == NEED)
            yield from windows.push(numbers[:, numbers[0] != NEED])
            content = batch["content"].take(pa.array(blocks_at)).to_pylist()
            for (key, _, *member), data in zip(numbers[1:, blocks_at].T.tolist(), content):
                if key != current:
                    yield from marks(members)
                    current, members = key, []
                if not members or list(members[-1][:3]) != member[:3]:  # else the same document twice
                    members.append((*member, data))
        yield from marks(members)
        yield from windows.finish()

    return run


def resolve(content: DataFrame, units: Units, match: Matcher) -> DataFrame:
    """Marks inside blocks that only partly agree."""
    dealt = content.repartition("key").sortWithinPartitions("key", "digest", "doc", "text_hash", "start")
    return dealt.mapInArrow(releasing(_resolve(units, match)), ROW)


def marked_runs(docs: DataFrame, units: Units, match: Matcher, limit: int = CLASS_LIMIT) -> DataFrame:
    """``(doc, text_hash, runs)``: per document the marked window starts as an array of ``(start, count)``."""
    texts = docs.select(*keyed_columns())
    compared = settle(compare(outline(texts, units), units.all_copies), "compared-blocks")
    content = contents(texts, compared.where(F.col("kind") == NEED), units, limit)
    marks = compared.unionByName(resolve(content, units, match)).where(F.col("kind") == MARK)
    return marks.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "count")).alias("runs"))


def covered(runs: pa.Scalar, units: int, width: int) -> np.ndarray:
    """Which of ``units`` units lie in a window that starts inside one of the runs."""
    change = np.zeros(units + 1, np.int64)
    if runs is not None and runs.is_valid and len(runs.values):
        start, count = (runs.values.field(name).to_numpy() for name in ("start", "count"))
        np.add.at(change, start, 1)
        np.add.at(change, start + count + width - 1, -1)
    return np.cumsum(change[:-1]) > 0


def with_runs(docs: DataFrame, runs: DataFrame, keep: list[str]) -> DataFrame:
    """Every input row with its compressed text and its runs (null: none), beside the columns in ``keep``."""
    rows = docs.select(F.struct(*keep).alias("row"), *keyed_columns())

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        yield {"row": batch["row"], "doc": batch["doc"], "text_hash": batch["text_hash"], "packed": pa.array([squeeze(x.as_py()) for x in batch["text"]], pa.binary())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in step(batch):
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    row_type = rows.schema["row"].dataType.simpleString()
    packed = rows.mapInArrow(releasing(run), f"row {row_type}, doc long, text_hash long, packed binary")
    return packed.join(runs, ["doc", "text_hash"], "left")

