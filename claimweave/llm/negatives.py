"""Hard negatives by a secondary-sort shuffle.

An anchor's *positives* are its best rows of the same label; a positive opens a window of scores below its own, and the best rows
of other labels inside the window are its *hard negatives*. Every row is scored against every anchor, in cells: a cell is one
group of anchors and one group of rows, both dealt by a hash of the id and bounded in size, multiplied as matrices.

Scores are packed with the ids into keys (anchor, descending score, positives first, id). The shuffle deals the keys by anchor and
sorts them; one pass over the sorted stream then sees an anchor's rows from the best down, so it holds no more than the anchor's
open windows.

There are two such shuffles. The first settles the positives: a cell sends only its own best rows of the same label, as any of an
anchor's best is among the best of its cell. The second settles the negatives: the positives come with the anchors, and a cell
sends only the best rows inside each of their windows, by the same argument. So what is shuffled grows with anchors times cells
times a few rows, not with the pairs.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import mapped, settle

#: Components are multiplied by this and rounded down, so that scores are whole numbers.
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A window is the scores from LOW to HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows in a cell, about: of all rows, and of anchors. They bound what a task holds.
CELL_ROWS = 4096
CELL_ANCHORS = 2048
#: Anchors multiplied at once.
_STRIP = 256
_LONG = 2**63 - 1
#: Sums of whole numbers below this are exact as doubles.
_EXACT = 2**53


# ---- keys ----

#: A key: its order as bytes is (anchor, descending score, positives first, id).
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("negative", "u1"), ("id", ">u8")])
_SIGN = 1 << 63


def pack(anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray, negative: bool) -> np.ndarray:
    ordered = lambda values: np.asarray(values, np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    keys = np.empty(len(ids), KEY)
    keys["anchor"], keys["score"], keys["negative"], keys["id"] = ordered(anchors), ~ordered(scores), negative, ordered(ids)
    return keys


def unpack(key: bytes) -> tuple[int, int, bool, int]:
    anchor, score, negative, row = struct.unpack(">QQBQ", key)
    return anchor - _SIGN, _SIGN - 1 - score, bool(negative), row - _SIGN


def binary(*keys: np.ndarray) -> pa.Array:
    """All keys, one after the other, as binary values."""
    count = sum(map(len, keys))
    offsets = np.arange(count + 1, dtype=np.int32) * np.int32(KEY.itemsize)
    data = b"".join(part.tobytes() for part in keys)  # numpy would concatenate them in another byte order
    return pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


# ---- rows ----


def usable(embeddings: DataFrame, shift: Column | None = None) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part, one for each id.

    Rows with a null id, label or vector, or with a null or non-finite component, do not. Of several rows with one id that with
    the smallest label takes part, then that with the smallest vector; equal rows count once. ``shift`` replaces the label.
    """
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull() & finite)
    label = F.col("label").cast("long") if shift is None else shift
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.alias("label"), vector.alias("vector")).alias("_row"))
    return own.groupBy("vec_id").agg(F.min("_row").alias("_row")).select("vec_id", "_row.label", "_row.vector")


def matrices(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """``(length, positions)`` for each vector length in the table."""
    lengths = np.diff(table["vector"].combine_chunks().offsets.to_numpy()) if len(table) else np.empty(0, int)
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


def scaled(table: pa.Table, places: np.ndarray, length: int) -> np.ndarray:
    """The vectors at ``places``, as doubles times ``SCALE``, rounded down."""
    values = table["vector"].combine_chunks().take(pa.array(places)).flatten()
    with np.errstate(over="ignore"):
        whole = np.floor(SCALE * values.to_numpy(zero_copy_only=False).astype(float))
    return np.clip(whole, -np.finfo(float).max, np.finfo(float).max).reshape(len(places), length)


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: by doubles where these are exact, else by Python's integers.

    A product beyond 64 bits becomes the nearest 64-bit number.
    """
    if max(1, anchors.shape[1]) * (float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0))) < _EXACT:
        return (anchors @ rows.T).astype(np.int64)
    whole = lambda values: np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape)
    found = whole(anchors) @ whole(rows).T
    return np.array([[max(-_LONG, min(_LONG, x)) for x in row] for row in found.tolist()], np.int64).reshape(found.shape)


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties by the smaller id."""
    if len(scores) > 4 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:n]]


def bounds(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The whole scores s with ``low * positive <= 100 * s <= high * positive``, from the least to the most."""
    return -(-low * positive // 100), high * positive // 100


# ---- cells ----


@dataclass(frozen=True)
class Plan:
    positives: int = POSITIVES
    negatives: int = NEGATIVES
    low: int = LOW
    high: int = HIGH


def _cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``cell``: each group of rows meets each group of anchors in one cell."""
    wide, high = math.ceil(n_rows / CELL_ROWS), math.ceil(n_anchors / CELL_ANCHORS)
    spread = lambda id_, n, salt: F.pmod(F.xxhash64(id_, F.lit(salt)), F.lit(n))
    across = F.explode(F.sequence(F.lit(0), F.lit(high - 1)))
    down = F.explode(F.sequence(F.lit(0), F.lit(wide - 1)))
    left = rows.withColumn("_own", spread(F.col("vec_id"), wide, 1)).withColumn("_other", across)
    right = anchors.withColumn("_own", spread(F.col("vec_id"), high, 2)).withColumn("_other", down)
    return (
        left.withColumn("cell", F.col("_own") + F.lit(wide) * F.col("_other")).drop("_own", "_other"),
        right.withColumn("cell", F.col("_other") + F.lit(wide) * F.col("_own")).drop("_own", "_other"),
    )


def _strips(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(place of an anchor, places of rows, their scores)`` for all anchors and the rows of equal length."""
    by_length = dict(matrices(rows))
    for length, places in matrices(anchors):
        if length not in by_length:
            continue
        others = by_length[length]
        right = scaled(rows, others, length)
        for begin in range(0, len(places), _STRIP):
            strip = places[begin : begin + _STRIP]
            for place, scores in zip(strip.tolist(), products(scaled(anchors, strip, length), right)):
                yield place, others, scores


def _positive_keys(plan: Plan):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        own, own_labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        found = []
        for place, others, scores in _strips(anchors, rows):
            same = (labels[others] == own_labels[place]) & (ids[others] != own[place])
            kept, kept_ids = scores[same], ids[others][same]
            top = best(kept, kept_ids, plan.positives)
            found.append(pack(np.full(len(top), own[place]), kept[top], kept_ids[top], False))
        return pa.table({"key": binary(*found)})

    return cell


def _negative_keys(plan: Plan):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        own, own_labels = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        windows = anchors["positive_scores"].to_pylist()
        found = []
        for place, others, scores in _strips(anchors, rows):
            differs = labels[others] != own_labels[place]
            kept, kept_ids = scores[differs], ids[others][differs]
            chosen = set()
            for positive in set(windows[place]):
                least, most = bounds(positive, plan.low, plan.high)
                inside = np.flatnonzero((kept >= least) & (kept <= most))
                chosen.update(inside[best(kept[inside], kept_ids[inside], plan.negatives)].tolist())
            top = np.array(sorted(chosen), int)
            found.append(pack(np.full(len(top), own[place]), kept[top], kept_ids[top], True))
        return pa.table({"key": binary(*found)})

    return cell


def _met(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], cell) -> DataFrame:
    left, right = _cells(rows, anchors, *sizes)
    return right.groupBy("cell").cogroup(left.groupBy("cell")).applyInArrow(cell, "key binary")


def sorted_by_anchor(keys: DataFrame) -> DataFrame:
    """The secondary sort: keys dealt by their anchor, and in order within each partition."""
    return keys.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")


# ---- streams ----


def _firsts(n: int):
    """The first ``n`` keys of each anchor of a sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken = None, 0
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for key in batch["key"].to_pylist():
                anchor, score, _, row = unpack(key)
                last, taken = (last, taken) if anchor == last else (anchor, 0)
                if taken < n:
                    out.append((anchor, score, row))
                    taken += 1
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "score", "positive_id"])

    return run


@dataclass
class Window:
    """A positive and how many negatives it still takes."""

    positive_id: int
    positive_score: int
    low: int
    high: int
    taken: int = 0


@dataclass
class Stream:
    """One pass over the sorted keys: positives open windows, later rows fall into the open ones."""

    plan: Plan
    anchor: int | None = None
    windows: list[Window] = field(default_factory=list)

    def see(self, anchor: int, score: int, negative: bool, row: int) -> Iterable[tuple[int, int, int, int, int, int]]:
        if anchor != self.anchor:
            self.anchor, self.windows = anchor, []
        if not negative:
            self.windows.append(Window(row, score, *bounds(score, self.plan.low, self.plan.high)))
            return
        self.windows = [w for w in self.windows if w.taken < self.plan.negatives and w.low <= score]
        for window in self.windows:
            if score <= window.high:
                window.taken += 1
                yield anchor, window.positive_id, window.taken, row, window.positive_score, score


RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def _mined(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(plan)
        for batch in batches:
            out = []
            for key in batch["key"].to_pylist():
                out += stream.see(*unpack(key))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int32() if name == "rank" else pa.int64() for name in RESULT]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], RESULT)

    return run


def mine(embeddings: DataFrame, anchor: Column, label: Column | None = None, plan: Plan = Plan()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``embeddings(vec_id, embedding, label)``; ``anchor`` tells over ``vec_id`` which rows are anchors, ``label`` replaces the
    label. Which rows take part is told in ``usable``. Only vectors of equal length meet. Scores tie by the smaller id. An anchor
    without positives, or a positive with an empty window (every negative one has one), gives no row. Other columns play no part,
    whatever their names. No rows in, no rows out.
    """
    rows = settle(usable(embeddings, label), "vectors")
    anchors = settle(rows.where(anchor), "anchors")
    sizes = (rows.count(), anchors.count())
    if not sizes[1]:
        return embeddings.sparkSession.createDataFrame([], ", ".join(f"{n} {'int' if n == 'rank' else 'long'}" for n in RESULT))
    candidates = sorted_by_anchor(_met(rows, anchors, sizes, _positive_keys(plan)))
    positives = settle(candidates.mapInArrow(_firsts(plan.positives), "anchor_id long, score long, positive_id long"), "positives")
    opened = positives.groupBy("anchor_id").agg(F.collect_list("score").alias("positive_scores"))  # ``plan.positives`` at most
    asking = anchors.join(opened, anchors["vec_id"] == opened["anchor_id"]).drop("anchor_id")
    negatives = _met(rows, asking, sizes, _negative_keys(plan))

    def opening(batch: pa.RecordBatch) -> Iterable[dict]:
        yield {"key": binary(pack(*(batch[name].to_numpy() for name in ("anchor_id", "score", "positive_id")), False))}

    both = negatives.unionByName(mapped(positives, opening, "key binary"))
    return sorted_by_anchor(both).mapInArrow(_mined(plan), ", ".join(f"{n} {'int' if n == 'rank' else 'long'}" for n in RESULT))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """``mine`` with the anchors and labels of the registered query: every fiftieth id, every seventh id's label moved on by one."""
    own = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (own + 1) % 10).otherwise(own)
    return mine(embeddings, F.col("vec_id") % 50 == 0, moved)


#: SQL for the rows of ``hard_negatives``.
ORACLE = """
WITH parts AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL
), components AS (
    SELECT vec_id, label, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x
    FROM parts
    WHERE vec_id NOT IN (SELECT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x))
), pairs AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(sum(a.x * r.x) AS BIGINT) AS score
    FROM components a JOIN components r ON a.i = r.i AND a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
    GROUP BY a.vec_id, r.vec_id, a.label, r.label
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same
 AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 3
"""
