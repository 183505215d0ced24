"""Toxicity scores from a counterfactually regularised classifier.

A logistic model over the words of a text and their beginnings is fitted on a bounded sample of labelled texts. Where a
labelled text names a group, the same text with the name swapped for other groups, and for a neutral word, should score
alike; the fit penalises the squared change of the log-odds, so that no weight can settle on the mention itself. Scores see
nothing but the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import mapped, release_memory

#: Labelled rows that a fit reads at most; chosen by a hash of the id among all rows that may be learned from.
SAMPLE_ROWS = 12_000
#: Features are hashed into so many slots.
SLOTS = 1 << 20
THRESHOLD = 0.3
#: Words whose slots a task remembers; beyond it the memory starts anew.
REMEMBERED = 100_000

# Names of groups that may stand for each other, each list ending in a neutral word.
IDENTITY_TERMS = (
    ("women", "men", "muslims", "christians", "jews", "hindus", "immigrants", "refugees", "gays", "lesbians", "blacks", "whites", "asians", "people"),
    ("woman", "man", "muslim", "christian", "jew", "hindu", "immigrant", "refugee", "lesbian", "person"),
    ("female", "male", "islamic", "jewish", "gay", "black", "white", "asian", "african", "american", "disabled", "local"),
    ("frauen", "männer", "muslime", "christen", "juden", "migranten", "leute"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "gens"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "gente"),
)
TRIM = ".,;:!?\"'()[]{}|*#%&$<>-_…«»“”"


def words_of(text: str) -> set[str]:
    return {word.strip(TRIM) for word in set(text.lower().split())}


def slots_of(word: str) -> tuple[int, ...]:
    """Slots of a word and of its first four, five and six letters."""
    if not word:
        return ()
    names = [f"w{word}"] + [f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n]
    return tuple(xxhash.xxh3_64_intdigest(name) % SLOTS for name in names)


class Memory(dict):
    """Slots by word, bounded."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = slots_of(word)
        return found


_memory = Memory()


def forget() -> None:
    """Drop what a task remembered, so that an idle worker holds nothing of it."""
    _memory.clear()


def features(text: str) -> set[int]:
    out: set[int] = set()
    for word in words_of(text):
        out.update(_memory[word])
    return out


def counterfactuals(text: str, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> list[set[int]]:
    """Features of the text with every named group swapped: once for the next group of its list, once for the neutral word."""
    following = {term: group[(i + 1) % len(group)] for group in terms for i, term in enumerate(group)}
    neutral = {term: group[-1] for group in terms for term in group}
    words = words_of(text)
    if not words & following.keys():
        return []
    return [set().union(*(slots_of(swap.get(word, word)) for word in words)) for swap in (following, neutral)]


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        get = self.weights.get
        total = self.bias + sum(get(slot, 0.0) for slot in features(text))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))


def fit(rows: list[tuple[list[int], list[list[int]], int]], **options) -> Model:
    """Fit to ``(slots, slots of each counterfactual, label)`` rows; options as in ``fit_arrays``."""
    lengths = np.array([len(slots) for slots, _, _ in rows], np.int64)
    flat = np.fromiter((slot for slots, _, _ in rows for slot in slots), np.int32, int(lengths.sum()))
    changes = [difference(slots, other) for slots, others, _ in rows for other in others]
    return fit_arrays(flat, lengths, np.array([label for *_, label in rows], float), changes, **options)


def difference(slots: list[int], other: list[int]) -> list[tuple[int, float]]:
    """The slots that a counterfactual changes: 1 where the text alone has them, else -1."""
    own, swapped = set(slots), set(other)
    return [(slot, 1.0 if slot in own else -1.0) for slot in own ^ swapped]


def _counted(slots: np.ndarray) -> np.ndarray:
    """How often each slot occurs; ``bincount`` widens what it is given, so that is a piece at a time."""
    total = np.zeros(SLOTS, np.int64)
    for begin in range(0, len(slots), SLOTS):
        total += np.bincount(slots[begin : begin + SLOTS], minlength=SLOTS)
    return total


def fit_arrays(
    flat: np.ndarray, lengths: np.ndarray, labels: np.ndarray, changes: list[list[tuple[int, float]]],
    penalty: float = 4.0, ridge: float = 0.02, steps: int = 300, least: int = 3, excess: float = 3.5,
) -> Model:
    """Fit to texts given by their slots one after the other, and to what counterfactuals change, as from ``difference``.

    Slots on fewer than ``least`` texts, or less than ``excess`` standard deviations more frequent among toxic ones than chance
    would have it, are left out first: rare words of long texts would only add noise to their scores. With no texts, or one
    label only, the model is a constant.
    """
    n, positive = len(labels), float(labels.sum())
    bias = math.log((positive + 0.5) / (n - positive + 0.5))
    if not positive or positive == n:
        return Model(bias)
    total = _counted(flat)
    hits = _counted(flat[np.repeat(labels > 0, lengths)])
    share = positive / n
    z = (hits - total * share) / np.sqrt(np.maximum(total * share * (1 - share), 1e-9))
    used = (total >= least) & (z >= excess)
    changed = sorted({slot for change in changes for slot, _ in change})
    used[changed] |= total[changed] > 0
    place = np.cumsum(used) - 1
    size = int(used.sum())
    if not size:
        return Model(bias)
    keep = np.flatnonzero(used[flat])
    column, line = place[flat[keep]], np.searchsorted(np.cumsum(lengths), keep, side="right")
    # Differences between a text and its counterfactual, on the slots in use.
    pair, pair_column, pair_sign = [], [], []
    for p, change in enumerate(changes):
        for slot, sign in change:
            if used[slot]:
                pair.append(p), pair_column.append(place[slot]), pair_sign.append(sign)
    pair, pair_column, pair_sign = np.array(pair, int), np.array(pair_column, int), np.array(pair_sign)
    weights, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    weights[-1] = bias
    for step in range(1, steps + 1):
        logit = np.bincount(line, weights=weights[column], minlength=n) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels
        gradient = np.append(np.bincount(column, weights=error[line], minlength=size), error.sum())
        gradient[:-1] += ridge * weights[:-1] * 2
        if len(pair):
            change = np.bincount(pair, weights=pair_sign * weights[pair_column], minlength=len(changes))
            gradient[:-1] += np.bincount(pair_column, weights=2 * penalty * pair_sign * change[pair], minlength=size)
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) / math.sqrt(1 + step / 50)
    return Model(float(weights[-1]), {int(slot): float(w) for slot, w in zip(np.flatnonzero(used), weights)})


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, penalty: float = 4.0) -> Model:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out ones, drawn by a hash of the id.

    Labels that are null or whose id is null, or has several labels, are left out. Without labels the model is a constant.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
        .where(F.col("toxic") == F.col("_most"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    )
    # At most ``sample_rows`` narrow rows.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(F.broadcast(known), "doc_id")

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        texts = [text.as_py() or "" for text in batch["text"]]
        yield {
            "doc_id": batch["doc_id"],
            "toxic": batch["toxic"],
            "hash": batch["hash"],
            "slots": pa.array([sorted(features(text)) for text in texts], pa.list_(pa.int32())),
            "others": pa.array([[sorted(other) for other in counterfactuals(text)] for text in texts], pa.list_(pa.list_(pa.int32()))),
        }

    found = mapped(rows, step, "doc_id long, toxic int, hash long, slots array<int>, others array<array<int>>", forget)
    # Repeated rows of one id count once, and of different texts that with the smallest hash: one row an id leaves the executors.
    once = found.groupBy("doc_id").agg(F.min(F.struct("hash", "toxic", "slots", "others")).alias("row"))
    model = fit_arrays(*_gathered(once.select("doc_id", "row.toxic", "row.slots", "row.others").toArrow()), penalty=penalty)
    release_memory()
    return model


def _gathered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[int, float]]]]:
    """Slots one after the other, their number per row, labels and changes of the rows in the order of their ids.

    The rows are most of what training holds in the driver, so they are neither copied whole nor turned into Python objects.
    """
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    batches = rows.to_batches()
    starts = np.cumsum([0] + [len(batch) for batch in batches])
    size = sum(len(batch["slots"].flatten()) for batch in batches)
    flat, lengths, changes, at = np.empty(size, np.int32), np.empty(len(order), np.int64), [], 0
    for i, (row, which) in enumerate(zip(order.tolist(), (np.searchsorted(starts, order, side="right") - 1).tolist())):
        slots, others = (batches[which][name][row - int(starts[which])] for name in ("slots", "others"))
        own = slots.values.to_numpy()
        lengths[i] = len(own)
        flat[at : at + len(own)] = own
        at += len(own)
        changes += [difference(own.tolist(), other.as_py()) for other in others.values]
    return flat, lengths, rows["toxic"].to_numpy()[order].astype(float), changes


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns in ``keep`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Every whole text is scored; a null or empty text has the score of the bias. Rows are scored one by one, so repeated
    rows agree and other columns play no part. No rows in, no rows out.
    """
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most SLOTS weights

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        own = shared.value
        scores = [own.score(text.as_py() or "") for text in batch["text"]]
        yield {name: batch[name] for name in keep} | {"score": pa.array(scores, pa.float64())}

    kept = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in keep)
    return mapped(rows, step, f"{kept}, score double", forget).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
