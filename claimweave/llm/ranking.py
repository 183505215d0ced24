"""Quality scores from pairwise preferences (Bradley-Terry).

A document has a utility that is linear in measurements of its text. Of two documents the better one is preferred with
probability ``sigmoid(utility of the better - utility of the worse)``; the weights minimise the logistic loss over preference
pairs, on the differences of their measurements. Only differences count, so utilities have no natural zero: documents are kept
from a quantile of the utilities on. Scores are utilities moved so that this quantile lies at ``THRESHOLD``.

Measurements see nothing but the text. Preferences come from a table of pairs, or from labels: every document that is
labelled 1 is preferred to a few that are labelled 0, and the reverse.

All labelled documents that may be learned from are read. Their measurements are dealt into *blocks* of bounded size by a hash of
the id, and partners are drawn inside a block; where one label is rare, its rows are partners in several blocks. A block is a row
of a written table, so each Newton step, and each digit of a quantile, is a sum over the blocks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import mapped, settle, small_batches

#: Pairs that a fit on a table of preferences reads at most; chosen by a hash of both ids.
SAMPLE_ROWS = 6_000
#: Labelled rows in a block on average, and rows of the rarer label that a block has at least, if there are so many.
BLOCK_ROWS = 4_096
BLOCK_PARTNERS = 64
#: Groups that sums over blocks are gathered in.
PARTS = 16
#: Preference pairs in which a document of the rarer and of the more frequent label takes part on its own account.
PARTNERS = 8
#: The score at the quantile from which on documents are kept.
THRESHOLD = 0.7
#: Characters measured at once; counts of pieces are added up.
PIECE = 1 << 20

SYMBOLS = "#*$%&|<>"
STOPS = ".,;:!?"
_SPACE = re.compile(r"\s")

#: What ``measures`` returns, in this order.
MEASURES = (
    "log_words", "word_length", "length_spread", "longest_word", "variety", "top_share", "repeats_previous", "repeated_pairs",
    "symbols_per_word", "symbol_words", "letterless_words", "upper_letters", "capital_words", "shout_words", "marks_per_word",
    "exclaims_per_word", "digits", "other_characters", "short_words", "words_per_stop", "repeated_lines", "line_words",
)


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``PIECE`` characters, cut at white space; a word without end is one piece."""
    begin = 0
    while begin < len(text):
        found = _SPACE.search(text, begin + PIECE) if begin + PIECE < len(text) else None
        end = found.start() if found else len(text)
        yield text[begin:end]
        begin = end


def measures(text: str) -> list[float]:
    """Measurements of a whole text; all zero if it has no words."""
    words: Counter[str] = Counter()
    pairs: set[tuple[int, int]] = set()
    n = n_pairs = repeats = 0
    letters = upper = digits = other = symbols = marks = exclaims = stops = 0
    last = None
    for piece in _pieces(text):
        own = piece.split()
        words.update(own)
        n += len(own)
        if last is not None:
            own.insert(0, last)
        repeats += sum(map(str.__eq__, own, own[1:]))
        hashes = list(map(hash, own))
        pairs.update(zip(hashes, hashes[1:]))
        n_pairs += max(0, len(own) - 1)
        last = own[-1] if own else last
        symbols += sum(map(piece.count, SYMBOLS))
        by_mark = {mark: piece.count(mark) for mark in STOPS}
        marks += sum(by_mark.values())
        exclaims += by_mark["!"]
        stops += by_mark["."] + by_mark["!"] + by_mark["?"]
        points = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
        lowered = piece.lower()
        if len(lowered) == len(piece):
            upper += int((points != np.frombuffer(lowered.encode("utf-32-le", "replace"), np.uint32)).sum())
        else:  # a few letters become two in lower case
            upper += sum(map(str.isupper, piece))
        digits += int(((points >= 48) & (points <= 57)).sum())
        plain = ((points >= 97) & (points <= 122)) | ((points >= 65) & (points <= 90)) | (points >= 192)
        letters += int(plain.sum())
        other += int(((points > 32) & ~plain & ~((points >= 48) & (points <= 57))).sum())
    if not n:
        return [0.0] * len(MEASURES)
    total = squares = longest = symbol_words = letterless = capital = shout = short = top = 0
    for word, count in words.items():
        size = len(word)
        total += count * size
        squares += count * size * size
        longest = max(longest, size)
        short += count * (size <= 3)
        top = max(top, count)
        capital += count * word[0].isupper()
        shout += count * (size > 1 and word.isupper())
        if not word.isalpha():
            letterless += count * (word.lower() == word.upper())
            symbol_words += count * any(symbol in word for symbol in SYMBOLS)
    lines = Counter(filter(None, map(str.strip, text.split("\n"))))
    n_lines = sum(lines.values())
    mean = total / n
    values = (
        math.log1p(n), mean, math.sqrt(max(0.0, squares / n - mean * mean)), math.log1p(longest),
        math.log1p(len(words)) / math.log1p(n), top / n, repeats / n, 1 - len(pairs) / n_pairs if n_pairs else 0.0,
        symbols / n, symbol_words / n, letterless / n, upper / max(1, letters), capital / n, shout / n, marks / n,
        exclaims / n, digits / total, other / total, short / n, math.log1p(n / max(1, stops)),
        1 - len(lines) / max(1, n_lines), math.log1p(n / max(1, n_lines)),
    )
    return [float(value) for value in values]


def expanded(values: np.ndarray) -> np.ndarray:
    """Standardised measurements and their distances from the usual value, so that too much and too little can both count."""
    held = np.clip(values, -6.0, 6.0)
    return np.concatenate([held, np.abs(held)], axis=1)


@dataclass
class Model:
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float = 0.0

    def utilities(self, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.empty(0)
        return expanded((np.asarray(rows, float) - self.middle) / self.spread) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1, ``THRESHOLD`` at the cut."""
        logit = self.utilities(rows) - self.cut + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(logit, -500.0, 500.0)))


def constant() -> Model:
    """The model without preferences: every document is at the threshold."""
    size = len(MEASURES)
    return Model(np.zeros(size), np.ones(size), np.zeros(2 * size))


def newton(size: int, sums: Callable[[np.ndarray], tuple[int, np.ndarray, np.ndarray]], ridge: float, steps: int) -> np.ndarray:
    """Weights that minimise the mean logistic loss plus ``ridge`` times their squares, from ``pair_sums`` at given weights."""
    weights = np.zeros(size)
    for _ in range(steps):
        pairs, slope, curve = sums(weights)
        gradient = slope / pairs + 2 * ridge * weights
        step = np.linalg.solve(curve / pairs + 2 * ridge * np.eye(size), gradient)
        weights -= step * min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return weights


def pair_sums(difference: np.ndarray, weights: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of pairs, and the sums of the loss's first and second derivatives over their differences."""
    chance = 1 / (1 + np.exp(np.clip(difference @ weights, -50, 50)))  # of the wrong order
    return len(difference), -difference.T @ chance, (difference * (chance * (1 - chance))[:, None]).T @ difference


def fit(rows: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> Model:
    """Weights for measurements ``rows`` under the preferences ``rows[better[k]]`` over ``rows[worse[k]]``.

    Newton steps on the mean logistic loss of the differences plus ``ridge`` times the squared weights. Without a
    preference the model is constant.
    """
    if not len(better):
        return constant()
    middle = np.median(rows, axis=0)
    spread = rows.std(axis=0)
    spread[spread < 1e-9] = 1.0
    spaced = expanded((rows - middle) / spread)
    difference = spaced[better] - spaced[worse]
    return Model(middle, spread, newton(spaced.shape[1], lambda weights: pair_sums(difference, weights), ridge, steps))


def quantile_cut(utilities: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The utility below which ``share`` of the weight lies: the middle between the two utilities on its sides."""
    order = np.argsort(utilities, kind="stable")
    values, reached = utilities[order], np.cumsum(weights[order])
    place = int(np.searchsorted(reached, share * reached[-1] * (1 + 1e-12), side="right"))
    if place >= len(values):
        return float(values[-1]) + 1e-9
    return float(values[place]) if place == 0 else float((values[place - 1] + values[place]) / 2)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def measured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns in ``keep`` with ``measures`` of the text, a null text being empty."""
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        found = pa.array([measures(text.as_py()) for text in batch["_text"]], pa.list_(pa.float64()))
        yield {name: batch[name] for name in keep} | {"measures": found}

    kept = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in keep)
    return mapped(rows, step, f"{kept}, measures array<double>")


def _once(rows: DataFrame, *more: str) -> pa.Table:
    """One row for each id, the one with the smallest measurements, so that at most one row an id leaves the executors."""
    return rows.groupBy("doc_id", *more).agg(F.min("measures").alias("measures")).toArrow().sort_by("doc_id")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, quality, measures`` of every labelled document that may be learned from, written once.

    Rows of the held-out quarter, null labels, and ids with several labels are left out. Several documents of one id
    count as one, the one with the smallest measurements.
    """
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
        .where((F.col("quality") == F.col("_most")) & F.col("quality").isin(0, 1))
        .select("doc_id", F.col("quality").cast("int").alias("quality"))
    )
    # Measured before the join, so that measurements are moved and not texts.
    rows = measured(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), ("doc_id",))
    return settle(rows.join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("measures").alias("measures")), "labelled-measures")


def dealt(rows: DataFrame, sizes: dict[int, int], block_rows: int = BLOCK_ROWS, block_partners: int = BLOCK_PARTNERS) -> DataFrame:
    """``block, marks, own, data`` of labelled rows: a written row a block, measurements packed.

    Every row has one block of its own, by a hash of its id. Rows of the rarer label also lie, as partners only, in as many more
    blocks as it takes that a block has ``block_partners`` of them, or all there are.
    """
    blocks = max(1, math.ceil(sum(sizes.values()) / block_rows))
    rarer = min(sizes, key=lambda label: (sizes[label], label))
    copies = min(blocks, math.ceil(block_partners * blocks / sizes[rarer]))
    last = F.when(F.col("quality") == rarer, copies - 1).otherwise(0)
    placed = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), last))).withColumn(
        "block", F.pmod(F.xxhash64("doc_id") + F.col("turn"), F.lit(blocks)).cast("int")
    )

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("turn", "ascending")])
        data = np.array([row.values.to_numpy() for row in table["measures"]], "<f8").tobytes()
        own = np.equal(table["turn"].to_numpy(), 0).tolist()
        columns = {"block": pa.array([table["block"][0].as_py()], pa.int32()), "marks": pa.array([table["quality"].to_pylist()], pa.list_(pa.int32()))}
        return pa.table(columns | {"own": pa.array([own], pa.list_(pa.bool_())), "data": pa.array([data], pa.binary())})

    schema = "block int, marks array<int>, own array<boolean>, data binary"
    return settle(placed.groupBy("block").applyInArrow(pack, schema), "preference-blocks")


#: Sums over a block, from its measurements, labels, which rows are its own, and its number.
Step = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def summed(blocks: DataFrame, step: Step) -> np.ndarray:
    """The sum of ``step`` over all blocks, added in the order of their numbers."""

    def each(batch: pa.RecordBatch) -> Iterable[dict]:
        for block, marks, own, data in zip(batch["block"].to_pylist(), batch["marks"], batch["own"], batch["data"]):
            rows = np.frombuffer(data.as_py(), "<f8").reshape(-1, len(MEASURES))
            found = step(rows, marks.values.to_numpy(), np.array(own.as_py(), bool), block)
            yield {"block": pa.array([block], pa.int32()), "sums": pa.array([found], pa.list_(pa.float64()))}

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        total = np.add.reduce([row.values.to_numpy() for row in table["sums"]])
        return pa.table({"part": pa.array([table["block"][0].as_py() % PARTS], pa.int32()), "sums": pa.array([total], pa.list_(pa.float64()))})

    with small_batches(blocks.sparkSession, 1):  # a row is large here
        parts = mapped(blocks, each, "block int, sums array<double>").groupBy((F.col("block") % PARTS).alias("part"))
        found = parts.applyInArrow(add, "part int, sums array<double>").toArrow().sort_by("part")
    return np.add.reduce([row.values.to_numpy() for row in found["sums"]])


def sortable(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def unsortable(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >> np.uint64(63) == 1, keys & np.uint64((1 << 63) - 1), ~keys).view(np.float64)


def order_values(blocks: DataFrame, columns: Callable[[np.ndarray], np.ndarray], ranks: np.ndarray) -> np.ndarray:
    """The value at ``ranks[k]`` (from 0, ascending) of column k of ``columns(rows)`` over the own rows of all blocks.

    Exact: each pass over the blocks counts one more byte of the values that agree with what is known so far.
    """
    found, left = np.zeros(len(ranks), np.uint64), np.array(ranks, np.int64)
    for shift in range(56, -1, -8):

        def digits(rows, marks, own, block, shift=shift, found=found.copy()):
            keys = sortable(np.ascontiguousarray(columns(rows[own])))
            same = (keys >> np.uint64(shift) >> np.uint64(8)) == found if shift < 56 else np.ones(keys.shape, bool)
            digit = (keys >> np.uint64(shift) & np.uint64(255)).astype(np.int64)
            return np.concatenate([np.bincount(digit[same[:, k], k], minlength=256) for k in range(len(found))]).astype(float)

        counts = summed(blocks, digits).reshape(len(ranks), 256).astype(np.int64)
        reached = np.cumsum(counts, axis=1)
        digit = (reached <= left[:, None]).sum(axis=1)
        left -= np.where(digit > 0, reached[np.arange(len(ranks)), np.maximum(digit - 1, 0)], 0)
        found = found << np.uint64(8) | digit.astype(np.uint64)
    return unsortable(found)


def preferences(labels: np.ndarray, partners: int = PARTNERS, seed: int | list[int] = 42, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (better, worse) of rows with different labels; each row, or each ``own`` one, meets ``partners`` drawn ones of the other label."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return np.empty(0, int), np.empty(0, int)
    own_good, own_bad = (good, bad) if own is None else (good[own[good]], bad[own[bad]])
    draw = np.random.default_rng(seed)
    better = np.concatenate([np.repeat(own_good, partners), good[draw.integers(0, len(good), partners * len(own_bad))]])
    worse = np.concatenate([bad[draw.integers(0, len(bad), partners * len(own_good))], np.repeat(own_bad, partners)])
    return better, worse


def train(docs: DataFrame, labels: DataFrame, ridge: float = 1e-3, steps: int = 60, block_rows: int = BLOCK_ROWS) -> Model:
    """A model from all labelled documents outside the held-out quarter.

    The cut is the quantile of their utilities at the share of label 0 among them: the middle between the two utilities on its
    sides. With labels of one kind only, or none, the model is constant.
    """
    rows = labelled(docs, labels)
    sizes = {row["quality"]: row["count"] for row in rows.groupBy("quality").count().collect()}  # two rows at most
    if len(sizes) < 2:
        return constant()
    blocks, n = dealt(rows, sizes, block_rows), sum(sizes.values())
    size = len(MEASURES)

    middles = order_values(blocks, lambda values: np.tile(values, 2), np.repeat([(n - 1) // 2, n // 2], size))
    middle = (middles[:size] + middles[size:]) / 2
    moments = summed(blocks, lambda values, marks, own, block: np.concatenate([(values[own] - middle).sum(axis=0), ((values[own] - middle) ** 2).sum(axis=0)])) / n
    spread = np.sqrt(np.maximum(0.0, moments[size:] - moments[:size] ** 2))
    spread[spread < 1e-9] = 1.0

    def sums(weights: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        def step(values, marks, own, block):
            spaced = expanded((values - middle) / spread)
            better, worse = preferences(marks, seed=[42, block], own=own)
            pairs, slope, curve = pair_sums(spaced[better] - spaced[worse], weights)
            return np.concatenate([[pairs], slope, curve.ravel()])

        found = summed(blocks, step)
        return int(found[0]), found[1 : 2 * size + 1], found[2 * size + 1 :].reshape(2 * size, 2 * size)

    model = Model(middle, spread, newton(2 * size, sums, ridge, steps))
    below, above = order_values(blocks, lambda values: np.repeat(model.utilities(values)[:, None], 2, axis=1), np.array([sizes[0] - 1, sizes[0]]))
    model.cut = float((below + above) / 2)
    return model


def train_on_pairs(docs: DataFrame, pairs: DataFrame, reject_share: float, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from preference pairs ``(better_id, worse_id)``, the cut at ``reject_share`` of the documents in them.

    At most ``sample_rows`` different pairs are read, chosen by a hash of both ids; pairs with a null id, of one id twice, or
    without a document on both sides say nothing.
    """
    chosen = (
        pairs.select("better_id", "worse_id").where("better_id <> worse_id").distinct()
        .orderBy(F.xxhash64("better_id", "worse_id"), "better_id", "worse_id").limit(sample_rows)
    )
    drawn = chosen.toArrow()
    spark = docs.sparkSession
    wanted = spark.createDataFrame(drawn).select(F.explode(F.array("better_id", "worse_id")).alias("doc_id")).distinct()
    found = _once(measured(docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id"), ("doc_id",)))
    place = {doc_id: i for i, doc_id in enumerate(found["doc_id"].to_pylist())}
    rows = np.array(found["measures"].to_pylist(), float).reshape(-1, len(MEASURES))
    known = [(place[a], place[b]) for a, b in zip(drawn["better_id"].to_pylist(), drawn["worse_id"].to_pylist()) if a in place and b in place]
    better, worse = np.array(known, int).reshape(-1, 2).T
    model = fit(rows, better, worse)
    if len(better):
        model.cut = quantile_cut(model.utilities(rows), np.ones(len(rows)), reject_share)
    return model


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The columns in ``keep`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Every whole text is scored on its own, so repeated rows agree and other columns, whatever their names, play no part; a null
    text is an empty one, whose measurements are all zero. No rows in, no rows out.
    """
    rows = docs.select(*[F.col(name).alias(f"_k{i}") for i, name in enumerate(keep)], F.coalesce("text", F.lit("")).alias("_text"))
    names = [f"_k{i}" for i in range(len(keep))]

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        found = np.array([measures(text.as_py()) for text in batch["_text"]], float).reshape(-1, len(MEASURES))
        yield {name: batch[name] for name in names} | {"score": pa.array(model.scores(found), pa.float64())}

    kept = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in names)
    found = mapped(rows, step, f"{kept}, score double")
    own = [F.col(f"_k{i}").alias(name) for i, name in enumerate(keep)]
    return found.select(*own, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
