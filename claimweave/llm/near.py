"""Near copies by word shingles: MinHash bands propose pairs, the exact Jaccard similarity decides.

A text is its set of five-word shingles, and texts with equal sets are one *class* from the start. A class has a signature of
``BANDS`` x ``ROWS`` minima; classes that agree on a whole band share a bucket. A pair of similarity s is proposed with probability
1 - (1 - s^ROWS)^BANDS, which at 0.8 is 0.99997 and rises with s. Every proposed pair is verified on the shingles of both texts.

Pairs of a bucket are listed only where it has few classes. Crowded buckets hold two kinds of classes. Large groups of near copies
are thinned in ``ROUNDS`` rounds: every class of a crowded bucket is compared with one of them, another one in each bucket and
round, and only one class of each group found goes on. Classes that are alike but no near copies, such as texts around one common
passage, stay; among those the pairs come from their rarest shingles (``rare_pairs``), which the passage is not among. That
step loses no pair of the similarity asked for, so the number of rounds changes the cost and not the groups.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm import blocks
from claimweave.llm.common import chosen_rows, expand, last_settled, mapped, settle, small_batches, squeeze, text_bytes
from claimweave.llm.components import connected

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 4
#: Pairs whose signatures agree on a smaller share are not read again; at 0.8 a share is 5 standard deviations above this.
LEAST_AGREEMENT = 0.55
#: Classes in a bucket from which on its pairs are not listed.
CROWD = 16
#: Rounds in which crowded buckets are thinned.
ROUNDS = 3
#: Rows sent to a Python worker at once: two texts and more may lie in each.
BATCH = 256
_PIECE = 1 << 16
_CHUNK = 1 << 12
_HELD = 1 << 20

_draw = np.random.default_rng(42)
_FACTORS = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_SHIFTS = _draw.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingles(data: bytes) -> np.ndarray:
    """The different word shingles of UTF-8 bytes as ascending hashes: A-Z in lower case; a shorter text is one shingle."""
    words = data.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    parts = []
    for begin in range(0, len(words), _PIECE):
        joined = np.frombuffer(b" ".join(words[begin : begin + _PIECE]), np.uint8)
        parts.append(blocks.word_hashes(joined, *blocks.word_starts(joined)))
    hashes = np.concatenate(parts)
    size = min(WORDS, len(hashes))
    last = len(hashes) - size + 1
    found = blocks.mix(hashes[:last] + np.uint64(size))
    for i in range(1, size):
        found = blocks.mix(found * blocks._B + hashes[i : i + last] * blocks._C)
    return np.unique(found)


def class_key(found: np.ndarray) -> int:
    """A signed 64-bit digest of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64))


def signature(found: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over the shingles, upper 32 bits."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(found), _CHUNK):
        part = found[begin : begin + _CHUNK]
        np.minimum(least, (part * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def _keyed(docs: DataFrame, keep: tuple[str, ...], signed: bool) -> DataFrame:
    """The columns in ``keep`` as ``c0, c1, ...``, and ``key``; with ``signed`` also ``n`` (shingles) and ``sig``."""
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{name}`").alias(own) for own, name in zip(names, keep)], text_bytes().alias("utf8"))

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        keys, sizes, signatures = [], [], []
        for data in batch["utf8"]:
            found = shingles(data.as_py())
            keys.append(class_key(found))
            if signed:
                sizes.append(len(found))
                signatures.append(signature(found).tobytes())
        more = {"n": pa.array(sizes, pa.int64()), "sig": pa.array(signatures, pa.binary())} if signed else {}
        yield {name: batch[name] for name in names} | {"key": pa.array(keys, pa.int64())} | more

    kept = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in names)
    return mapped(rows, step, f"{kept}, key long" + (", n long, sig binary" if signed else ""))


def _buckets(classes: DataFrame) -> DataFrame:
    """``key, n, bucket``: a row per class and band."""

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        rows = np.array([np.frombuffer(sig.as_py(), "<u4") for sig in batch["sig"]], np.uint64).reshape(-1, BANDS, ROWS)
        value = blocks.mix(np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), 1)) * blocks._A)
        for i in range(ROWS):
            value = blocks.mix(value * blocks._B + rows[:, :, i] * blocks._C)
        repeat = lambda name: pa.array(np.repeat(batch[name].to_numpy(), BANDS))
        yield {"key": repeat("key"), "n": repeat("n"), "bucket": pa.array(value.reshape(-1).view(np.int64))}

    return mapped(classes.select("key", "n", "sig"), step, "key long, n long, bucket long")


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose signatures agree on ``LEAST_AGREEMENT`` of their minima."""
    sides = [classes.select(F.col("key").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "uv"]

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        a, b = (np.array([np.frombuffer(sig.as_py(), "<u4") for sig in batch[f"sig_{x}"]]).reshape(-1, BANDS * ROWS) for x in "uv")
        chosen = pa.array((a == b).mean(axis=1) >= LEAST_AGREEMENT)
        yield {x: batch[x].filter(chosen) for x in "uv"}

    return mapped(pairs.join(sides[0], "u").join(sides[1], "v"), step, "u long, v long")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose shingles have a Jaccard similarity of ``SIMILARITY`` at least."""
    sides = [texts.select(F.col("key").alias(x), F.col("packed").alias(f"packed_{x}")) for x in "uv"]
    held: dict[int, np.ndarray] = {}

    def of(key: int, packed: pa.Scalar) -> np.ndarray:
        if key not in held:
            if sum(map(len, held.values())) > _HELD:
                held.clear()
            held[key] = shingles(expand(packed.as_py()))
        return held[key]

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        keys = zip(batch["u"].to_pylist(), batch["packed_u"], batch["v"].to_pylist(), batch["packed_v"])
        chosen = pa.array([jaccard(of(u, a), of(v, b)) >= SIMILARITY for u, a, v, b in keys], pa.bool_())
        yield {x: batch[x].filter(chosen) for x in "uv"}

    return mapped(pairs.join(sides[0], "u").join(sides[1], "v"), step, "u long, v long", held.clear)


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, packed``: one text of every class whose ``key`` is in ``wanted``.

    Rows are chosen by id first, so that only theirs are shingled again.
    """
    asked = settle(classes.join(wanted.distinct(), "key", "left_semi").select("key", "first_id"), "asked-classes")
    near = docs.select("doc_id", "text").join(asked.select("first_id").distinct(), F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    rows = _keyed(near, ("doc_id", "text"), signed=False)
    same = rows["c0"].eqNullSafe(asked["first_id"]) & (rows["key"] == asked["key"])
    one = rows.join(asked, same, "left_semi").dropDuplicates(["key"]).select("key", F.col("c1").alias("text")).select("key", text_bytes().alias("utf8"))

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        yield {"key": batch["key"], "packed": pa.array([squeeze(data.as_py()) for data in batch["utf8"]], pa.binary())}

    return settle(mapped(one, step, "key long, packed binary"), "near-texts")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key")))


def _placed(rows: DataFrame, counted: DataFrame, before: DataFrame) -> DataFrame:
    """The ``rows`` with a shingle in ``counted`` and their ``place`` in their text, after the ``before`` that its ``key`` may have."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("uses", "shingle"))
    met = rows.join(counted.select("shingle", "uses"), "shingle").withColumn("place", place)
    return met.join(before, "key", "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0)))


def rare_pairs(texts: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs ``(u, v)`` of the classes in ``texts(key, packed)`` that can have the similarity, by their rarest shingles.

    Shingles have one order, from the rarest on. Two sets of x <= y shingles with a Jaccard similarity of 4/5 share one of the
    first x - ceil(8x/9) + 1 shingles of the smaller and y - ceil(4y/5) + 1 of the larger, and the one that comes first leaves
    enough after it on both sides for an overlap of 4(x + y)/9. No pair of the similarity is left out. Shingles of ``crowd``
    texts and more are put in order only where a text has too few others, so that common passages are not looked up; any value
    gives the same result.
    """

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        for key, packed in zip(batch["key"].to_pylist(), batch["packed"]):
            found = shingles(expand(packed.as_py()))
            for begin in range(0, len(found), _PIECE):
                part = found[begin : begin + _PIECE].view(np.int64)
                same = lambda value: pa.array(np.full(len(part), value, np.int64))
                yield {"key": same(key), "n": same(len(found)), "shingle": pa.array(part)}

    rows = settle(mapped(texts, step, "key long, n long, shingle long"), "crowded-shingles")
    probing = F.col("n") - F.ceil(F.col("n") * 4 / F.lit(5)) + 1
    counted = settle(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("uses"), F.min("key").alias("key")), "shingle-uses")
    # Shingles of one text are its first and meet nothing; they are numbered as a whole.
    alone = counted.where("uses = 1").groupBy("key").agg(F.count(F.lit(1)).alias("before"))
    few = _placed(rows, counted.where((F.col("uses") > 1) & (F.col("uses") < crowd)), alone)
    few = settle(few.select("key", "n", "shingle", "place"), "rare-shingles")
    # Common shingles come last, and are looked up only for texts whose other ones are too few.
    known = few.groupBy("key").agg(F.count(F.lit(1)).alias("few")).join(alone, "key", "full")
    before = known.select("key", (F.coalesce("few", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("before"))
    short = settle(rows.groupBy("key").agg(F.max("n").alias("n")).join(before, "key", "left").where(F.coalesce("before", F.lit(0)) < probing), "common-texts")
    many = _placed(rows.join(short.select("key"), "key", "left_semi"), counted.where(F.col("uses") >= crowd), short.select("key", "before"))
    first = few.unionByName(many.select("key", "n", "shingle", "place")).where(F.col("place") <= probing)
    first = settle(first.select("key", "n", "shingle", "place"), "rarest-shingles")
    small = first.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 8 / F.lit(9)) + 1)
    small = small.withColumnsRenamed({"key": "key2", "n": "n2", "place": "place2"})
    ordered = (F.col("n2") < F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("key2") < F.col("key")))
    left = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) + 1
    met = first.join(small, "shingle").where(ordered & (F.col("n2") * 5 >= F.col("n") * 4) & (left * 9 >= (F.col("n") + F.col("n2")) * 4))
    return met.select(F.least("key", "key2").alias("u"), F.greatest("key", "key2").alias("v")).distinct()


def _thinned(classes: DataFrame, links: DataFrame) -> DataFrame:
    """One class of each group that the links make: the one with the smallest id, a class without ids last."""
    roots = connected(links).select(F.col("node").alias("key"), "root")
    grouped = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "key")).alias("first")
    stay = grouped.groupBy("root").agg(first).select("first.key")
    return settle(classes.join(stay, "key", "left_semi"), "thinned-classes")


def representatives(docs: DataFrame, crowd: int = CROWD, rounds: int = ROUNDS, among: DataFrame | None = None) -> DataFrame:
    """The documents that stay, with all their columns, whatever these are called: one of each group of near copies.

    It is the one with the smallest id. Groups come from verified pairs, directly or through others. Rows that share this id
    and their shingles count once; a group without ids keeps one row. Null and empty texts, and texts without words, are copies
    of each other; a text of fewer than five words is one shingle, and a very long one is read whole. No rows in, no rows out.

    With ``among(wanted_id, wanted_hash, copies)`` only rows with these ids and hashes of the text take part.
    """

    def wanted() -> DataFrame:
        rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
        with small_batches(docs.sparkSession, BATCH):
            own = _keyed(rows, ("doc_id", "hash"), signed=True)
            if among is not None:
                own = own.join(among, own["c0"].eqNullSafe(among["wanted_id"]) & (own["c1"] == among["wanted_hash"]), "left_semi")
            own = settle(own, "shingle-keys")
            classes = settle(_kept(docs, own, crowd, rounds), "kept-classes")
        same = own["c0"].eqNullSafe(classes["first_id"]) & (own["key"] == classes["key"])
        kept = own.join(classes, same, "left_semi").groupBy("c0", "key", "c1").agg(F.count(F.lit(1)).alias("copies"))
        one = kept.groupBy("c0", "key").agg(F.min(F.struct("c1", "copies")).alias("row"))
        return settle(one.select(F.col("c0").alias("wanted_id"), F.col("row.c1").alias("wanted_hash"), "row.copies"), "kept-rows")

    return chosen_rows(docs, last_settled(docs.sparkSession, wanted))


def _kept(docs: DataFrame, own: DataFrame, crowd: int, rounds: int) -> DataFrame:
    """``key, first_id`` of the classes that stay; ``own`` has id, key and signature of every row."""
    merged = own.groupBy("key").agg(F.min("c0").alias("first_id"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    classes = settle(merged, "shingle-classes")
    similar = lambda n, m: F.least(n, m) * 5 >= F.greatest(n, m) * 4
    ordered = lambda a, b: [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]

    def linked(pairs: DataFrame) -> DataFrame:
        likely = settle(_agreeing(pairs.distinct(), classes), "near-pairs")
        return settle(_verified(likely, _texts(docs, classes, _ends(likely))), "near-links")

    def thinned(pairs: DataFrame) -> DataFrame:
        return last_settled(docs.sparkSession, lambda: _thinned(classes, linked(pairs)))

    for round_ in range(rounds + 1):
        buckets = settle(_buckets(classes), "buckets")
        rank = F.xxhash64("key", "bucket", F.lit(round_))
        counted = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(rank.alias("rank"), "key", "n")).alias("top"))
        crowded = settle(counted.where(F.col("size") >= crowd).select("bucket", F.col("top.key").alias("key2"), F.col("top.n").alias("n2")), "crowded")
        if round_ == rounds or crowded.isEmpty():
            break
        met = buckets.join(crowded, "bucket").where((F.col("key") != F.col("key2")) & similar(F.col("n"), F.col("n2")))
        classes = thinned(met.select(*ordered("key", "key2")))
    loose = buckets.join(crowded.select("bucket"), "bucket", "left_anti")
    other = loose.withColumnsRenamed({"key": "key2", "n": "n2"})
    met = loose.join(other, "bucket").where((F.col("key") < F.col("key2")) & similar(F.col("n"), F.col("n2")))
    tight = buckets.join(crowded.select("bucket"), "bucket", "left_semi").select("key")
    pairs = met.select(*ordered("key", "key2")).unionByName(rare_pairs(_texts(docs, classes, tight)))
    return thinned(pairs).select("key", "first_id")
