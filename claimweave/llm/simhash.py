"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most three bits, they differ in at
most one bit of some segment; so each fingerprint enumerates, per segment, the Hamming ball of radius one (33 values),
looks these values up in the table of segments, and compares whole fingerprints where the table has a match.

Only different fingerprints take part. Large groups of near copies would still meet pair by pair, so fingerprints in
crowded buckets are first linked through the points of their radius-one balls (a point has at most 65 fingerprints
around it, which then lie within two bits of each other), and a lookup matches fingerprints of other groups only, from the
smaller group to the larger.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import chosen_rows, last_settled, mapped, settle, text_bytes
from claimweave.llm.components import connected

SEED = 42
SHINGLE = 3
MOST_BITS = 3
SEGMENT_BITS = 32
#: Fingerprints that share a segment before they are linked through ball points first. Any value gives the same result.
CROWD = 16
_PIECE = 1 << 16


def fingerprint(data: bytes) -> int:
    """The unsigned 64-bit fingerprint of UTF-8 bytes: A-Z in lower case, word shingles, each bit by majority."""
    words = data.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) <= SHINGLE:
        shingles: Iterable[bytes] = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    hashed = xxhash.xxh64_intdigest
    values = np.array([hashed(shingle, SEED) for shingle in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(values), _PIECE):
        part = values[begin : begin + _PIECE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and ``fp``, the fingerprint as a signed long; a null text has no words."""
    rows = docs.select(*keep, text_bytes().alias("_utf8"))

    def step(batch: pa.RecordBatch) -> Iterable[dict]:
        found = np.array([fingerprint(data.as_py()) for data in batch["_utf8"]], np.uint64)
        yield {name: batch[name] for name in keep} | {"fp": pa.array(found.view(np.int64))}

    kept = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in keep)
    return mapped(rows, step, f"{kept}, fp long")


def _segments(fp: Column) -> list[Column]:
    return [fp.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)), F.shiftrightunsigned(fp, SEGMENT_BITS)]


def _table(fps: DataFrame) -> DataFrame:
    """``seg, value`` and the other columns: two rows per fingerprint."""
    entries = F.array(*[F.struct(F.lit(i).cast("byte").alias("seg"), value.alias("value")) for i, value in enumerate(_segments(F.col("fp")))])
    return fps.select("*", F.inline(entries))


def _probes(fps: DataFrame) -> DataFrame:
    """``seg, value`` and the other columns: every value within one bit of each segment."""
    flips = F.array(*[F.lit(x).cast("long") for x in [0] + [1 << bit for bit in range(SEGMENT_BITS)]])
    return _table(fps).withColumn("flip", F.explode(flips)).withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip")


def ball_links(fps: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that join all fingerprints within two bits of each other, through the points within one bit of both."""
    flips = F.array(*[F.lit(x).cast("long") for x in [0] + [1 << bit if bit < 63 else -(1 << 63) for bit in range(64)]])
    points = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    near = points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65
    return near.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where(F.col("u") != F.col("v"))


def links(fps: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """``(fp, group)`` of fingerprints grouped beforehand, and verified links ``(u, v)`` between groups.

    A fingerprint that is not in the first table is a group of its own.
    """
    table = _table(fps)
    crowded = table.groupBy("seg", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= crowd).select("seg", "value")
    dense = table.join(crowded, ["seg", "value"], "left_semi").select("fp").distinct()
    early = settle(connected(ball_links(dense)).withColumnsRenamed({"node": "fp", "root": "group"}), "early-groups")
    sizes = early.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    grouped = (
        fps.join(early, "fp", "left")
        .withColumn("group", F.coalesce("group", "fp"))
        .join(sizes, "group", "left")
        .select("fp", "group", F.coalesce("size", F.lit(1)).cast("long").alias("size"))
    )
    grouped = settle(grouped, "grouped-fingerprints")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= MOST_BITS
    return early, candidates(grouped, crowd).where(close).select(F.col("group").alias("u"), F.col("group2").alias("v"))


def _pieces(bucket_size: Column, crowd: int) -> Column:
    """What two fingerprints of a bucket must share besides: in a crowded one a byte of the other segment, else nothing.

    The other segment may differ in three bits, so one of its four bytes is equal. Fingerprints that share a segment and
    nothing else, however many they are, so hardly meet.
    """
    rest = F.when(F.col("seg") == 0, F.shiftrightunsigned("fp", SEGMENT_BITS)).otherwise(F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)))
    piece = lambda part, value: F.struct(F.lit(part).cast("byte").alias("part"), value.cast("long").alias("piece"))
    four = F.array(*[piece(k, F.shiftrightunsigned(rest, 8 * k).bitwiseAND(F.lit(255))) for k in range(SEGMENT_BITS // 8)])
    return F.when(F.coalesce(bucket_size, F.lit(0)) >= crowd, four).otherwise(F.array(piece(-1, F.lit(0))))


def candidates(grouped: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs ``fp, group, fp2, group2`` of ``grouped(fp, group, size)`` whose distance is to be verified.

    Spark sizes what an explode makes like what it is made from, here a 66th, so both joins are told to merge: otherwise the probes
    of some hundred thousand fingerprints pass for a table small enough to be collected in the driver and broadcast.
    """
    rank = F.struct("size", "group")
    # A lookup is worth its join only where the bucket holds a larger group than the one that asks.
    held = _table(grouped).groupBy("seg", "value").agg(F.max(rank).alias("top"), F.count(F.lit(1)).alias("n"))
    asking = _probes(grouped).hint("merge").join(held, ["seg", "value"]).where(rank < F.col("top"))
    asking = asking.select("fp", "group", "size", "seg", "value", F.inline(_pieces(F.col("n"), crowd)))
    crowded = held.where(F.col("n") >= crowd).select("seg", "value", "n")
    other = _table(grouped).join(crowded, ["seg", "value"], "left")
    other = other.select(F.col("fp").alias("fp2"), F.col("group").alias("group2"), F.col("size").alias("size2"), "seg", "value", F.inline(_pieces(F.col("n"), crowd)))
    met = asking.join(other.hint("merge"), ["seg", "value", "part", "piece"]).where(rank < F.struct("size2", "group2"))
    return met.select("fp", "group", "fp2", "group2")


def _classes(own: DataFrame, crowd: int) -> DataFrame:
    """``fp, component, component_id`` of the fingerprints in ``own(doc_id, fp)``: the group and its smallest id."""
    first = settle(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    early, between = links(first.select("fp"), crowd)
    late = connected(between).withColumnsRenamed({"node": "group", "root": "component"})
    roots = (
        first.join(early, "fp", "left")
        .withColumn("group", F.coalesce("group", "fp"))
        .join(late, "group", "left")
        .select("fp", "first_id", F.coalesce("component", "group").alias("component"))
    )
    smallest = roots.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return roots.join(smallest, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id``: fingerprints within three bits link, directly or through others.

    ``component_id`` is the smallest id reachable, the document's own included. Texts without words have fingerprint zero and
    link like any other. Repeated rows come back as often as they came; a null id counts as no id, so ``component_id`` is
    null where a group has none. Other columns play no part. No rows in, no rows out.
    """
    own = settle(fingerprints(docs), "fingerprints")
    classes = _classes(own, crowd).select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_rows(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``wanted_id, wanted_hash, copies``: id and hash of the text of the one row of each group that stays, and how often it comes.

    It is the one with the smallest id, of several texts of this id the one with the smallest hash; a group without ids
    keeps one row as well.
    """

    def found() -> DataFrame:
        rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
        own = settle(fingerprints(rows, ("doc_id", "hash")), "fingerprints")
        held = own.join(_classes(own, crowd), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        counted = held.groupBy("component", "doc_id", "hash").agg(F.count(F.lit(1)).alias("copies"))
        one = counted.groupBy("component").agg(F.min(F.struct("hash", "copies", "doc_id")).alias("row"))
        return settle(one.select(F.col("row.doc_id").alias("wanted_id"), F.col("row.hash").alias("wanted_hash"), "row.copies"), "kept-fingerprints")

    return last_settled(docs.sparkSession, found)


def representatives(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The documents that stay, with all their columns: of each group one row, that of ``kept_rows``."""
    return chosen_rows(docs, kept_rows(docs, crowd))
