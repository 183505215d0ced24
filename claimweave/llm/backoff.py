"""Stupid-backoff language-model scores from n-gram count tables partitioned by hash.

1. Texts are gathered into *packs* of bounded size. Each pack lists its different n-grams with their counts, cut by hash
   range, so an n-gram that is everywhere costs one entry per pack.
2. A hash range is one partition of the count tables: the entries of all packs are added up there and joined back to
   the packs that asked.
3. Each pack explodes its texts into n-grams again, meets their totals, and sums the scores per document.

Steps 1 and 2 run once per length. A pack lists an n-gram only where both (n-1)-grams in it reach the cutoff; any other occurs
less often than the cutoff itself, so no score needs its count.

Entries travel as sorted columns of hashes, not as a row each. Words are hashed once: a pack holds the hashes of its different
words and, for each word of its texts, which of them it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm import blocks
from claimweave.llm.common import expand, release_memory, settle, small_batches, squeeze, text_bytes

ORDER = 5
#: Factor of each step to a shorter history.
ALPHA = 0.4
#: n-grams of two and more words that occur less often are not in the tables.
CUTOFF = 2
PACK_BYTES = 8 << 20
_SLICE = 1 << 20

PACK = "pack long, size long, n_words long, rows array<long>, lengths array<long>, hashes binary, places binary"


def _gathered(pack_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        count, held, ids, size = 0, [], [], 0

        def pack() -> pa.RecordBatch:
            words, lengths = _hashed(held)
            hashes, places, uses = np.unique(words, return_inverse=True, return_counts=True)
            order = np.argsort(-uses, kind="stable")  # frequent words get small numbers, which take little room
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order), dtype=np.uint32)
            columns = {
                "pack": [task << 32 | count],
                "size": [size],
                "n_words": [len(words)],
                "rows": pa.array([ids], pa.list_(pa.int64())),
                "lengths": pa.array([lengths], pa.list_(pa.int64())),
                "hashes": pa.array([_to_bytes(np.diff(hashes[order], prepend=np.uint64(0)))], pa.binary()),  # ascending for each number of uses
                "places": pa.array([_to_bytes(number[places])], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["_utf8"]):
                data = b" ".join(text.as_py().split())
                held.append(data)
                ids.append(doc_id)
                size += len(data)
                if size >= pack_bytes:
                    yield pack()
                    count, held, ids, size = count + 1, [], [], 0
        if held:
            yield pack()
        release_memory()

    return run


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of texts one after the other, and how many words each text has; some texts at a time."""
    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    group, size = [], 0
    for i, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size >= _SLICE or i == len(texts) - 1:
            h, c = _hash_texts(group)
            hashes.append(h)
            counts.append(c)
            group, size = [], 0
    return np.concatenate(hashes), np.concatenate(counts)


def _hash_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As ``_hashed``, of texts whose words are joined by single spaces; they are hashed all at once."""
    counts = np.array([text.count(b" ") + 1 if text else 0 for text in texts], np.int64)
    joined = np.frombuffer(b" ".join(filter(None, texts)), np.uint8)
    return blocks.word_hashes(joined, *blocks.word_starts(joined)), counts


class Grams:
    """The word hashes of a pack, and n-gram hashes length by length: an entry per word, unset (0) near a text's begin."""

    def __init__(self, hashes: bytes, places: bytes, n_words: np.ndarray):
        self.hashes = np.cumsum(_from_bytes(hashes), dtype=np.uint64)
        self.places = _from_bytes(places).astype(np.int64)
        self.words = self.keys = self.hashes[self.places]
        self.n_words = n_words
        first = np.cumsum(self.n_words) - self.n_words
        self.place = (np.arange(len(self.keys)) - np.repeat(first, self.n_words)).astype(np.int32)
        #: Where the current length is asked for.
        self.asks = np.ones(len(self.keys), bool)

    def counted(self, totals: Iterable[np.ndarray], cutoff: int) -> Iterator[np.ndarray]:
        """Counts over all packs, length by length as far as ``totals`` go; 0 where a length is not asked for.

        One length is held at a time: afterwards ``keys`` and ``asks`` are those of the next one.
        """
        for n, found in enumerate(totals, 1):
            if n == 1:
                spread = np.empty(len(self.hashes), np.uint64)
                spread[np.argsort(self.hashes)] = found
                count = spread[self.places]
                del spread
            else:
                count = np.zeros(len(self.asks), np.uint64)
                order, _, where = _ranked(self.keys[self.asks])
                spread = np.empty(len(order), np.uint64)
                spread[order] = found[where]
                count[self.asks] = spread
                del order, where, spread
            yield count
            often = count >= cutoff
            self.asks = self.place >= n
            self.asks[1:] &= often[1:] & often[:-1]
            longer = np.zeros(len(self.words), np.uint64)
            longer[1:] = blocks.mix(blocks.mix(self.keys[:-1] + np.uint64(n + 1)) * blocks._B + self.words[1:])
            longer[self.place < n] = 0
            self.keys = longer


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts the keys, where each different key begins in it, and which different key each place holds."""
    order = np.argsort(keys)
    opens = np.ones(len(keys), bool)
    ranked = keys[order]
    opens[1:] = ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(opens), np.cumsum(opens) - 1


def _bucket_bounds(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash ranges that occur and where each begins in the sorted keys (with the end added)."""
    ranges = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    begins = np.concatenate(([0], np.flatnonzero(np.diff(ranges)) + 1)) if len(keys) else np.empty(0, np.int64)
    return ranges[begins], np.append(begins, len(keys))


def _to_bytes(values: np.ndarray) -> bytes:
    """Compressed unsigned integers, byte plane by byte plane, as many as the largest needs; their number comes first."""
    planes = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + squeeze(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes())


def _from_bytes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data[1:]), np.uint8).reshape(data[0], -1)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, : len(planes)] = planes.T
    return values.view("<u8").reshape(-1)


ENTRIES = "range long, pack long, keys binary, counts binary"


def _by_order(found: pa.Scalar, order: int) -> Iterator[np.ndarray]:
    """The totals of a pack by order, each in the order of the pack's keys, unpacked when they are wanted."""
    parts = sorted((x["level"].as_py(), x["range"].as_py(), i) for i, x in enumerate(found)) if found.is_valid else []
    for n in range(order):
        own = [_from_bytes(found[i]["totals"].as_py()) for level, _, i in parts if level == n]
        yield np.concatenate([np.empty(0, np.uint64), *own])


def _entries(n: int, bits: int, cutoff: int):
    """Entries of the n-grams of ``n`` + 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, lengths, hashes, places, found in zip(*(batch[name] for name in ("pack", "lengths", "hashes", "places", "found"))):
                grams = Grams(hashes.as_py(), places.as_py(), lengths.values.to_numpy())
                for _ in grams.counted(_by_order(found, n), cutoff):
                    pass
                keys, counts = np.unique(grams.keys[grams.asks], return_counts=True)
                del grams
                ranges, bounds = _bucket_bounds(keys, bits)
                for begin in range(0, len(ranges), 64):
                    some = list(zip(ranges[begin : begin + 64].tolist(), bounds[begin:].tolist(), bounds[begin + 1 :].tolist()))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "range": [r for r, _, _ in some],
                            "pack": [pack.as_py()] * len(some),
                            "keys": pa.array([_to_bytes(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in some], pa.binary()),
                            "counts": pa.array([_to_bytes(counts[a:b]) for _, a, b in some], pa.binary()),
                        }
                    )

    return run


TOTALS = "pack long, range long, totals binary"


def _totals(entries: pa.Table) -> pa.Table:
    """Counts over all packs of one hash range, for every pack in the order of its keys."""
    keys = [np.cumsum(_from_bytes(x.as_py()), dtype=np.uint64) for x in entries["keys"]]
    counts = [_from_bytes(x.as_py()) for x in entries["counts"]]
    order, begins, where = _ranked(np.concatenate(keys))
    total = np.add.reduceat(np.concatenate(counts)[order], begins)
    spread = np.empty(len(order), np.uint64)
    spread[order] = total[where]
    edges = np.cumsum([0] + [len(k) for k in keys])
    answers = [_to_bytes(spread[a:b]) for a, b in zip(edges, edges[1:])]
    return pa.table({"pack": entries["pack"], "range": entries["range"], "totals": pa.array(answers, pa.binary())})


SCORES = "doc_id long, n_words long, n_backed_off long, log_score double"


def _scores(order: int, words: int, alpha: float, cutoff: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, lengths, hashes, places, found in zip(*(batch[name] for name in ("rows", "lengths", "hashes", "places", "found"))):
                grams = Grams(hashes.as_py(), places.as_py(), lengths.values.to_numpy())
                place, score, backed, before = grams.place, np.empty(0), np.empty(0, bool), None
                for n, count in enumerate(grams.counted(_by_order(found, order), cutoff)):
                    if n == 0:
                        score = np.log(count / words) if words else score
                        backed = np.zeros(len(score), bool)
                    else:
                        has = place >= n
                        seen = np.flatnonzero(has & (count >= cutoff))
                        score[has] += math.log(alpha)
                        score[seen] = np.log(count[seen] / before[seen - 1])
                        backed[has] = True
                        backed[seen] = False
                    before = count
                first = np.cumsum(grams.n_words) - grams.n_words
                sums = [float(score[a : a + n].sum()) for a, n in zip(first.tolist(), grams.n_words.tolist())]
                offs = [int(backed[a : a + n].sum()) for a, n in zip(first.tolist(), grams.n_words.tolist())]
                columns = {"doc_id": rows.values, "n_words": pa.array(grams.n_words), "n_backed_off": pa.array(offs, pa.int64()), "log_score": pa.array(sums, pa.float64())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _answered(packs: DataFrame, known: DataFrame | None) -> DataFrame:
    """The packs and ``found``, what is known of their n-grams."""
    texts = packs.select("pack", "rows", "lengths", "hashes", "places")
    if known is None:
        return texts.withColumn("found", F.lit(None).cast("array<struct<level: int, range: bigint, totals: binary>>"))
    return texts.join(known.groupBy("pack").agg(F.collect_list(F.struct("level", "range", "totals")).alias("found")), "pack", "left")


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, cutoff: int = CUTOFF, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_backed_off, log_score`` for every row, with counts over the words of all rows.

    A word's score is count(history word) / count(history) with the longest history (up to ``order`` - 1 words of the same text)
    for which the n-gram occurs ``cutoff`` times, times ``alpha`` for each word the history was cut by, down to its share of all words;
    ``log_score`` is the sum of the natural logarithms and ``n_backed_off`` the words whose longest history had to be cut.
    Words are maximal runs of characters other than ASCII white space; n-grams are told apart by 64-bit hashes.

    A null or empty text has no words and the score 0. Repeated rows count as often as they come and score alike; null
    ids are kept; other columns play no part. No rows in, no rows out.
    """
    if order < 1:
        raise ValueError("the order must be at least 1")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_utf8"))
    packs = settle(rows.mapInArrow(_gathered(pack_bytes), PACK), "packs")
    stats = packs.agg(F.count(F.lit(1)).alias("packs"), F.sum("n_words").alias("words")).first()
    # As many hash ranges as packs, so a range's entries are about as large as a pack's.
    bits = max(0, math.ceil(math.log2(max(1, stats["packs"]))))
    known = None
    # A row is megabytes here: a batch of several would hold a task's packs at once.
    with small_batches(docs.sparkSession, 1):
        for n in range(order):
            entries = _answered(packs, known).mapInArrow(_entries(n, bits, cutoff), ENTRIES)
            totals = entries.groupBy("range").applyInArrow(_totals, TOTALS).withColumn("level", F.lit(n))
            totals = settle(totals, f"totals-{n + 1}")
            known = totals if known is None else known.unionByName(totals)
        scores = _answered(packs, known).mapInArrow(_scores(order, stats["words"] or 0, alpha, cutoff), SCORES)
        return settle(scores, "scores")


ORACLE = rf"""
with texts as (
    select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), words as (
    select r, unnest(w) as w, generate_subscripts(w, 1) as i from texts
), pairs as (
    select r, i, w, lag(w) over (partition by r order by i) as h from words
), ones as (
    select w, count(*) as c from words group by w
), twos as (
    select h, w, count(*) as c from pairs where h is not null group by h, w
), scored as (
    select p.r,
        case when p.h is null then ln(o.c / (select cast(count(*) as double) from words))
             when t.c >= {CUTOFF} then ln(t.c / cast(ho.c as double))
             else ln({ALPHA}) + ln(o.c / (select cast(count(*) as double) from words)) end as s,
        p.h is not null and t.c < {CUTOFF} as backed
    from pairs p join ones o using (w) left join ones ho on ho.w = p.h left join twos t on t.h = p.h and t.w = p.w
), sums as (
    select r, sum(s) as s, count(*) filter (where backed) as b from scored group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(b, 0) as n_backed_off, round(coalesce(s, 0.0), 4) as log_score
from texts left join sums using (r)
"""


def oracle(order: int) -> str:
    """The twin for histories of up to ``order`` - 1 words; ``ORACLE`` is that of bigrams."""
    each = range(1, order + 1)
    grams = ", ".join(" || ' ' || ".join([f"lag(w, {k}) over p" for k in range(n - 1, 0, -1)] + ["w"]) + f" as g{n}" for n in each)
    tables = ", ".join(f"c{n} as (select g{n}, count(*) as t{n} from grams where g{n} is not null group by g{n})" for n in each)
    joins = " ".join(f"left join c{n} using (g{n})" for n in each)
    before = ", ".join(f"lag(t{n}) over p as h{n}" for n in each)
    cases = " ".join(f"when t{n} >= {CUTOFF} then ln(t{n} / cast(h{n - 1} as double)) + (least(i, {order}) - {n}) * ln({ALPHA})" for n in reversed(each[1:]))
    least = f"ln(t1 / (select cast(count(*) as double) from words)) + (least(i, {order}) - 1) * ln({ALPHA})"
    longest = " ".join(f"when {n} then coalesce(t{n} < {CUTOFF}, true)" for n in each[1:])
    return rf"""
with texts as (
    select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), words as (
    select r, unnest(w) as w, generate_subscripts(w, 1) as i from texts
), grams as (
    select r, i, {grams} from words window p as (partition by r order by i)
), {tables}, counted as (
    select * from grams {joins}
), placed as (
    select *, {before} from counted window p as (partition by r order by i)
), scored as (
    select r, case {cases} else {least} end as s, case least(i, {order}) {longest} else false end as backed from placed
), sums as (
    select r, sum(s) as s, count(*) filter (where backed) as b from scored group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(b, 0) as n_backed_off, round(coalesce(s, 0.0), 4) as log_score
from texts left join sums using (r)
"""
